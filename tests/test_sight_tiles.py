"""Views over tiles, many observers at once, against one view after the other over the whole raster."""

import numpy as np

from urbanloom.operators import sight


def test_views_over_tiles_equal_single_views(spark):
    rng = np.random.default_rng(5)
    z = rng.normal(0, 3, (300, 23)) + 20 * (rng.random((300, 23)) < 0.03)
    z[rng.random(z.shape) < 0.05] = np.nan
    seats = [(int(r), int(c)) for r, c in zip(rng.integers(0, 300, 90), rng.integers(0, 23, 90), strict=True)] * 2 + [(127, 3), (128, 3), (900, 3), (-40, 0)]
    for pixel, eye, target, radius, rays in ((2.0, 1.6, 0.0, 30.0, 90), (1.0, 5.0, 1.6, 7.0, 360), (2.0, 1.6, -0.5, 9.0, 60)):
        want = sum(sight.visible(z, at, pixel, eye, target, radius, rays).astype(int) for at in seats)
        # The raster's first row and column are odd numbers, but its places count from them.
        dsm = spark.createDataFrame([(r + 7, c - 3, float(z[r, c])) for r in range(300) for c in range(23)], "row int, col int, value double")
        eyes = spark.createDataFrame([(r + 7, c - 3) for r, c in seats], "row int, col int")
        got = np.zeros(z.shape, int)
        for row in sight.viewshed(dsm, eyes, pixel, eye, target, radius, rays).collect():
            got[row.row - 7, row.col + 3] = row.seen
        assert (got == want).all()


def test_a_bounded_view_does_not_need_the_whole_raster(spark, monkeypatch):
    monkeypatch.setattr(sight, "CELLS", 100)
    dsm = spark.createDataFrame([(r, c, 0.0) for r in range(40) for c in range(40)], "row int, col int, value double")
    eyes = spark.createDataFrame([(0, 0)], "row int, col int")
    assert sight.viewshed(dsm, eyes, 1.0, radius=5.0).where("seen > 0").count() > 20
