"""Hand-computed cases of sight, sun and pit filling."""

import datetime

import numpy as np
import pytest

from urbanloom.operators import basins, sight


def cells(spark, z):
    return spark.createDataFrame([(r, c, float(v)) for r, row in enumerate(z) for c, v in enumerate(row)], "row int, col int, value double")


def test_viewshed(spark):
    z = [[0, 0, 0, 0, 10, 0, 0]]
    seen = {r.col: r.seen for r in sight.viewshed(cells(spark, z), spark.createDataFrame([(0, 0), (0, 99)], "row int, col int"), 1.0).collect()}
    assert [seen[c] for c in range(7)] == [1, 1, 1, 1, 1, 0, 0]
    back = {r.col: r.seen for r in sight.visual_exposure(cells(spark, z), spark.createDataFrame([(0, 4)], "row int, col int"), 1.0).collect()}
    assert all(back[c] == 1 for c in range(7))


def test_isovist(spark):
    blocked = spark.createDataFrame([(10, 14)], "row int, col int")
    r = sight.isovists(blocked, spark.createDataFrame([(10, 10)], "row int, col int"), 1.0, 360, 5.0, (21, 21)).collect()[0]
    assert 3 <= r.min_rad <= 4 and r.max_rad == 5 and 0.8 < r.occlus < 1 and r.iso_area == pytest.approx(np.pi * 25, rel=0.1)


def lowest_way_out(z):
    """Levels by relaxation until nothing changes."""
    rim = np.zeros(z.shape, bool)
    rim[[0, -1], :] = rim[:, [0, -1]] = True
    level = np.where(rim & ~np.isnan(z), z, np.inf)
    while True:
        around = np.pad(level, 1, constant_values=np.inf)
        best = np.min([around[1 + a : 1 + a + z.shape[0], 1 + b : 1 + b + z.shape[1]] for a in (-1, 0, 1) for b in (-1, 0, 1)], axis=0)
        new = np.where(np.isnan(z) | rim, level, np.minimum(level, np.maximum(z, best)))
        if (new == level).all():
            return np.where(np.isinf(level), z, level)
        level = new


def test_pits(spark):
    z = np.array([[5.0, 5, 5], [5, 1, 5], [5, 5, 5]])
    got = {(r.row, r.col): r.value for r in basins.fill_depressions(cells(spark, z)).collect()}
    assert got[1, 1] == 5 and len(got) == 9
    assert basins.fill_depressions(cells(spark, z).limit(0)).count() == 0


@pytest.mark.parametrize("tile", [256, 7, 3])
def test_pits_over_tiles(spark, tile):
    """Any tiles give the levels of the whole raster: winding ways out, walls, a part that no way leads out of."""
    rng = np.random.default_rng(tile)
    z = rng.integers(0, 60, (23, 17)).astype(float)
    z[2:21, 2:15] += 40
    z[1:22, 8] = np.arange(21)[::-1]  # a valley through many tiles
    z[rng.random(z.shape) < 0.1] = np.nan
    z[9:14, 3:7] = np.nan
    z[10:13, 4:6] = 1.0
    df = spark.createDataFrame([(r + 100, c - 5, float(v)) for r, row in enumerate(z) for c, v in enumerate(row)], "row int, col int, value double")
    got = {(r.row - 100, r.col + 5): r.value for r in basins.fill_depressions(df, tile).collect()}
    want = lowest_way_out(z)
    assert got == {(r, c): want[r, c] for r, c in zip(*np.nonzero(~np.isnan(z)), strict=True)}
    assert got[11, 4] == 1.0


def test_irradiation(spark):
    flat = cells(spark, [[0.0] * 3])
    june, dec = (sight.irradiation(flat, 2.0, datetime.date(2024, m, 21), 0.0, 45.0, 0.0, 120.0).collect()[0].kwh_m2 for m in (6, 12))
    assert 6 < june < 10 and 1 < dec < 3
    assert sight.clear_sky(-1, 100) == (0.0, 0.0)
