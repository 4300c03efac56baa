import numpy as np
import pytest
from pyspark.sql import functions as F

from urbanloom.operators import blockage, overlay

RING = "array<struct<x: double, y: double>>"


def box(x, y, w, h):
    return [(float(a), float(b)) for a, b in ((x, y), (x + w, y), (x + w, y + h), (x, y + h))]


def areas(spark, houses, streets, tile=None):
    df = spark.createDataFrame(houses, f"ext {RING}, spread_m double, collapsed boolean")
    parts = blockage.blocked_streets(df, spark.createDataFrame([(s,) for s in streets], f"ring {RING}"), tile)
    return {r.what: r.area_m2 for r in blockage.blockage(parts).collect()}


def test_rectangles(spark):
    """Square corners: a house of 10 x 10 that spreads 5 m covers 20 x 20, and 5 m of a street beside it."""
    street = box(-50, 15, 200, 8)
    got = areas(spark, [(box(0, 0, 10, 10), 5.0, True), (box(60, 0, 10, 10), 9.0, False)], [street])
    assert got == pytest.approx({"envelope": 400, "blocked": 0, "corridors": 1600})
    got = areas(spark, [(box(0, 0, 10, 10), 8.0, True), (box(12, 0, 10, 10)[::-1], 8.0, True)], [street], tile=7.0)
    assert got == pytest.approx({"envelope": 38 * 26, "blocked": 38 * 3, "corridors": 1600 - 38 * 3})
    assert areas(spark, [(box(0, 0, 1, 1), 5.0, False)], [street]) == pytest.approx({"envelope": 0, "blocked": 0, "corridors": 1600})


def test_corners():
    """An L keeps its inner corner whole, a sharp corner is cut at twice the spread."""
    ell = np.array([(0, 0), (20, 0), (20, 10), (10, 10), (10, 20), (0, 20)], float)
    found, _ = overlay.sweep(blockage.spread_pieces(ell, 2.0))
    area = ((found[:, 1] - found[:, 0]) * (found[:, 3] - found[:, 2] + found[:, 5] - found[:, 4]) / 2).sum()
    assert area == pytest.approx(24 * 24 - 10 * 10)
    sharp = blockage.spread_pieces(np.array([(0, 0), (30, 0), (0, 3)], float), 1.0)
    assert max(p[:, 0].max() for p in sharp) < 32.1 and len(sharp) == 7
    assert blockage.spread_pieces(np.array([(0, 0), (1, 1), (2, 2)], float), 1.0) == []


def test_layers_against_small_cells(spark):
    rng = np.random.default_rng(3)
    streets = [[tuple(map(float, p)) for p in rng.random((3, 2)) * 60 + rng.random(2) * 40] for _ in range(12)]
    houses = [([tuple(map(float, p)) for p in rng.random((3, 2)) * 30 + rng.random(2) * 60], float(rng.random() * 4), True) for _ in range(15)]
    got = areas(spark, houses, streets)
    c = (np.arange(2200) + 0.5) * 0.05 - 5
    x, y = np.meshgrid(c, c)

    def cover(shapes):
        on = np.zeros(x.shape, bool)
        for p in shapes:
            p = np.array(p)
            sides = [(b[0] - a[0]) * (y - a[1]) - (b[1] - a[1]) * (x - a[0]) for a, b in zip(p, np.roll(p, -1, axis=0), strict=True)]
            on |= np.all([s >= 0 for s in sides], axis=0) | np.all([s <= 0 for s in sides], axis=0)
        return on

    a, b = cover(streets), cover([q for ext, by, _ in houses for q in blockage.spread_pieces(np.array(ext), by)])
    assert got["blocked"] == pytest.approx((a & b).sum() * 0.0025, rel=5e-3)
    assert got["corridors"] == pytest.approx((a & ~b).sum() * 0.0025, rel=5e-3)


def test_strips(spark):
    roads = spark.createDataFrame([(1, [(0.0, 0.0), (100.0, 0.0), (100.0, 50.0)], 10.0)], f"line_id long, pts {RING}, w double")
    strips = blockage.street_strips(roads, F.col("w")).withColumn("k", F.lit(1))
    area = overlay.union_area(strips, ["k"]).first().area
    assert area == pytest.approx(100 * 10 + 50 * 10 + np.pi * 25 * 1.25 - 25, rel=5e-3)


def test_stacked_shapes_leave_few_in_a_tile(spark, monkeypatch):
    from urbanloom.operators import overlay

    frames, real = [], overlay.written
    monkeypatch.setattr(overlay, "written", lambda df: frames.append(real(df)) or frames[-1])
    shapes = spark.range(400).selectExpr("1 AS k", "id * 7 % 20 / 2D AS x", "id * 11 % 400 / 40D AS y").selectExpr("k", "array(named_struct('x', x, 'y', y), named_struct('x', x + 40, 'y', y), named_struct('x', x + 40, 'y', y + 40), named_struct('x', x, 'y', y + 40)) AS ring")
    overlay.overlaid(shapes, ["k"])
    last = [f for f in frames if {"i", "ring"} <= set(f.columns)][-1]
    assert last.groupBy("i", "j").count().agg({"count": "max"}).first()[0] < 200
