import numpy as np
import pytest
from pyspark.sql import functions as F

from urbanloom.operators import tessellation as ts

RING = "array<struct<x: double, y: double>>"


def area(p):
    p = np.array(p)
    return float((p[:, 0] * np.roll(p[:, 1], -1) - np.roll(p[:, 0], -1) * p[:, 1]).sum()) / 2 if len(p) else 0.0


@pytest.mark.parametrize("tile", [None, 13.0])
def test_cells_equal_those_of_all_pairs(spark, tile):
    """200 seeds, crowded and sparse: each cell is the mask cut by all bisectors; together they tile the mask."""
    rng = np.random.default_rng(5)
    xy = np.unique(np.round(np.concatenate([rng.random((120, 2)) * 20, rng.random((70, 2)) * 200, [[250.0, 250.0], [-40.0, 100.0]]]), 3), axis=0)
    mask = np.array([(-60.0, -10.0), (270.0, -10.0), (270.0, 270.0), (-60.0, 270.0)])
    df = spark.createDataFrame([(float(x), float(y), i) for i, (x, y) in enumerate(xy)], "x double, y double, key long")
    got = {r.key: [(p.x, p.y) for p in r.ring] for r in ts.cells(df, mask, tile).collect()}
    assert len(got) == len(xy) and sum(area(r) for r in got.values()) == pytest.approx(330 * 280)
    for k, at in enumerate(xy):
        order = np.argsort(np.hypot(*(xy - at).T))[1:]
        want, _ = ts.cut_cell(mask, np.full(4, -1), at, xy[order], order)
        assert area(got[k]) == pytest.approx(area(want), rel=1e-9, abs=1e-9)


def box(i, x, y, w, h):
    return (i, [(x, y), (x + w, y), (x + w, y + h), (x, y + h)])


def test_rows_of_buildings(spark):
    rows = [box(i * 3 + j, 20.0 * i, 20.0 * j, 10.0, 10.0) for i in range(3) for j in range(3)]
    df = spark.createDataFrame([*rows, (99, [(0.0, 0.0)])], f"id long, ext {RING}")
    study = [(-5.0, -5.0), (55.0, -5.0), (55.0, 55.0), (-5.0, 55.0)]
    sums, borders = ts.tessellation(df, 0.4, 2.0, study=study)
    got = {r.id: r.cell_m2 for r in sums.collect()}
    assert got.keys() == set(range(9)) and all(v == pytest.approx(400, rel=1e-6) for v in got.values())
    sides = borders.withColumn("m", F.hypot(F.col("ax") - F.col("bx"), F.col("ay") - F.col("by"))).groupBy("id", "other").agg(F.sum("m").alias("m")).collect()
    middle = {r.other: r.m for r in sides if r.id == 4}
    assert {k: round(v) for k, v in middle.items() if v > 1} == {1: 20, 3: 20, 5: 20, 7: 20}
    assert sum(r.m for r in sides if r.other == ts.BORDER) == pytest.approx(240)
    with pytest.raises(ValueError, match="three"):
        ts.tessellation(df.where("id < 2"))


def test_hull_mask_and_shrinking(spark):
    rows = [box(1, 0.0, 0.0, 4.0, 4.0), box(2, 30.0, 0.0, 4.0, 4.0), box(3, 0.0, 30.0, 4.0, 4.0)]
    sums, _ = ts.tessellation(spark.createDataFrame(rows, f"id long, ext {RING}"), 0.0, 1.0, limit=10.0)
    hull = np.array([(0, 0), (34, 0), (34, 4), (4, 34), (0, 34)], float)
    wide = ts.widened(hull, 10.0)
    assert sum(r.cell_m2 for r in sums.collect()) == pytest.approx(area(wide))
    edge = np.hypot(*(np.roll(hull, -1, axis=0) - hull).T).sum()
    assert area(wide) == pytest.approx(area(hull) + 10 * edge + np.pi * 100, rel=2e-3)
    ring = ts.shrunk(np.array([(0, 0), (0, 10), (10, 10), (10, 0)], float), 1.0)
    assert area(ring) == pytest.approx(64) and len(ts.shrunk(np.array([(0, 0), (1, 0), (1, 1), (0, 1)], float), 3.0)) == 4
