import math
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from urbanloom.operators import network, overlay
from urbanloom.operators import service_areas as sa

SPANS = "array<struct<lo: double, hi: double>>"


def line(*xy):
    return [(float(x), float(y)) for x, y in xy]


def lines(spark, rows, more=""):
    return spark.createDataFrame(rows, f"line_id long, pts array<struct<x: double, y: double>>{more}")


def test_intervals(spark):
    rows = [([(0.0, 0.3), (0.2, 0.5), (0.8, 0.9)], []), ([(0.0, 1.0)], [(0.3, 0.6)]), ([(0.2, 0.8)], [(0.0, 1.0)]), ([(-2.0, 0.25), (0.25, 3.0)], [(0.1, 0.2), (0.5, 0.6)]), ([(0.4, 0.4)], [])]
    df = spark.createDataFrame(rows, f"a {SPANS}, b {SPANS}").select(sa.merge_spans(F.col("a")).alias("m"), sa.subtract_spans(sa.merge_spans(F.col("a")), F.col("b")).alias("s"))
    got = [([tuple(x) for x in r.m], [tuple(x) for x in r.s]) for r in df.collect()]
    assert got[0] == ([(0.0, 0.5), (0.8, 0.9)],) * 2
    assert got[1] == ([(0.0, 1.0)], [(0.0, 0.3), (0.6, 1.0)])
    assert got[2] == ([(0.2, 0.8)], []) and got[4] == ([], [])
    assert got[3] == ([(0.0, 1.0)], [(0.0, 0.1), (0.2, 0.5), (0.6, 1.0)])


def test_cutting(spark):
    corner = line((0, 0), (10, 0), (10, 10))
    df = lines(spark, [(1, corner)])
    cut = lambda a, b: [tuple(p) for p in df.select(sa.cut_line(F.col("pts"), F.lit(a), F.lit(b)).alias("c")).first().c or []]
    assert cut(0.25, 0.75) == line((5, 0), (10, 0), (10, 5)) and cut(0.0, 1.0) == corner and cut(0.5, 0.5) == []
    assert tuple(df.select(sa.point_at(F.col("pts"), F.lit(0.5)).alias("p")).first().p) == (10.0, 0.0)


def reached(spark, rows, places, breaks, each=False, limit=None):
    _, edges = network.build_graph(lines(spark, rows), keep=["pts"])
    placed = sa.entries(edges, spark.createDataFrame(places, "id long, x double, y double"))
    return edges, placed, sa.reach(edges, placed, breaks, each)


@pytest.mark.parametrize("limit", [network.BROADCAST_EDGES, 0])
def test_entry_within_an_edge(spark, monkeypatch, limit):
    monkeypatch.setattr(network, "BROADCAST_EDGES", limit)
    rows = [(0, line((0, 0), (100, 0))), (1, line((100, 0), (200, 0)))]
    # 20 m off the middle of the first street, and on the second.
    edges, placed, found = reached(spark, rows, [(7, 50.0, 20.0), (8, 190.0, 0.0), (9, 50.0, 900.0)], [50.0, 100.0], each=True)
    got = {(r.source, r.edge_id): [[(round(x.lo, 9), round(x.hi, 9)) for x in s] for s in r.spans] for r in found.collect()}
    assert got[7, 0] == [[(0.2, 0.8)], [(0.0, 1.0)]] and got[7, 1] == [[], [(0.0, 0.3)]]
    assert got[8, 1] == [[(0.4, 1.0)], [(0.0, 1.0)]] and got[8, 0] == [[], [(0.9, 1.0)]]
    assert (9, 0) not in got  # the way to the street costs more than all breaks
    assert got[None, 1] == [[(0.4, 1.0)], [(0.0, 1.0)]]
    bands = {(r.source, r.edge_id, r.band): (round(r.lo, 9), round(r.hi, 9), round(r.len_m, 6)) for r in sa.pieces(edges, found, [50.0, 100.0]).where("source = 8").collect()}
    assert bands == {(8, 1, 50.0): (0.4, 1.0, 60.0), (8, 1, 100.0): (0.0, 0.4, 40.0), (8, 0, 100.0): (0.9, 1.0, 10.0)}


def test_nearest_edge(spark):
    rng = np.random.default_rng(3)
    rows = [(i, line(*(rng.random((int(rng.integers(2, 5)), 2)) * 60 + rng.random(2) * 1000))) for i in range(80)]
    points = [(i, float(x), float(y)) for i, (x, y) in enumerate(rng.random((60, 2)) * 1400 - 200)] + [(90, None, 1.0), (91, math.nan, 1.0)]
    _, edges = network.build_graph(lines(spark, rows), keep=["pts"])
    got = {r.id: r for r in sa.nearest_edge(spark.createDataFrame(points, "id long, x double, y double"), edges).collect()}
    assert len(got) == 62 and got[90].edge_id is None and got[91].edge_id is None
    for i, x, y in points[:60]:
        best = min((math.hypot(x - ax - u * (bx - ax), y - ay - u * (by - ay)), e) for e, pts in rows for (ax, ay), (bx, by) in zip(pts, pts[1:], strict=False) for u in [min(1, max(0, ((x - ax) * (bx - ax) + (y - ay) * (by - ay)) / ((bx - ax) ** 2 + (by - ay) ** 2)))])
        assert got[i].edge_id == best[1] and got[i].snap_m == pytest.approx(best[0]) and 0 <= got[i].t <= 1
    assert sa.nearest_edge(spark.createDataFrame(points, "id long, x double, y double"), edges.limit(0)).where("edge_id is not null").count() == 0


def test_areas(spark):
    edges, placed, found = reached(spark, [(0, line((0, 0), (300, 0)))], [(1, 150.0, 0.0)], [50.0, 100.0])
    got = {r.band: r for r in sa.summary(placed, edges, found, [50.0, 100.0], width=10.0).collect()}
    arc = 16 * 2 * math.sin(math.pi / 16) / 2 * 100  # the two ends of a buffer: a 32-gon
    for band in (50.0, 100.0):
        circle = 256 * math.sin(2 * math.pi / 256) / 2 * band * band
        assert got[band].street_len == pytest.approx(2 * band) and got[band].circle_area == pytest.approx(circle)
        assert got[band].net_area == pytest.approx(2 * band * 20 + 2 * arc / 2, rel=1e-6)
        assert got[band].pedshed == pytest.approx(got[band].net_area / circle)
    hull = {r.band: r.net_area for r in sa.summary(placed, edges, found, [50.0, 100.0], method="hull").collect()}
    assert hull == {50.0: 0.0, 100.0: 0.0}  # one straight street has no area


def cover(shapes, size, step):
    """Area by the middles of small cells."""
    c = (np.arange(int(size / step)) + 0.5) * step
    x, y = np.meshgrid(c, c)
    on = np.zeros(x.shape, bool)
    for p in shapes:
        q = np.roll(p, -1, axis=0)
        sides = [(b[0] - a[0]) * (y - a[1]) - (b[1] - a[1]) * (x - a[0]) for a, b in zip(p, q, strict=True)]
        on |= np.all([s >= 0 for s in sides], axis=0) | np.all([s <= 0 for s in sides], axis=0)
    return on.sum() * step * step


def test_union_of_random_shapes(spark, monkeypatch):
    rng = np.random.default_rng(8)
    shapes = {k: [rng.random((3, 2)) * 40 + rng.random(2) * 60 for _ in range(n)] for k, n in ((1, 60), (2, 7), (3, 1))}
    shapes[4] = [np.array([(x, y), (x + 10, y), (x + 10, y + 10), (x, y + 10)], "f8") for x in range(0, 50, 5) for y in range(0, 50, 10)] * 2
    rows = [(k, [(float(a), float(b)) for a, b in p]) for k, v in shapes.items() for p in v] + [(5, []), (6, [(1.0, 1.0), (2.0, 2.0)])]
    df = spark.createDataFrame(rows, "k long, ring array<struct<x: double, y: double>>")
    got = {r.k: r.area for r in overlay.union_area(df, ["k"]).collect()}
    for k in (1, 2, 3):
        assert got[k] == pytest.approx(cover(shapes[k], 100, 0.05), rel=2e-3)
    assert got[4] == pytest.approx(55 * 50) and 5 not in got and 6 not in got
    monkeypatch.setattr(overlay, "TILE_SHAPES", 6)
    again = {r.k: r.area for r in overlay.union_area(df, ["k"], tile=37.0).collect()}
    assert again.keys() == got.keys() and all(again[k] == pytest.approx(v) for k, v in got.items())
    assert overlay.union_area(df.limit(0), ["k"]).count() == 0


def test_split_over_cells(spark):
    star = [(5.0, 5.0), (95.0, 40.0), (190.0, 10.0), (130.0, 90.0), (150.0, 190.0), (80.0, 120.0), (10.0, 180.0), (50.0, 100.0)]
    hole = [(80.0, 80.0), (110.0, 80.0), (110.0, 105.0), (80.0, 105.0)]
    df = spark.createDataFrame([(star, [hole], 8.0), (star, None, None), (star[:2], None, 1.0)], "ext array<struct<x: double, y: double>>, holes array<array<struct<x: double, y: double>>>, v double")
    cells = overlay.polygon_grid(df, 50.0, "v").collect()
    assert sum(r.value for r in cells) == pytest.approx(8.0) and max(r.n_feat for r in cells) == 2
    inside = {(r.col, r.row): r.value for r in cells}
    step, tri = 0.25, np.array(star)
    x, y = np.meshgrid((np.arange(800) + 0.5) * step, (np.arange(800) + 0.5) * step)
    on = np.zeros(x.shape, bool)
    for (ax, ay), (bx, by) in zip(tri, np.roll(tri, -1, axis=0), strict=True):
        on ^= ((ay > y) != (by > y)) & (x < (bx - ax) * (y - ay) / (by - ay if by != ay else 1) + ax)
    on &= ~((x > 80) & (x < 110) & (y > 80) & (y < 105))
    for (c, r), v in inside.items():
        assert v == pytest.approx(8.0 * on[r * 200 : r * 200 + 200, c * 200 : c * 200 + 200].sum() / on.sum(), abs=0.02)


def test_split_over_cells_in_chunks(spark, monkeypatch):
    """Polygons that are cut a few strips at a time; what has no area, no end or no shell takes no part."""
    shapes, ring = "v double, ext array<struct<x: double, y: double>>, holes array<array<struct<x: double, y: double>>>", lambda x, y, w: [(x, y), (x + w, y), (x + w, y + w), (x, y + w)]
    rows = [(float(k), ring(k * 7.0, k * 3.0, 5.0 + k % 60), [ring(k * 7.0 + 1, k * 3.0 + 1, 2.0), []] if k % 2 else None) for k in range(50)]
    rows += [(1.0, [(0.0, 0.0), (1.0, float("nan")), (1.0, 1.0)], None), (1.0, [(0.0, 0.0), (9.0, 9.0), (3.0, 3.0)], None), (1.0, None, None), (2.0, ring(-500.0, -500.0, 900.0), [ring(0.0, 0.0, 10.0)])]
    batch = spark.createDataFrame([(v, [e, *(h or [])] if e else []) for v, e, h in rows if e], "v double, rings array<array<struct<x: double, y: double>>>").toArrow().combine_chunks().to_batches()[0]
    whole = overlay._cell_sums(batch, 10.0).to_pandas()
    monkeypatch.setattr(overlay, "STRIP_POINTS", 300)
    parts = overlay._cell_sums(batch, 10.0).to_pandas()
    assert parts[["_i", "_j", "n_feat"]].equals(whole[["_i", "_j", "n_feat"]]) and np.allclose(parts["value"], whole["value"])
    cells = overlay.polygon_grid(spark.createDataFrame(rows, shapes), 10.0, "v").collect()
    assert len(cells) == len(whole) == 90 * 90 and sum(r.value for r in cells) == pytest.approx(sum(range(50)) + 2.0)


def test_split_of_many_polygons_over_cells(spark):
    """20,000 courts take seconds: rings do not pass through nested expressions."""
    at = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    x, y = F.col("id") * 37 % 1999, F.col("id") * 53 % 1997
    ring = lambda a, b: F.array(at(x + a, y + a), at(x + b, y + a), at(x + b, y + b), at(x + a, y + b))
    df = spark.range(20_000).select(ring(0, 40).alias("ext"), F.array(ring(10, 20)).alias("holes"), F.lit(3.0).alias("v"))
    start = time.perf_counter()
    cells = overlay.polygon_grid(df, 100.0, "v").collect()
    assert sum(r.value for r in cells) == pytest.approx(60_000.0)
    assert time.perf_counter() - start < 40


def test_shared_walls(spark):
    turn = lambda ps, a: [(x * math.cos(a) - y * math.sin(a), x * math.sin(a) + y * math.cos(a)) for x, y in ps]
    box = lambda x, y, w, h: [(x, y), (x + w, y), (x + w, y + h), (x, y + h)]
    rows = [(1, box(0.0, 0.0, 10.0, 10.0)), (2, box(10.0, 2.0, 10.0, 4.0)), (3, box(0.0, 10.0, 5.0, 5.0)), (4, box(100.0, 0.0, 1.0, 1.0)), (5, box(20.0, 6.0, 3.0, 3.0))]
    for angle in (0.0, 0.7):
        df = spark.createDataFrame([(i, turn(r, angle)) for i, r in rows], "id long, ext array<struct<x: double, y: double>>").withColumn("holes", F.lit(None).cast("array<array<struct<x: double, y: double>>>"))
        for cell in (50.0, 3.0):
            got = {r.id: (round(r.shared_m, 6), round(r.sharedwall, 6)) for r in overlay.shared_walls(df, cell).collect()}
            assert got == {1: (9.0, 0.225), 2: (4.0, 0.142857), 3: (5.0, 0.25), 4: (0.0, 0.0), 5: (0.0, 0.0)}


def test_sweep_of_shapes_without_width():
    """Sides that lie on one another cover nothing, and do not disturb the shapes beside them."""
    thin = np.array([(0.0, 0.0), (1.0, 0.0), (1.0, 5.0), (1.0, 0.0)])
    line_ = np.array([(3.0, 1.0), (3.0, 4.0), (3.0, 2.0)])
    found, kinds = overlay.sweep([thin, line_])
    assert not len(found) and not len(kinds)
    square = np.array([(2.0, 0.0), (4.0, 0.0), (4.0, 4.0), (2.0, 4.0)])
    found, _ = overlay.sweep([square, line_])
    assert ((found[:, 1] - found[:, 0]) * (found[:, 3] - found[:, 2] + found[:, 5] - found[:, 4]) / 2).sum() == pytest.approx(8)
