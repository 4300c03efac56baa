"""Noding, walkability, door-to-door access, eigenvector centrality and housing rows on cases worked out by hand."""

import math

import numpy as np
import pyarrow as pa
import pytest

from urbanloom.operators import network, noding, planning, transit, walkability

LINE = "line_id long, pts array<struct<x: double, y: double>>"


def lines(spark, rows):
    return spark.createDataFrame([(i, [tuple(map(float, p)) for p in pts]) for i, pts in rows], LINE)


def pieces(spark, rows, **more):
    found = noding.prepare_network(lines(spark, rows), **more).orderBy("seg_id").collect()
    assert [r.seg_id for r in found] == list(range(len(found)))
    return [(r.line_id, [tuple(p) for p in r.pts], round(r.length_m, 6)) for r in found]


@pytest.mark.parametrize("cell", [None, 1.0, 1000.0])
def test_crossing_touching_and_corners(spark, cell):
    got = pieces(spark, [(1, [(0, 0), (10, 0)]), (2, [(5, -5), (5, 5)]), (3, [(8, 0), (8, 4)]), (4, [(20, 0), (20, 5), (25, 5)]), (5, [(20, 5), (15, 5)])], cell=cell)
    assert got == [
        (1, [(0, 0), (5, 0)], 5), (1, [(5, 0), (8, 0)], 3), (1, [(8, 0), (10, 0)], 2), (2, [(5, -5), (5, 0)], 5), (2, [(5, 0), (5, 5)], 5),
        (3, [(8, 0), (8, 4)], 4), (4, [(20, 0), (20, 5)], 5), (4, [(20, 5), (25, 5)], 5), (5, [(20, 5), (15, 5)], 5),
    ]


def test_overlaps_are_one_and_slivers_go(spark):
    got = pieces(spark, [(1, [(0, 0), (10, 0)]), (2, [(14, 0), (4, 0)]), (3, [(4, 0), (10, 0)]), (4, [(10.01, -1), (10.01, 1)])])
    assert [(i, n) for i, _, n in got] == [(1, 4.0), (1, 6.0), (2, 3.99), (4, 1.0), (4, 1.0)]


def test_a_line_does_not_cut_itself_and_odd_lines(spark):
    loop = [(0, 0), (4, 4), (4, 0), (0, 4)]
    assert pieces(spark, [(1, loop), (2, [(50, 50)]), (3, [])]) == [(1, loop, round(2 * math.hypot(4, 4) + 4, 6))]
    assert pieces(spark, [(1, [(3, 3), (3, 3)])]) == []
    assert noding.prepare_network(spark.createDataFrame([], LINE)).count() == 0


def test_doubles_are_found_by_digest_and_numbers_follow_lines(spark):
    """Lines upon lines in both directions; the numbers have no gaps where doubles went."""
    rows = [(k, [(0, k // 3), (10, k // 3)][:: 1 if k % 2 else -1]) for k in range(12)] + [(90, [(5, -1), (5, 9)]), (91, [(5, 9), (5, 1), (5, -1)])]
    got = pieces(spark, rows)
    assert [(i, n) for i, _, n in got] == [(k, 5.0) for k in (0, 3, 6, 9) for _ in "ab"] + [(90, n) for n in (1.0, 1.0, 1.0, 1.0, 6.0)]


def test_cells_shrink_with_the_crowd(spark, monkeypatch):
    """A cell holds about CELL_PARTS segments, so pairs grow no faster than crossings; the pieces stay the same."""
    rng = np.random.default_rng(8)
    rows = [(i, [tuple(rng.uniform(0, 100, 2)), tuple(rng.uniform(0, 100, 2))]) for i in range(60)]
    whole = pieces(spark, rows)
    monkeypatch.setattr(noding, "CELL_PARTS", 8)
    parts = noding.segments(lines(spark, rows))
    side = noding.cell_side(parts)
    crowd = noding.in_cells(parts, side).groupBy("ci", "cj").count().agg({"count": "avg"}).first()[0]
    assert 2 < crowd < 16 and pieces(spark, rows) == whole


def test_prepared_lines_make_a_joined_graph(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [tuple(rng.uniform(0, 100, 2)) for _ in range(3)]) for i in range(25)]
    made = noding.prepare_network(lines(spark, rows), 0.0, 17.0)
    got = made.collect()
    segments = [(i, p[k], p[k + 1]) for i, p in rows for k in range(2)]
    met = 0
    for a, (i, p, q) in enumerate(segments):
        for j, u, v in segments[a + 1 :]:
            turn = lambda o, s, t: (s[0] - o[0]) * (t[1] - o[1]) - (s[1] - o[1]) * (t[0] - o[0])
            met += i != j and turn(p, q, u) * turn(p, q, v) < 0 and turn(u, v, p) * turn(u, v, q) < 0
    assert len(got) == 25 + 2 * met
    assert sum(r.length_m for r in got) == pytest.approx(sum(math.dist(p, q) for _, p, q in segments))
    nodes, _ = network.build_graph(made.select(made.seg_id.alias("line_id"), "pts"), 1e-6)
    assert nodes.count() == 50 + met


def test_circle_area_and_mix(spark):
    square = np.array([(-1.0, -1), (1, -1), (1, 1), (-1, 1)])
    whole = walkability.CIRCLE / 2 * math.sin(2 * math.pi / walkability.CIRCLE)
    assert walkability.clipped_to_circle(square, 0, 0, 10) == pytest.approx(4)
    assert walkability.clipped_to_circle(square * 50, 0, 0, 1) == pytest.approx(whole)
    assert walkability.clipped_to_circle(square * 50 + (50, 0), 0, 0, 1) == pytest.approx(whole / 2)
    assert walkability.clipped_to_circle(square + (100, 0), 0, 0, 1) == 0
    rings = [("home", [(-500.0, -500.0), (0.0, -500.0), (0.0, 500.0), (-500.0, 500.0)]), ("shop", [(0.0, -500.0), (500.0, -500.0), (500.0, 500.0), (0.0, 500.0)])]
    landuse = spark.createDataFrame(rings, "category string, ring array<struct<x: double, y: double>>")
    streets = lines(spark, [(1, [(-10, 0), (0, 0), (10, 0)]), (2, [(-250, 0), (-240, 0)]), (3, [(9000, 0), (9010, 0)])])
    got = {r.line_id: r for r in walkability.walkability(streets, 100.0, landuse=landuse, weights={"slope": 0.0}).collect()}
    assert [round(got[i].mix_ent, 9) for i in (1, 2, 3)] == [1.0, 0.0, 0.0]
    assert got[1].blk_len == 20 and got[1].int_km2 == 0 and "n_pois" not in got[1]
    assert got[1].walk_score == pytest.approx((0.25 * 100 + 0.1 * 100) / 0.65)


def test_midpoint(spark):
    got = lines(spark, [(1, [(0, 0), (0, 2), (8, 2)]), (2, [(1, 1), (1, 1)])]).select("line_id", walkability.midpoint("pts").alias("m")).orderBy("line_id").collect()
    assert [tuple(r.m) for r in got] == [(3, 2), (1, 1)]


def test_door_to_door(spark):
    nodes, edges = network.build_graph(lines(spark, [(i, [(i * 1000, 0), (i * 1000 + 1000, 0)]) for i in range(10)] + [(99, [(0, 90000), (10, 90000)])]))
    stops = spark.createDataFrame([(1, 1000.0, 0.0), (2, 9000.0, 0.0), (3, 0.0, 5000.0)], "stop_id long, x double, y double")
    times = spark.createDataFrame([(7, 1, 1, 29600, 29700), (7, 2, 2, 30000, 30000), (8, 3, 1, 28800, 28800), (8, 2, 2, 28900, 28900)], "trip_id long, stop_id long, seq int, arr long, dep long")
    origins = spark.createDataFrame([(0.0, 0.0)], "x double, y double")
    demand = spark.createDataFrame([("near", 1000.0, 0.0), ("far", 10000.0, 0.0), ("island", 0.0, 90000.0)], "name string, x double, y double")
    got = {r.name: r for r in transit.door_to_door(nodes, edges, times, stops, origins, demand, 28800.0, 3.6 * 2, 10.0).collect()}
    # 2 m a second: the first stop after 500 s, the trip arrives at 30000, 500 s more to the end; stop 3 is too far off.
    assert got["far"][3:] == (pytest.approx(5000 / 60), pytest.approx(1700 / 60), pytest.approx(1700 / 60), pytest.approx(3300 / 60), "Transit")
    assert got["near"].mode == "Walk" and got["near"].saved_min == 0 and got["near"].walk_min == pytest.approx(500 / 60)
    assert got["island"][3:] == (None, None, None, None, "Unreachable")


def test_eigenvector(spark):
    _, edges = network.build_graph(lines(spark, [(1, [(0, 0), (1, 0)]), (2, [(1, 0), (2, 0)])]))
    got = [r.eigen for r in network.eigenvector(edges).orderBy("node_id").collect()]
    assert got == pytest.approx([math.sqrt(0.5), 1, math.sqrt(0.5)], abs=1e-8)
    assert network.eigenvector(edges.where("false")).count() == 0


def test_housing_rows():
    rows = dict(planning.housing_metrics(10000, 3800, 2.5, 0.05, 100, 50))
    assert len(rows) == 9 and rows["Target stock (units)"] == 4200 and rows["Dwellings needed"] == 550


def test_pairs_of_segments_stay_in_their_task(spark, monkeypatch):
    lines = spark.range(60).selectExpr("id AS line_id", "array(named_struct('x', id * 37 % 61 * 1D, 'y', id * 23 % 59 * 1D), named_struct('x', id * 41 % 67 * 1D, 'y', id * 53 % 71 * 1D)) AS pts")
    parts = noding.segments(lines).cache()
    met = noding.crossings(parts, 20.0)
    assert "Join" not in met._jdf.queryExecution().optimizedPlan().toString()
    monkeypatch.setattr(noding, "PAIRS", 1)
    rows = pa.table({n: [getattr(r, n) for r in parts.collect()] for n in parts.columns})
    small = [tuple(r.values()) for b in noding._meetings(iter(rows.to_batches())) for r in b.to_pylist()]
    monkeypatch.setattr(noding, "PAIRS", 200_000)
    assert sorted(small) == sorted(tuple(r.values()) for b in noding._meetings(iter(rows.to_batches())) for r in b.to_pylist())
    assert set(small) == {tuple(r) for r in met.collect()} and small
