"""Costs between many points: measures are taken for pairs of places, and each place's ids are dealt in parts."""

import math

from urbanloom.operators import network as op


def _graph(spark):
    pt = lambda x: {"x": float(x), "y": 0.0}
    return op.build_graph(spark.createDataFrame([(i, [pt(i * 100), pt(i * 100 + 100)]) for i in range(3)], "line_id long, pts array<struct<x: double, y: double>>"))


def _brute(points, others, cutoff, same):
    out = []
    for i, x, y in points:
        for j, u, v in others:
            cost, far = 100.0 * abs(round(x / 100) - round(u / 100)), math.hypot(x - u, y - v)
            if cost <= cutoff and not (same and i == j):
                out.append((i, j, round(cost, 6), round(far, 6), round(cost / far, 6) if far else 0.0))
    return sorted(out)


def test_pairs_of_places_give_all_pairs_of_ids(spark, monkeypatch):
    monkeypatch.setattr(op, "IDS", 3)
    nodes, edges = _graph(spark)
    points = [(i, (i % 4) * 100.0 + (i % 2) * 7, 5.0 * (i % 3)) for i in range(40)] + [(99, 7.0, 5.0), (99, 7.0, 5.0)]
    df = spark.createDataFrame([*points, (100, None, 1.0)], "id long, x double, y double")
    got = op.od_matrix(nodes, edges, df, cutoff=200.0, digits=6)
    assert sorted(map(tuple, got.collect())) == _brute(points, points, 200.0, True)
    ends = points[:7]
    got = op.od_matrix(nodes, edges, df, spark.createDataFrame(ends, "id long, x double, y double"), cutoff=100.0, digits=6)
    assert sorted(map(tuple, got.collect())) == _brute(points, ends, 100.0, False)


def test_no_measure_is_taken_for_each_pair_of_ids(spark):
    nodes, edges = _graph(spark)
    df = spark.createDataFrame([(i, 0.0, 0.0) for i in range(10)], "id long, x double, y double")
    plan = op.od_matrix(nodes, edges, df, digits=6)._jdf.queryExecution().optimizedPlan().toString()
    above = plan[: plan.rindex("Generate")]
    assert "Generate" in above and not any(f in above.lower() for f in ("hypot", "round(", "join"))
