"""Nearest nodes: by arrays and by pairs alike, and without a sort of the points times their candidates."""

import numpy as np
import pytest

from urbanloom.operators import network


@pytest.mark.parametrize("crowd", [0, 20, 4096])
def test_against_all_pairs(spark, monkeypatch, crowd):
    monkeypatch.setattr(network, "CROWD", crowd, raising=False)
    rng = np.random.default_rng(7)
    at = np.concatenate([rng.integers(0, 20, (60, 2)), rng.integers(-400, 400, (20, 2))]).astype(float)
    asked = np.concatenate([rng.integers(-10, 30, (80, 2)), rng.integers(-900, 900, (40, 2))]) + 0.5
    nodes = spark.createDataFrame([(i, *p) for i, p in enumerate(at.tolist())], "node_id long, x double, y double")
    points = spark.createDataFrame([(i, *p) for i, p in enumerate(asked.tolist())] + [(500, None, 1.0), (501, 1.0, float("nan"))], "id long, x double, y double")
    got = {r.id: (r.node_id, r.snap_m) for r in network.nearest_node(points, nodes).collect()}
    assert got.pop(500) == got.pop(501) == (None, None) and len(got) == len(asked)
    d = np.hypot(asked[:, None, 0] - at[:, 0], asked[:, None, 1] - at[:, 1])
    assert all(got[i] == (int(d[i].argmin()), pytest.approx(d[i].min())) for i in range(len(asked)))


def test_points_are_not_sorted_with_their_candidates(spark, monkeypatch):
    plans, real = [], network.written
    monkeypatch.setattr(network, "written", lambda df: plans.append(df._jdf.queryExecution().toString()) or real(df))
    nodes = spark.range(64).selectExpr("id AS node_id", "id % 8 * 100D AS x", "id div 8 * 100D AS y")
    points = spark.range(1000).selectExpr("id", "id * 37 % 701 + 0.25D AS x", "id * 53 % 701 + 0.25D AS y")
    assert network.nearest_node(points, nodes).count() == 1000
    assert plans and not any("SortAggregate" in p for p in plans)
