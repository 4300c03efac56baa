"""Hand-computed cases of the audit's summaries, the report, grown scenarios, and what their operators share."""

import math

import pytest

from urbanloom.functions.text_params import parse_radii
from urbanloom.operators import audit, form, network, raster


def held(df):
    return {r[0]: r[-1] for r in df.collect()}


def test_access(spark):
    scores = spark.createDataFrame([(100.0,), (100.0,), (25.0,), (50.0,), (None,), (float("nan"),)], "score double")
    found = held(audit.access_metrics(scores))
    assert found == {"access_mean": 68.75, "access_median": 75.0, "access_share_full": 50.0, "access_share_low": 25.0, "origins": 4.0}
    assert held(audit.access_metrics(scores.where("score = 25 or score = 50 or score = 100").limit(3)))["origins"] == 3
    assert held(audit.access_metrics(scores.where("false"))) == {}


def test_balance_and_adequacy(spark):
    balance = spark.createDataFrame([("a", "Deficit"), ("b", "Meets standard"), ("c", "Meets standard"), ("d", "No standard")], "category string, status string")
    found = held(audit.balance_metrics(balance))
    assert found == {"standards_compliance_pct": pytest.approx(200 / 3), "standards_deficits": 1.0, "standards_categories": 3.0}
    none = held(audit.balance_metrics(balance.where("status = 'No standard'")))
    assert none == {"standards_deficits": 0.0, "standards_categories": 0.0}
    served = spark.createDataFrame([("f", "Overloaded", 150.0), ("g", "Adequate", 50.0), ("h", "Unused", 0.0)], "facility string, status string, utilization double")
    demand = spark.createDataFrame([(1, 30.0), (0, 10.0), (1, -5.0), (1, None)], "covered int, pop double")
    found = held(audit.adequacy_metrics(served, demand))
    assert found == {"covered_share": 75.0, "covered_pop": 30.0, "total_pop": 40.0, "facilities": 3.0, "facilities_overloaded": 1.0, "facilities_unused": 1.0, "mean_utilization": 100.0}
    assert "covered_share" not in held(audit.adequacy_metrics(served, demand.where("false")))


def test_density_and_walk(spark):
    cells = spark.createDataFrame([(2.0,), (4.0,), (None,)], "dens_ha double")
    assert held(audit.density_metrics(cells)) == {"density_mean": 3.0, "density_max": 4.0, "density_cells": 2.0}
    assert held(audit.density_metrics(cells.where("false"))) == {}
    segments = spark.createDataFrame([(40.0,), (60.0,), (None,)], "walk_score double")
    assert held(audit.walk_metrics(segments)) == {"walk_score_mean": 50.0, "walk_low_share": 50.0}


def test_index_and_report(spark):
    parts = [spark.createDataFrame([("access_mean", 60.0), ("covered_share", 80.0), ("walk_score_mean", 1.0)], "metric string, value double")]
    metrics = audit.labelled(audit.with_index(parts))
    assert held(metrics.select("metric_key", "value"))["plan_performance_index"] == 70.0
    balance = spark.createDataFrame([("<green>", -3.5, None)], "category string, balance_m2 double, status string")
    page = audit.performance_report(audit.Audit(metrics, balance), "A & B", 1200)
    assert "A &amp; B" in page and "&lt;green&gt;" in page and "70.0" in page and "1,200" in page and "Facilities" not in page
    with pytest.raises(ValueError):
        audit.performance_report(audit.Audit(metrics.where("metric_key = 'walk_score_mean'")))


def test_scenario_pipeline(spark):
    lines = spark.createDataFrame([(1, [(0.0, 0.0), (100.0, 0.0)]), (2, [(100.0, 0.0), (200.0, 0.0)])], "line_id long, pts array<struct<x: double, y: double>>")
    fit = spark.createDataFrame([(0, c, float(c)) for c in range(4)], "row int, col int, value double")
    urban = fit.where("col = 0").select("row", "col")
    shops = spark.createDataFrame([(0.0, 0.0)], "x double, y double")
    people = spark.createDataFrame([(5.0, 0.0, 7.0)], "x double, y double, pop double")
    # Two new cells beside one place; all within 15 minutes on foot of the shop.
    found = held(audit.scenario_pipeline(lines, urban, fit, 2, 9, (0.0, 50.0, 10.0, -20.0), {"shop": shops}, people, steps=1).metrics.select("metric_key", "value"))
    assert found["origins"] == 3.0 and found["access_mean"] == found["plan_performance_index"] == 100.0 and "walk_score_mean" in found


def test_sprawl(spark):
    cells = lambda places: spark.createDataFrame(places, "row int, col int")
    found = held(raster.sprawl_metrics(cells([(0, 0), (0, 1)]), cells([(0, 0), (0, 1), (1, 0), (5, 5)]), 100, 200, 10.0))
    assert len(found) == 12
    assert found["Urban growth (pct)"] == 100.0 and found["LCRPGR (SDG 11.3.1)"] == pytest.approx(1.0) and found["Land consumption rate (LCR)"] == pytest.approx(math.log(2))
    assert found["Urban patches (t2)"] == 2 and found["Largest patch share"] == 0.75 and found["Edge density (m per ha)"] == pytest.approx(120 / 0.04)
    assert held(raster.sprawl_metrics(cells([(0, 0)]), cells([(0, 1)]), 100, 100))["LCRPGR (SDG 11.3.1)"] is None
    with pytest.raises(ValueError):
        raster.sprawl_metrics(cells([]), cells([(0, 0)]), 1, 1)


def test_radii(spark):
    assert parse_radii("400, 800; N") == [400.0, 800.0, None] and parse_radii(" ") == [None]
    for wrong in ("0", "-3", "x"):
        with pytest.raises(ValueError):
            parse_radii(wrong)
    lines = spark.createDataFrame([(i, [(100.0 * i, 0.0), (100.0 * (i + 1), 0.0)]) for i in range(4)], "line_id long, pts array<struct<x: double, y: double>>")
    found = form.space_syntax_radii(lines, "150, n")
    assert found.columns[:3] == ["line_id", "connectivity", "NC_150"]
    rows = {r.line_id: r for r in found.collect()}
    assert rows[0].NC_150 == 2 and rows[0].NC_n == 4


def test_edge_and_sampled_betweenness(spark):
    # A path of four nodes and a street beside its middle one that is as long: half of the paths take each.
    lines = spark.createDataFrame([(0, [(0.0, 0.0), (1.0, 0.0)]), (1, [(1.0, 0.0), (2.0, 0.0)]), (2, [(1.0, 0.0), (2.0, 0.0)]), (3, [(2.0, 0.0), (3.0, 0.0)])], "line_id long, pts array<struct<x: double, y: double>>")
    nodes, edges = network.build_graph(lines)
    found = {r.edge_id: r for r in network.edge_centrality(nodes, edges).collect()}
    assert [found[i].betw_edge for i in range(4)] == [3.0, 2.0, 2.0, 3.0]
    assert found[0].str_mean == pytest.approx(1.0)
    whole = {r.node_id: r.betweenness for r in network.centrality(nodes, edges).collect()}
    assert {r.node_id: r.betweenness for r in network.centrality(nodes, edges, samples=4).collect()} == whole
    some = network.centrality(nodes, edges, samples=2).collect()
    assert sorted(some) == sorted(network.centrality(nodes, edges, samples=2).collect())
    assert {r.reach for r in some} == {4} and sum(r.betweenness for r in some) <= 2 * sum(whole.values())
