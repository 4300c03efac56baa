import json

import pytest

from urbanloom.operators import detection, scenarios


def frames(spark):
    return {
        "b_scores": spark.createDataFrame([(1, 100.0, 2), (2, 40.0, 1), (3, None, 0)], "id long, Score double, N_REACH int"),
        "c_scores": spark.createDataFrame([(1, 0.0, 2)], "id long, score double, n_reach int"),
        "cells": spark.createDataFrame([(3.0, 1.5), (5.0, 2.5)], "value double, dens_ha double"),
        "heads": spark.createDataFrame([("green", 10.0, 1.0, "Deficit"), ("school", 4.0, 1.0, "Surplus"), ("other", 1.0, 1.0, "No standard")], "category string, balance_m2 double, m2_capita double, status string"),
        "people": spark.createDataFrame([(1, 10.0, 3, "x"), (0, -1.0, 5, "y"), (None, -1.0, None, "z")], "covered int, net_cost double, population int, name string"),
        "places": spark.createDataFrame([("a", 50.0, 5.0, "Adequate"), ("b", 150.0, 9.0, "Overloaded"), ("c", 0.0, 0.0, "Unused")], "facility string, utilization double, assigned double, status string"),
        "streets": spark.createDataFrame([(1, 2.0)], "line_id long, value double"),
    }


def test_kinds_by_columns(spark):
    tables = frames(spark)
    found = detection.detect(tables)
    assert {k: next(n for n, t in tables.items() if t is v) for k, v in found.items()} == {"access": "b_scores", "balance": "heads", "facilities": "places", "demand": "people", "density": "cells"}
    assert detection.detect({"streets": tables["streets"]}) == {}
    with pytest.raises(ValueError, match="no table"):
        detection.metrics_of({})


def test_snapshot_of_a_folder(spark, tmp_path):
    for name, df in frames(spark).items():
        df.write.parquet(f"{tmp_path}/results/{name}.parquet")
    path = f"{tmp_path}/snap.json"
    got = {r.metric_key: r.value for r in detection.snapshot_folder(spark, f"{tmp_path}/results", "now", path, "2026-01-01").collect()}
    want = {"access_mean": 70.0, "origins": 2, "access_share_full": 50.0, "standards_compliance_pct": 50.0, "standards_deficits": 1, "facilities": 3, "facilities_overloaded": 1, "mean_utilization": 100.0, "total_pop": 8.0, "covered_pop": 3.0, "covered_share": 37.5, "density_mean": 2.0, "density_max": 2.5, "density_cells": 2}
    assert {k: got[k] for k in want} == pytest.approx(want)
    assert got["plan_performance_index"] == pytest.approx((70 + 50 + 37.5) / 3, abs=1e-3)
    assert json.loads(open(path).read())["metrics"]["density_max"] == 2.5
    assert {r.metric: r.value for r in scenarios.read_snapshots(spark, path).collect()}["covered_pop"] == 3.0


def test_demand_without_a_population(spark):
    tables = frames(spark)
    metrics = detection.metrics_of({"facilities": tables["places"], "demand": tables["people"].drop("population")})
    assert {r.metric_key: r.value for r in metrics.collect()}["total_pop"] == 3.0
