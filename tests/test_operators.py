"""Hand-computed cases of the urban operators."""

import math

import pytest
from pyspark.sql import functions as F

from urbanloom.functions import text_params as tp
from urbanloom.operators import equity, network, planning


def one(df):
    return df.collect()[0]


def units(spark, values, weights=None, groups=None):
    n = len(values)
    return spark.createDataFrame(list(zip(map(float, values), weights or [1.0] * n, groups or ["g"] * n, range(n), strict=True)), "v double, w double, g string, i long")


@pytest.mark.parametrize("values, gini", [([1.0, 2, 3, 4], 0.25), ([20.0, 20, 80, 80], 0.3), ([5.0, 5, 5], 0.0)])
def test_gini(spark, values, gini):
    assert one(equity.access_equity(units(spark, values), "v"))["gini"] == pytest.approx(gini)


def test_theil_parts(spark):
    r = one(equity.access_equity(units(spark, [0.0, 2.0]), "v"))
    assert r.theil == pytest.approx(math.log(2))
    rows = {r.scope: r for r in equity.access_equity(units(spark, [1.0, 1, 3, 3], groups=["a", "a", "b", "b"]), "v", group="g").collect()}
    assert rows["ALL"].theil == pytest.approx(rows["ALL"].theil_btw + rows["ALL"].theil_wth)
    assert rows["ALL"].theil_wth == pytest.approx(0)


def test_ranks_ratio_and_share(spark):
    df = units(spark, [20.0, 20, 80, 80])
    r = one(equity.access_equity(df, "v", poverty=50.0))
    assert (r.p90_p10, r.pov_share) == (4, 0.5)
    ranks = sorted(x.pct_rank for x in equity.access_equity_units(df, "v").collect())
    assert ranks == [25, 25, 75, 75]


def test_crosstab(spark):
    rows = equity.equity_crosstab(units(spark, [1.0, 2, 3, 4], groups=["0", "0", "1", "1"]), "v", "g", classes=2).collect()
    cells = {(r.grp, r["class"]): r for r in rows}
    assert [cells[g, c].pop for g in "01" for c in (0, 1)] == [2, 0, 0, 2]
    assert cells["0", 0].rep_ratio == 2 and cells["0", 0].dissimilarity == 1
    rows = equity.equity_crosstab(units(spark, [10.0, 90], [9.0, 1.0], ["a", "b"]), "v", "g", "w", breaks=[50.0]).collect()
    assert sorted(r.pop for r in rows) == [0, 0, 1, 9]


def test_standards(spark):
    df = spark.createDataFrame([("Green", 2000.0), ("School", 1000.0), ("Industry", 500.0)], "c string, a double")
    rows = {r.category: r for r in planning.landuse_balance(df, "c", "a", 100, "green=10, school=4").collect()}
    assert (rows["Green"].balance_m2, rows["Green"].m2_capita, rows["Industry"].status) == (1000, 20, "No standard")
    rows = {r.category: r for r in planning.landuse_balance(df, "c", "a", 1000, "green=10").collect()}
    assert (rows["Green"].balance_m2, rows["Green"].status) == (-8000, "Deficit")


@pytest.mark.parametrize("total, weights, want", [(5, [1, 1, 1], [2, 2, 1]), (10, [1.2, 2.5, 0.3, 0], [3, 6, 1, 0]), (2, [0, 0, 0], [1, 1, 0]), (0, [1, 2], [0, 0])])
def test_largest_remainder(spark, total, weights, want):
    df = spark.createDataFrame([(i, float(w)) for i, w in enumerate(weights)], "i long, w double")
    assert [r.allocated for r in planning.allocate_population(df, total, "i", "w").orderBy("i").collect()] == want


def test_cohorts(spark):
    df = spark.createDataFrame([(0, "a", 100.0, 0.9, 0.0, 10.0), (1, "b", 80.0, 0.8, 0.4, 0.0), (2, "c", 60.0, 0.5, 0.1, -5.0)], "i long, age string, p double, s double, f double, m double")
    by = lambda rows, step: [r.population for r in sorted(rows, key=lambda r: r.age_group) if r.step == step]
    rows = planning.population_projection(df, "i", "age", "p", "s", "f", None, 2).collect()
    assert by(rows, 1) == pytest.approx([38, 90, 94]) and by(rows, 2) == pytest.approx([45.4, 34.2, 119])
    assert by(planning.population_projection(df, "i", "age", "p", "s", "f", "m", 1).collect(), 1) == pytest.approx([48, 90, 89])


def test_capacity_housing_and_trips(spark):
    df = spark.createDataFrame([(1000.0, 1.5, 600.0), (1000.0, 0.5, 600.0)], "a double, f double, e double")
    assert [(r.buildable_m2, r.cap_units) for r in planning.residential_capacity(df, "a", "f", "e").collect()] == [(900, 8), (0, 0)]
    r = one(planning.housing_needs(spark.createDataFrame([(10000.0, 3800.0)], "p double, s double"), "p", "s", 2.5, 0.05, 100, 50))
    assert (r.households, r.target_stock, r.need) == (4000, 4200, 550)
    r = one(planning.mode_split(spark.createDataFrame([(1.0, 15.0, 25.0)], "f double, a double, b double"), "f", ["a", "b"], [-0.1, -0.1], [0, 0], ["x", "y"]))
    assert r.share_x == pytest.approx(math.e / (math.e + 1))


def test_stress_and_seismic(spark):
    rows = [(80.0, 4.0, 9e4, "path"), (50.0, 3.0, 0.0, "LANE "), (60.0, 2.0, 0.0, "lane"), (30.0, 2.0, 500.0, "mixed"), (30.0, 2.0, 5000.0, None), (50.0, 4.0, 0.0, "x"), (70.0, 1.0, 0.0, "")]
    df = spark.createDataFrame(rows, "s double, n double, v double, k string")
    assert [r.lts for r in planning.cycling_stress(df, "s", "n", "v", "k").collect()] == [1, 2, 3, 1, 2, 3, 4]
    years = spark.createDataFrame([(1980,), (1990,), (2010,), (2020,)], "y int")
    assert [r.p for r in years.select(planning.collapse_probability(F.col("y")).alias("p")).collect()] == [0.85, 0.6, 0.25, 0.05]
    heat = spark.createDataFrame([(1.0, 0.0, 20.0), (0.0, 1.0, 0.0), (0.0, 0.0, 0.0)], "b double, g double, h double")
    found = [r.x for r in heat.select(planning.heat_risk(F.col("b"), F.col("g"), F.lit(0.0), F.col("h")).alias("x")).collect()]
    assert found == pytest.approx([100, 0, 100 / 3])


def lines(spark, pts, **more):
    rows = [(i, [{"x": float(x), "y": float(y)} for x, y in p], *[float(v[i]) for v in more.values()]) for i, p in enumerate(pts)]
    return spark.createDataFrame(rows, ", ".join(["line_id long, pts array<struct<x: double, y: double>>", *[f"{k} double" for k in more]]))


def test_graph_and_isochrone(spark):
    nodes, edges = network.build_graph(lines(spark, [[(0, 0), (1, 0)], [(1.001, 0), (2, 0)]]))
    assert (nodes.count(), edges.count()) == (3, 2)
    assert sorted(r.degree for r in network.street_nodes(nodes, edges).collect()) == [1, 1, 2]
    nodes, edges = network.build_graph(lines(spark, [[(0, 0), (100, 0)], [(100, 0), (200, 0)]]))
    starts = nodes.where("x = 0").selectExpr("node_id", "0 as start", "0.0D as offset")
    got = sorted((r.edge_id, r.from_m, r.to_m) for r in network.isochrone_edges(edges, network.nearest_source(edges, starts, 150.0), [150.0]).collect())
    assert got == [(0, 0, 100), (1, 0, 50)]
    both = nodes.where("x <> 100").selectExpr("node_id", "0 as start", "0.0D as offset")
    got = network.isochrone_edges(edges, network.nearest_source(edges, both, 80.0), [80.0]).collect()
    assert sum(r.to_m - r.from_m for r in got) == 160


def test_criticality(spark):
    pts = [[(0, 0), (1, 1)], [(1, 1), (2, 0)], [(0, 0), (1, -1)], [(1, -1), (2, 0)], [(2, 0), (3, 0)]]
    nodes, edges = network.build_graph(lines(spark, pts, cost=[1.0, 1, 1, 2, 1]), cost="cost")
    o = spark.createDataFrame([(0.0, 0.0)], "x double, y double")
    d = spark.createDataFrame([(2.0, 0.0), (3.0, 0.0)], "x double, y double")
    rows = {r.edge_id: r for r in network.link_criticality(nodes, edges, o, d).collect()}
    assert (rows[0].extra_cost, rows[0].criticality) == (2, pytest.approx(0.4))
    assert (rows[4].n_disconnected, rows[2].used_by) == (1, 0)


def test_islands(spark):
    nodes, edges = network.build_graph(lines(spark, [[(0, 0), (100, 0)], [(100, 0), (200, 0)], [(200, 0), (300, 0)]], lts=[1.0, 3, 1]), keep=["lts"])
    at = lambda t: [(r.island_id, r.island_m) for r in network.low_stress_islands(edges, "lts", t).orderBy("edge_id").collect()]
    assert at(2) == [(0, 100), (-1, 0), (1, 100)] and at(3) == [(0, 300)] * 3


def test_relaxation_like_search(spark):
    pts = [[(i, j), (i + di, j + dj)] for i in range(5) for j in range(5) for di, dj in ((1, 0), (0, 1))]
    nodes, edges = network.build_graph(lines(spark, pts, cost=[1.0 + (i * 7) % 5 for i in range(len(pts))]), cost="cost")
    sources = nodes.where("node_id % 4 = 0").select("node_id")
    a = sorted(map(tuple, network.costs_from(edges, sources, 9.0).collect()))
    assert a == sorted(map(tuple, network.costs_by_joins(edges, sources, 9.0).collect())) and a


def test_parsers():
    assert tp.parse_standards("Green = 10; school=4") == [("green", 10), ("school", 4)]
    assert tp.parse_hierarchy("2=800, 0.5=300") == [(0.5, 300), (2, 800)]
    assert tp.parse_weights("a=2, b=1", {"a"}) == ({"a": 2, "b": 1}, ["b"])
    for bad in ("green", "green=x", "green=-1", ""):
        with pytest.raises(ValueError):
            tp.parse_standards(bad)
    with pytest.raises(ValueError):
        tp.parse_rules("nothing=1", planning.LTS_RULES)
