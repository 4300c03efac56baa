"""Street operators: hand-computed cases, and nodes, numbers and growth that earlier went wrong."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from urbanloom.functions.ordered import numbered
from urbanloom.operators import allocation, network, raster, sight, siting, street


def test_samples_lie_in_the_middle_of_equal_parts(spark):
    df = spark.createDataFrame([(1, [(0.0, 0.0), (30.0, 40.0), (30.0, 40.0), (30.0, 45.0)]), (2, [(1.0, 1.0)]), (3, None)], "line_id int, pts array<struct<x: double, y: double>>")
    got = sorted(tuple(r) for r in street.road_samples(df, 25.0).collect())
    assert got == [(1, 7.5, 10.0, 25.0), (1, 22.5, 30.0, 25.0), (1, 30.0, 42.5, 5.0)]


def test_slope_profile(spark):
    df = spark.createDataFrame([(1, 0.0, 0.0), (1, 100.0, 10.0), (1, 200.0, 5.0), (2, 0.0, 3.0)], "line_id int, d double, z double")
    rows = {r.line_id: r for r in street.walking_slope(df).collect()}
    a = rows[1]
    assert (a.mean_grade, a.max_grade, a.climb, a.descent, a.grade_class) == (pytest.approx(7.5), pytest.approx(10), 10, 5, 2)
    assert a.minutes == pytest.approx(math.exp(3.5 * 0.15) + 1) and a.minutes_back == pytest.approx(math.exp(3.5 * 0.05) + math.exp(3.5 * 0.1))
    assert tuple(rows[2])[1:] == (0, 0, 0, 0, 0, 0, 1)


def test_bands_and_factors(spark):
    df = spark.createDataFrame([(9.9, 2), (10.0, 3), (25.0, 5), (None, 7)], "v double, w int")
    got = [tuple(r) for r in street.exposure_bands(df, "v", "w", (10, 20)).orderBy("band_no").collect()]
    assert got == [(0, "< 10", 2.0), (1, "10 - 20", 3.0), (2, ">= 20", 5.0)]
    row = spark.range(1).select(street.canyon_factor(F.lit(12.0), F.lit(12.0)).alias("a"), street.canyon_factor(F.lit(99.0), F.lit(0.0)).alias("b"), street.air_strength(F.lit(math.pi), F.lit(4.0)).alias("c")).first()
    assert (row.a, row.b, row.c) == (2, 3, pytest.approx(100))


def test_comfort_drops_what_is_equal(spark):
    df = spark.createDataFrame([(1, 0.0, 5.0, 1.0), (2, 10.0, 0.0, 1.0)], "id int, a double, b double, c double")
    assert [r.comfort for r in street.comfort_index(df, {"a": 1, "b": -1, "c": 1}, {"a": 3.0}).orderBy("id").collect()] == [0, 100]
    with pytest.raises(ValueError):
        street.comfort_index(df, {"c": 1})


def test_widths(spark):
    rows = [("6.5", None), ("6,5", None), ("6.5 m", "path"), ("-1", "Trunk_link "), ("x", "unknown"), (None, None), ("", "steps")]
    df = spark.createDataFrame(rows, "w string, c string")
    assert [r[0] for r in df.select(street.road_width(F.col("w"), F.col("c"), 9.0)).collect()] == [6.5, 6.5, 6.5, 25.0, 9.0, 9.0, 2.0]


def test_draws_follow_seed_and_key(spark):
    df = spark.range(2000).select("id", F.lit(0.25).alias("p"), F.lit(10.0).alias("h"), F.lit(100.0).alias("a"))
    one, again, other = ({r.id for r in street.collapsed(x, "id", "p", s).where("collapsed").collect()} for x, s in ((df, 1), (df.repartition(7), 1), (df, 2)))
    assert one == again != other and 400 < len(one) < 600
    sums = street.debris(street.collapsed(df, "id", "p", 1), "h", "a").agg(F.sum("spread_m"), F.sum("rubble_m3")).first()
    assert tuple(sums) == (pytest.approx(4.0 * len(one)), pytest.approx(300.0 * len(one)))


def test_far_points_snap_on_any_graph(spark):
    rng = np.random.default_rng(3)
    xy = rng.random((12_000, 2)) * 100
    nodes = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(xy)], "node_id long, x double, y double")
    asked = [(5000.0, 50.0), (-300.0, -900.0), (50.0, 50.0), (101.0, 99.0), (50.0, 1e6)]
    got = {(r.x, r.y): (r.node_id, r.snap_m) for r in network.nearest_node(spark.createDataFrame([*asked, (None, 1.0)], "x double, y double"), nodes).collect()}
    for p in asked:
        d = np.hypot(*(xy - p).T)
        assert got[p] == (int(d.argmin()), pytest.approx(d.min()))
    assert got[None, 1.0] == (None, None)


def test_numbered(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("v")).repartition(5)
    assert all(r.v == r.n for r in numbered(df, ["v"], "n").collect())


def test_growth_meets_its_demand_on_an_even_surface(spark):
    cells = spark.range(25).select((F.col("id") / 5).cast("int").alias("row"), (F.col("id") % 5).cast("int").alias("col"), F.when(F.col("id") == 0, float("nan")).otherwise(1.0).alias("value"))
    done = raster.grow(cells.where("row = 2 and col = 2").select("row", "col"), cells, 6, 2)
    assert done.where("year_of > 0").count() == 6 and done.where("row = 0 and col = 0").count() == 0
    assert raster.grow(cells.where("row = 2 and col = 2").select("row", "col"), cells, 99, 1).count() == 24


def test_first_fill_goes_by_suitability(spark):
    """A small parcel of high suitability comes before a large one of lower."""
    df = spark.createDataFrame([(0, 10.0, 9.0, None), (1, 100.0, 8.0, None)], "id long, area double, suit_a double, lock string")
    assert {r.id: r.alloc_use for r in allocation.land_allocation(df, {"a": 100.0}).collect()}[0] == "a"


def test_representative_days():
    assert len(sight.REPRESENTATIVE_DAYS) == 12 and sum(sight.REPRESENTATIVE_DAYS) == 177


def test_plans_filled_at_once_are_filled_alone():
    rng = np.random.default_rng(4)
    d = np.where(rng.random((6, 40)) < 0.2, np.inf, rng.integers(1, 60, (6, 40)) + rng.random((6, 40)))
    w, cap = rng.integers(1, 9, 40).astype("f8"), rng.integers(20, 60, 6).astype("f8")
    trials = rng.random((12, 6)) < 0.5
    served, cost, left = siting.trial_fills(d, w, cap, siting.cheapest_pairs(d), trials)
    for t, on in enumerate(trials):
        found, rest = siting.fill(np.where(on[:, None], d, np.inf), w, cap)
        j = np.flatnonzero(found >= 0)
        assert served[t] == pytest.approx(w[j].sum()) and cost[t] == pytest.approx((d[found[j], j] * w[j]).sum())
        assert left[t][on] == pytest.approx(rest[on])


def test_slots_end_where_no_single_exchange_helps():
    rng = np.random.default_rng(5)
    d, w, cap = rng.integers(1, 90, (8, 30)) + rng.random((8, 30)), np.ones(30), np.full(8, 9.0)
    plan = siting.SitePlan(d, w, cap, np.array([True] + [False] * 7), 3)
    while any([plan.refill(k) for k in range(3)]):
        pass
    assert len(set(plan.slots.tolist())) == 3 and 0 not in plan.slots and plan.loads().sum() == 30
    assert not any(plan.refill(k) for k in range(3))


def test_mean_grade_at_the_border_of_a_class(spark):
    # Rises are summed as given: divided by their step and multiplied by it again they give 19.666666666666664, not ...668.
    ups = [0.59] * 30
    z = [sum(ups[:i]) for i in range(31)]
    rows = spark.createDataFrame([(1, i * 3.0, float(v)) for i, v in enumerate(z)], "line_id long, d double, z double")
    want = 100 * sum(abs(b - a) for a, b in zip(z[:-1], z[1:])) / 90.0
    assert street.walking_slope(rows, (10.0, 15.0, 20.0)).first().mean_grade == want
