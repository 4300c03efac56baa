"""Timetable queries over events (a user is a stop, an event type a route) and scenario queries over orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from urbanloom.operators import network, scenarios, transit
from urbanloom.plans import network_queries as net
from urbanloom.plans.rounding import rounded
from urbanloom.sources.tables import table


def _times(spark: SparkSession, d: str) -> DataFrame:
    """An order is a trip, its line items call at one of 97 stops, some minutes apart."""
    key = F.col("l_orderkey")
    start = key * 9973 % 72000 + 14400
    items = table(spark, d, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("seq")).dropDuplicates(["l_orderkey", "seq"])
    stop = (F.col("l_orderkey") * 7 + F.col("seq") * 11) % 97
    return items.select(F.col("l_orderkey").alias("trip_id"), (F.col("l_orderkey") % 9).alias("route_id"), stop.alias("stop_id"), "seq", (start + F.col("seq") * 300).alias("arr"), (start + F.col("seq") * 300 + 30).alias("dep"), (F.col("l_orderkey") % 3).alias("service_id"))


def _day(spark: SparkSession, d: str) -> DataFrame:
    rows = _times(spark, d)
    trips = rows.select("trip_id", "route_id", "service_id").distinct()
    services = spark.createDataFrame([(0,), (1,)], "service_id long")
    return transit.day_times(trips, rows.select("trip_id", "stop_id", "seq", "arr", "dep"), services)


def transit_frequency(spark: SparkSession, d: str) -> DataFrame:
    return rounded(transit.stop_frequencies(_day(spark, d), 7 * 3600, 9 * 3600), 6)


def transit_routes(spark: SparkSession, d: str) -> DataFrame:
    return transit.route_trips(_day(spark, d), 7 * 3600, 9 * 3600)


def transit_route_statistics(spark: SparkSession, d: str) -> DataFrame:
    return transit.route_statistics(_day(spark, d))


def transit_arrival(spark: SparkSession, d: str) -> DataFrame:
    access = spark.createDataFrame([(3, 28800), (4, 28900)], "stop_id long, at long")
    return transit.earliest_arrival(_day(spark, d), access, 2)


def transit_access(spark: SparkSession, d: str) -> DataFrame:
    """From the regions' places to customers at 8:00, a slow walker on the lattice, stops spread over it."""
    nodes, edges = network.build_graph(net.lattice(spark))
    k = F.col("id")
    stops = spark.range(97).select(k.alias("stop_id"), (k * 37 % 701 + 0.25).alias("x"), (k * 53 % 701 + 0.25).alias("y"))
    origins = net._points(spark, d, "region", "r_regionkey")
    found = transit.door_to_door(nodes, edges, _day(spark, d), stops, origins, net._points(spark, d, "customer", "c_custkey"), 28800.0, 1.2, 25.0, 1)
    return rounded(found.drop("x", "y"), 4)


def _metrics(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("scenario")).agg(
        F.avg("o_totalprice").alias("access_mean"), F.avg((F.col("o_orderstatus") == "F").cast("double")).alias("covered_share"),
        F.count(F.lit(1)).cast("double").alias("facilities_overloaded"), F.max("o_totalprice").alias("total_pop"), F.lit(1.0).alias("access_median"))
    return o.selectExpr("scenario", "stack(5, 'access_mean', access_mean, 'covered_share', covered_share, 'facilities_overloaded', facilities_overloaded, 'total_pop', total_pop, 'access_median', access_median) as (metric, value)")


def scenario_compare(spark: SparkSession, d: str) -> DataFrame:
    return rounded(scenarios.compare(_metrics(spark, d), "1-URGENT", "2-HIGH"), 4)


def scenario_rank(spark: SparkSession, d: str) -> DataFrame:
    return rounded(scenarios.rank(_metrics(spark, d), {"access_mean": 2.0}), 6)


def scenario_detail(spark: SparkSession, d: str) -> DataFrame:
    return rounded(scenarios.rank_detail(_metrics(spark, d), {"access_mean": 2.0}), 4)


QUERIES = {f.__name__: f for f in (transit_frequency, transit_routes, transit_route_statistics, transit_arrival, transit_access, scenario_compare, scenario_rank, scenario_detail)}

_TIMES = """i AS (SELECT DISTINCT l_orderkey AS o, l_linenumber AS seq FROM lineitem WHERE l_orderkey % 3 < 2),
t AS (SELECT o AS trip, o % 9 AS route, (o * 7 + seq * 11) % 97 AS stop, seq, o * 9973 % 72000 + 14400 + seq * 300 AS arr, o * 9973 % 72000 + 14430 + seq * 300 AS dep, seq = max(seq) OVER (PARTITION BY o) AS last FROM i),
w AS (SELECT * FROM t WHERE NOT last AND dep >= 25200 AND dep < 32400)"""
_ROUND = """b{1} AS (SELECT t.trip, min(t.seq) AS s FROM t JOIN r{0} r ON r.stop = t.stop AND t.dep >= r.arrival GROUP BY t.trip),
r{1} AS (SELECT stop, min(arrival) AS arrival FROM (SELECT * FROM r{0} UNION ALL SELECT t.stop, t.arr FROM t JOIN b{1} b ON b.trip = t.trip AND t.seq > b.s) GROUP BY stop)"""
_METRICS = """o AS (SELECT o_orderpriority AS s, avg(o_totalprice) AS a, avg(CASE WHEN o_orderstatus = 'F' THEN 1.0::DOUBLE ELSE 0 END) AS b, CAST(count(*) AS DOUBLE) AS c, max(o_totalprice) AS d FROM orders GROUP BY 1),
m AS (SELECT s, 'access_mean' AS metric, a AS value, 1 AS direction, 2.0::DOUBLE AS weight, 'Accessibility score (mean)' AS label FROM o UNION ALL SELECT s, 'covered_share', b, 1, 1, 'Population covered (%)' FROM o UNION ALL SELECT s, 'facilities_overloaded', c, -1, 1, 'Overloaded facilities' FROM o
  UNION ALL SELECT s, 'total_pop', d, 0, 1, 'Total population' FROM o UNION ALL SELECT s, 'access_median', 1, 1, 1, 'Accessibility score (median)' FROM o),
n AS (SELECT *, CASE WHEN direction = 1 THEN value - lo ELSE hi - value END / (hi - lo) AS norm FROM (SELECT *, min(value) OVER (PARTITION BY metric) AS lo, max(value) OVER (PARTITION BY metric) AS hi FROM m) WHERE direction <> 0 AND lo < hi)"""

ORACLES = {
    "transit_frequency": f"WITH {_TIMES} SELECT stop AS stop_id, count(*) AS departures, round(count(*) / 2.0::DOUBLE, 6) AS per_hour, round(120.0::DOUBLE / count(*), 6) AS headway_min, count(DISTINCT route) AS n_routes FROM w GROUP BY stop",
    "transit_routes": f"WITH {_TIMES} SELECT route AS route_id, count(DISTINCT trip) AS trips_in_window FROM w GROUP BY route",
    "transit_route_statistics": f"WITH {_TIMES} SELECT route AS route_id, count(DISTINCT trip) AS n_trips, printf('%02d:%02d', min(dep) // 3600, min(dep) // 60 % 60) AS first_dep, printf('%02d:%02d', max(arr) // 3600, max(arr) // 60 % 60) AS last_arr, count(DISTINCT stop) AS n_stops FROM t GROUP BY route",
    "transit_arrival": f"WITH {_TIMES}, r0 AS (SELECT 3 AS stop, 28800 AS arrival UNION ALL SELECT 4, 28900), {_ROUND.format(0, 1)}, {_ROUND.format(1, 2)}, {_ROUND.format(2, 3)} SELECT stop AS stop_id, arrival FROM r3",
    "transit_access": f"""WITH {_TIMES},
g AS (SELECT *, floor(x / 100 + 0.5::DOUBLE) AS c, floor(y / 100 + 0.5::DOUBLE) AS r FROM (SELECT 's' AS kind, range AS id, range * 37 % 701 + 0.25::DOUBLE AS x, range * 53 % 701 + 0.25::DOUBLE AS y FROM range(97)
  UNION ALL SELECT 'o', r_regionkey, r_regionkey * 37 % 701 + 0.25::DOUBLE, r_regionkey * 53 % 701 + 0.25::DOUBLE FROM region UNION ALL SELECT 'c', c_custkey, c_custkey * 37 % 701 + 0.25::DOUBLE, c_custkey * 53 % 701 + 0.25::DOUBLE FROM customer)),
f AS (SELECT p.kind, p.id, p.c, p.r, 3 * sqrt((p.x - 100 * p.c) ^ 2 + (p.y - 100 * p.r) ^ 2) AS snap, min(300 * (abs(p.c - o.c) + abs(p.r - o.r))) AS walk FROM g p JOIN g o ON o.kind = 'o' WHERE p.kind <> 'o' GROUP BY ALL),
r0 AS (SELECT id AS stop, 28800 + walk + snap AS arrival FROM f WHERE kind = 's' AND walk + snap <= 1500),
{_ROUND.format(0, 1)}, {_ROUND.format(1, 2)},
z AS (SELECT q.id, q.walk / 60 AS walk, (min(r2.arrival + s.snap + 300 * (abs(q.c - s.c) + abs(q.r - s.r))) - 28800) / 60 AS ride FROM f q LEFT JOIN (f s JOIN r2 ON r2.stop = s.id AND s.kind = 's') ON TRUE WHERE q.kind = 'c' GROUP BY q.id, q.walk)
SELECT id, round(walk, 4) AS walk_min, round(ride, 4) AS transit_min, round(least(walk, ride), 4) AS best_min, CASE WHEN ride < walk THEN round(walk - ride, 4) ELSE 0 END AS saved_min, CASE WHEN ride < walk THEN 'Transit' ELSE 'Walk' END AS mode FROM z""",
    "scenario_compare": f"""WITH {_METRICS}, p AS (SELECT x.metric, x.label, x.value AS a, y.value AS b, x.direction AS direction FROM m x JOIN m y ON x.metric = y.metric WHERE x.s = '1-URGENT' AND y.s = '2-HIGH')
SELECT metric, label, round(a, 4) AS a, round(b, 4) AS b, round(b - a, 4) AS delta, round(100 * (b - a) / abs(a), 4) AS delta_pct, direction, CASE WHEN direction = 0 THEN 'n/a' WHEN b = a THEN 'tie' WHEN (b - a) * direction > 0 THEN 'B' ELSE 'A' END AS better FROM p""",
    "scenario_rank": f"""WITH {_METRICS}, w AS (SELECT *, count(*) FILTER (norm = 1) OVER (PARTITION BY metric) AS best FROM n),
z AS (SELECT s, 100 * sum(weight * norm) / sum(weight) AS score, sum(CASE WHEN norm = 1 AND best = 1 THEN 1 ELSE 0 END) AS wins, count(*) AS n FROM w GROUP BY s)
SELECT CAST(rank() OVER (ORDER BY score DESC) AS INTEGER) AS rank, s AS scenario, round(score, 6) AS score, CAST(wins AS INTEGER) AS wins, CAST(n AS INTEGER) AS n_metrics FROM z""",
    "scenario_detail": f"WITH {_METRICS} SELECT metric, label, direction, weight, s AS scenario, round(value, 4) AS value, round(norm, 4) AS norm FROM n",
}
