"""Form, syntax and route queries: parts as rectangular buildings, brands as blocks, the lattice as streets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from urbanloom.operators import form, network
from urbanloom.plans.network_queries import _TOWN_EDGES, _centres, _facilities, _town_graph, lattice, town
from urbanloom.plans.rounding import rounded
from urbanloom.sources.tables import table


def _buildings(spark: SparkSession, d: str) -> DataFrame:
    """Upright rectangles of p_size x p_size / 2 at a place that depends on the key, some with a court."""
    k, w = F.col("p_partkey"), F.col("p_size").cast("double")
    x, y, h = (k * 37 % 1999).cast("double"), (k * 53 % 1997).cast("double"), F.col("p_size") / 2.0
    at = lambda a, b: F.struct(a.alias("x"), b.alias("y"))
    ext = F.array(at(x, y), at(x + w, y), at(x + w, y + h), at(x, y + h))
    court = F.array(at(x + w / 4, y + h / 4), at(x + w / 2, y + h / 4), at(x + w / 2, y + h / 2), at(x + w / 4, y + h / 2))
    return table(spark, d, "part").select(k.alias("id"), ext.alias("ext"), F.when(k % 3 == 0, F.array(court)).alias("holes"), (k % 9 * 3.0 + 3).alias("height"), F.col("p_brand"))


def building_metrics(spark: SparkSession, d: str) -> DataFrame:
    return rounded(form.building_metrics(_buildings(spark, d)), 6)


def frontal_area(spark: SparkSession, d: str) -> DataFrame:
    return rounded(form.frontal_area(_buildings(spark, d), 0.0, 100.0), 6)


def heat_cells(spark: SparkSession, d: str) -> DataFrame:
    return rounded(form.heat_cells(_buildings(spark, d), 100.0), 6)


def spacematrix(spark: SparkSession, d: str) -> DataFrame:
    houses = _buildings(spark, d).select(F.col("p_brand").alias("block_id"), form.ring_area("ext").alias("fp"), (F.col("height") / 3).alias("levels"))
    blocks = houses.groupBy("block_id").agg((F.count(F.lit(1)) * 900.0).alias("area"))
    return rounded(form.spacematrix(blocks, houses), 6)


def street_summary(spark: SparkSession, d: str) -> DataFrame:
    nodes, edges = _town_graph(spark, d)
    return rounded(form.street_summary(nodes, edges, town(spark, d)), 6)


def space_syntax(spark: SparkSession, d: str) -> DataFrame:
    return rounded(form.space_syntax(town(spark, d), 400.0), 6)


def route_quality(spark: SparkSession, d: str) -> DataFrame:
    nodes, edges = network.build_graph(lattice(spark).withColumn("score", F.col("line_id") * 17 % 101), keep=["score"])
    found = form.route_quality(nodes, edges, _facilities(spark, d).select("id", "x", "y"), _centres(spark, d).select("id", "x", "y"))
    return rounded(found.groupBy("origin").agg(F.count(F.lit(1)).alias("n"), F.sum("shortest_m").alias("shortest_m")), 3)


def green_connectivity(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers as patches, linked with the next one where the key allows."""
    k = F.col("s_suppkey")
    s = table(spark, d, "supplier")
    patches = s.select(k.alias("id"), (k % 7 + 1.0).alias("area"))
    ends = s.where("s_suppkey % 4 > 0").select(k.alias("a"), (k + 1).alias("b")).join(s.select(k.alias("b")), "b").select("a", "b")
    return rounded(form.green_connectivity(patches, ends)[0], 6)


QUERIES = {f.__name__: f for f in (building_metrics, frontal_area, heat_cells, spacematrix, street_summary, space_syntax, route_quality, green_connectivity)}

_B = """b AS (SELECT p_partkey AS id, CAST(p_size AS DOUBLE) AS w, p_size / 2.0::DOUBLE AS h, CAST(p_partkey * 37 % 1999 AS DOUBLE) AS x, CAST(p_partkey * 53 % 1997 AS DOUBLE) AS y, p_partkey % 9 * 3.0::DOUBLE + 3 AS z, p_brand AS brand FROM part),
g AS (SELECT *, greatest(0, least(x + w, cx * 100 + 100) - greatest(x, cx * 100)) * greatest(0, least(y + h, cy * 100 + 100) - greatest(y, cy * 100)) AS s
  FROM (SELECT *, unnest(range(CAST(floor(x / 100) AS BIGINT), CAST(floor((x + w) / 100) AS BIGINT) + 1)) AS cx FROM b), LATERAL (SELECT unnest(range(CAST(floor(y / 100) AS BIGINT), CAST(floor((y + h) / 100) AS BIGINT) + 1)) AS cy)),
k AS (SELECT * FROM g WHERE s > 0)"""

ORACLES = {
    # The town is a square of streets of 100 m along both axes: one part, equal lengths in four directions.
    "street_summary": f"""WITH {_TOWN_EDGES}, g AS (SELECT node, count(*) AS g FROM (SELECT a AS node FROM e UNION ALL SELECT b FROM e) GROUP BY node),
t AS (SELECT count(*) AS n, count(*) FILTER (g = 1) AS cul, count(*) FILTER (g >= 3) AS inter, avg(g) AS deg FROM g), v AS (SELECT *, (SELECT count(*) FROM e) AS e, (SELECT s FROM side) AS s FROM t)
SELECT unnest(['nodes', 'edges', 'components', 'total_length_km', 'avg_segment_length_m', 'avg_node_degree', 'intersections_deg3plus', 'culdesac_count', 'culdesac_ratio', 'intersection_density_km2', 'alpha_meshedness', 'beta_index', 'gamma_index', 'orientation_entropy_nats', 'orientation_order']) AS metric,
  round(unnest([n, e, 1, e / 10.0::DOUBLE, 100, deg, inter, cul, cul / n, inter / ((s - 1) ^ 2 / 100.0::DOUBLE), greatest(0, (e - n + 1) / (2 * n - 5)), e / n, e / (3 * (n - 2)), ln(4), 1]::DOUBLE[]), 6) AS value FROM v""",
    # Patches k and k + 1 are linked unless 4 divides k: chains of four, which a loss cuts in two.
    "green_connectivity": """WITH p AS (SELECT s_suppkey AS id, (s_suppkey + 3) // 4 AS c, s_suppkey % 7 + 1.0::DOUBLE AS area FROM supplier),
x AS (SELECT *, sum(area) OVER (PARTITION BY c) AS big, coalesce(sum(area) OVER (PARTITION BY c ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS l FROM p),
t AS (SELECT sum(big * area) AS q FROM x)
SELECT id, CAST(dense_rank() OVER (ORDER BY c) - 1 AS INTEGER) AS comp_id, area AS area_m2, big AS comp_m2, round(100 * (big ^ 2 - l ^ 2 - (big - l - area) ^ 2) / q, 6) AS dpc FROM x, t""",
    "building_metrics": f"""WITH {_B}, c AS (SELECT *, w * h AS e, 2 * (w + h) AS p, CASE WHEN id % 3 = 0 THEN w * h / 16 ELSE 0 END AS court FROM b)
SELECT id, round(e - court, 6) AS area_m2, round(p, 6) AS perim_m, round(4 * pi() * (e - court) / p ^ 2, 6) AS compact, 1.0::DOUBLE AS convexity, 1.0::DOUBLE AS rectang, 0.5::DOUBLE AS elongation, 0.0::DOUBLE AS orient_deg,
  round(court, 6) AS court_m2, round(court / e, 6) AS court_idx, CASE WHEN p > 4 AND e > 1 THEN round(2 * ln(p / 4) / ln(e), 6) ELSE 0 END AS fractal, 4 AS corners FROM c""",
    "frontal_area": f"WITH {_B} SELECT cx, cy, count(*) AS b_count, round(sum(w * z * s / (w * h)) / 10000, 6) AS lambda_f, round(sum(s) / 10000, 6) AS lambda_p FROM k GROUP BY cx, cy",
    "heat_cells": f"WITH {_B} SELECT cx, cy, round(least(1, sum(s) / 10000), 6) AS built_frac, round(sum(s * z) / sum(s), 6) AS mean_h FROM k GROUP BY cx, cy",
    "spacematrix": f"""WITH {_B}, m AS (SELECT brand AS block_id, count(*) AS n, sum(w * h) AS fp, sum(w * h * z / 3) AS gfa, count(*) * 900.0::DOUBLE AS a FROM b GROUP BY brand),
v AS (SELECT *, fp / a AS gsi, gfa / a AS fsi FROM m)
SELECT block_id, CAST(n AS INTEGER) AS b_count, round(fp, 6) AS fp_m2, round(gfa, 6) AS gfa_m2, round(gsi, 6) AS gsi, round(fsi, 6) AS fsi, round((1 - gsi) / fsi, 6) AS osr, round(fsi / gsi, 6) AS levels,
  CASE WHEN fsi / gsi < 3 THEN 'Low-rise' WHEN fsi / gsi <= 6 THEN 'Mid-rise' ELSE 'High-rise' END || ' ' || CASE WHEN gsi >= 0.35::DOUBLE THEN 'compact' WHEN gsi >= 0.15::DOUBLE THEN 'moderate' ELSE 'spacious' END AS smx_class FROM v""",
}
