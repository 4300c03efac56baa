"""Audit queries: the lattice as a plan with suppliers as shops and greens, parts as land use, customers as people."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from urbanloom.operators import audit as op
from urbanloom.operators import detection, scenarios
from urbanloom.plans import network_queries as net
from urbanloom.plans import planning_queries as plan
from urbanloom.plans.rounding import rounded
from urbanloom.sources.tables import table


def plan_audit(spark: SparkSession, d: str) -> DataFrame:
    k, shops = F.col("p_partkey"), net._facilities(spark, d)
    part = table(spark, d, "part")
    relief = part.groupBy((F.floor(k / 8) % 8).cast("int").alias("row"), (k % 8).cast("int").alias("col")).agg(F.avg("p_size").alias("z"))
    greens = net._points(spark, d, "supplier", "s_suppkey", (F.col("s_suppkey") % 8).cast("double").alias("area_ha"))
    landuse = part.select(F.col("p_type").alias("category"), F.col("p_size").alias("area_m2"))
    found = op.plan_audit(
        net.lattice(spark), net._demand(spark, d), "pop", {"shop": shops, "school": net._centres(spark, d)}, 3.0, landuse, 1000.0, "economy=3, large=9, stand=90",
        shops, "capacity", 500.0, greens, "0.5=150, 2=400, 6=900", "cost", 260.0, relief, (0.0, 100.0, 0.0, 100.0))
    return rounded(found.metrics, 3)


def scenario_pipeline(spark: SparkSession, d: str) -> DataFrame:
    """Parts as a relief of 50 columns that a town grows over; only its number of places is fixed by the growth."""
    k = F.col("p_partkey")
    fit = table(spark, d, "part").select(F.floor(k / 50).cast("int").alias("row"), (k % 50).cast("int").alias("col"), (F.col("p_size") + k % 7 / 10.0 + k / 1000.0).alias("value"))
    found = op.scenario_pipeline(
        net.lattice(spark), fit.where("value >= 45").select("row", "col"), fit, 50, 1234, (0.0, 14.0, 0.0, 14.0), {"shop": net._facilities(spark, d)}, net._demand(spark, d), threshold_min=1.0, steps=2, cost="cost")
    return rounded(found.metrics, 3)


def detected_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Metrics of the result tables of other queries, which are known by their columns alone."""
    tables = {name: query(spark, d) for name, query in (("a", net.od_routes), ("b", net.access_score), ("c", plan.landuse_balance), ("d", net.facility_adequacy), ("e", plan.density_grid), ("f", net.facility_summary))}
    found = detection.metrics_of(detection.detect(tables))
    return rounded(found.select("metric_key", "value"), 2)


QUERIES = {f.__name__: f for f in (plan_audit, scenario_pipeline, detected_metrics)}

_LABELS = ", ".join(f"('{k}', '{label}')" for k, (label, _) in scenarios.METRICS.items())
_WALK = net.ORACLES["walkability"].replace("c_custkey", "s_suppkey").replace("FROM customer", "FROM supplier")

ORACLES = {
    "detected_metrics": f"""WITH acc AS ({net.ORACLES["access_score"]}), bal AS ({plan.ORACLES["landuse_balance"]}), fac AS ({net.ORACLES["facility_adequacy"]}), den AS ({plan.ORACLES["density_grid"]}),
a AS (SELECT avg(score) AS mean, median(score) AS median, 100.0::DOUBLE * count(*) FILTER (score >= 100) / count(*) AS full_, 100.0::DOUBLE * count(*) FILTER (score < 50) / count(*) AS low, count(*) AS n FROM acc),
b AS (SELECT count(*) FILTER (status <> 'No standard') AS n, count(*) FILTER (status = 'Deficit') AS short FROM bal),
f AS (SELECT count(*) AS n, count(*) FILTER (status = 'Overloaded') AS over_, count(*) FILTER (status = 'Unused') AS idle, coalesce(avg(utilization) FILTER (status <> 'Unused'), 0) AS use_ FROM fac),
e AS (SELECT avg(dens_ha) AS mean, max(dens_ha) AS top, count(*) AS n FROM den),
m AS (SELECT 'access_mean' AS k, mean AS value FROM a UNION ALL SELECT 'access_median', median FROM a UNION ALL SELECT 'access_share_full', full_ FROM a UNION ALL SELECT 'access_share_low', low FROM a UNION ALL SELECT 'origins', n FROM a
  UNION ALL SELECT 'standards_compliance_pct', 100.0::DOUBLE * (n - short) / nullif(n, 0) FROM b UNION ALL SELECT 'standards_deficits', short FROM b UNION ALL SELECT 'standards_categories', n FROM b
  UNION ALL SELECT 'covered_pop', 0 FROM f UNION ALL SELECT 'total_pop', 0 FROM f UNION ALL SELECT 'facilities', n FROM f UNION ALL SELECT 'facilities_overloaded', over_ FROM f UNION ALL SELECT 'facilities_unused', idle FROM f UNION ALL SELECT 'mean_utilization', use_ FROM f
  UNION ALL SELECT 'density_mean', mean FROM e UNION ALL SELECT 'density_max', top FROM e UNION ALL SELECT 'density_cells', n FROM e),
every_ AS (SELECT * FROM m UNION ALL SELECT 'plan_performance_index', avg(value) FROM m WHERE k IN ('access_mean', 'standards_compliance_pct', 'covered_share'))
SELECT k AS metric_key, round(round(value, 4), 2) AS value FROM every_ WHERE value IS NOT NULL""",
    "plan_audit": f"""WITH acc AS ({net.ORACLES["access_score"]}), wlk AS ({_WALK}), bal AS ({plan.ORACLES["landuse_balance"]}), fac AS ({net.ORACLES["facility_adequacy"]}), grn AS ({net.ORACLES["green_access_summary"]}),
people AS (SELECT id, id % 4 + 1.0::DOUBLE AS w, score AS v FROM acc),
runs AS (SELECT w, v, coalesce(sum(w) OVER (ORDER BY v, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS wb, coalesce(sum(w * v) OVER (ORDER BY v, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS sb FROM people),
a AS (SELECT avg(score) AS mean, median(score) AS median, 100.0::DOUBLE * count(*) FILTER (score >= 100) / count(*) AS full_, 100.0::DOUBLE * count(*) FILTER (score < 50) / count(*) AS low, count(*) AS n FROM acc),
b AS (SELECT count(*) FILTER (status <> 'No standard') AS n, count(*) FILTER (status = 'Deficit') AS short FROM bal),
f AS (SELECT count(*) AS n, count(*) FILTER (status = 'Overloaded') AS over_, count(*) FILTER (status = 'Unused') AS idle, coalesce(avg(utilization) FILTER (status <> 'Unused'), 0) AS use_, sum(assigned) AS near, (SELECT sum(w) FROM people) AS pop FROM fac),
w AS (SELECT avg(walk_score) AS mean, 100.0::DOUBLE * count(*) FILTER (walk_score < 50) / count(*) AS low FROM wlk),
m AS (SELECT 'access_mean' AS k, mean AS value FROM a UNION ALL SELECT 'access_median', median FROM a UNION ALL SELECT 'access_share_full', full_ FROM a UNION ALL SELECT 'access_share_low', low FROM a UNION ALL SELECT 'origins', n FROM a
  UNION ALL SELECT 'standards_compliance_pct', 100.0::DOUBLE * (n - short) / nullif(n, 0) FROM b UNION ALL SELECT 'standards_deficits', short FROM b UNION ALL SELECT 'standards_categories', n FROM b
  UNION ALL SELECT 'covered_share', 100 * near / pop FROM f UNION ALL SELECT 'covered_pop', near FROM f UNION ALL SELECT 'total_pop', pop FROM f UNION ALL SELECT 'facilities', n FROM f UNION ALL SELECT 'facilities_overloaded', over_ FROM f UNION ALL SELECT 'facilities_unused', idle FROM f UNION ALL SELECT 'mean_utilization', use_ FROM f
  UNION ALL SELECT 'walk_score_mean', mean FROM w UNION ALL SELECT 'walk_low_share', low FROM w UNION ALL SELECT 'green_coverage_worst', min(coverage_pct) FROM grn
  UNION ALL SELECT 'access_gini', coalesce(sum(w * (v * wb - sb)) / nullif(sum(w) * sum(w * v), 0), 0) FROM runs),
every_ AS (SELECT * FROM m UNION ALL SELECT 'plan_performance_index', avg(value) FROM m WHERE k IN ('access_mean', 'standards_compliance_pct', 'covered_share'))
SELECT k AS metric_key, label AS metric, round(round(value, 4), 3) AS value FROM every_ JOIN (VALUES {_LABELS}) t(key, label) ON k = key WHERE value IS NOT NULL""",
}
