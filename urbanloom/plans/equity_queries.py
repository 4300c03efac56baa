"""Equity queries over customers: balance as value, a small weight, market segment as group."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from urbanloom.operators import equity
from urbanloom.sources.tables import table


def _customers(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select("c_custkey", "c_acctbal", "c_mktsegment", (F.col("c_custkey") % 3 + 1).alias("people"), F.col("c_nationkey").cast("double").alias("rank_key"))


def _rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def access_equity(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(equity.access_equity(_customers(spark, d), "c_acctbal", "people", "c_mktsegment", poverty=1000.0))


def access_equity_units(spark: SparkSession, d: str) -> DataFrame:
    found = equity.access_equity_units(_customers(spark, d), "c_acctbal", "people", "c_mktsegment", poverty=1000.0)
    return _rounded(found.select("c_custkey", "eq_value", "pct_rank", "dev_mean", "poverty"))


def inequality_curve(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(equity.inequality_curve(_customers(spark, d), "c_acctbal", "people", "rank_key", "c_custkey"))


def inequality_measures(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(equity.inequality_measures(_customers(spark, d), "c_acctbal", "people", "rank_key", 0.25, "c_custkey"))


def equity_crosstab(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(equity.equity_crosstab(_customers(spark, d), "c_acctbal", "c_mktsegment", "people", 5))


_BASE = "u AS (SELECT c_custkey, c_acctbal AS x, greatest(c_acctbal, 0) AS v, c_mktsegment AS g, c_custkey % 3 + 1.0::DOUBLE AS w, c_nationkey::DOUBLE AS r FROM customer)"

_SUMMARY = f"""
WITH {_BASE},
e AS (SELECT 'ALL' AS scope, * FROM u UNION ALL SELECT g AS scope, * FROM u),
o AS (SELECT scope, x, v, w,
  coalesce(sum(w) OVER (PARTITION BY scope ORDER BY x, w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS wb,
  coalesce(sum(w * v) OVER (PARTITION BY scope ORDER BY x, w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS sb,
  sum(w) OVER (PARTITION BY scope) AS wt, sum(w * v) OVER (PARTITION BY scope) AS st FROM e),
c AS (SELECT *, (wb + w / 2) / wt AS c, v / (st / wt) AS ratio FROM o),
q AS (SELECT scope, p, max(x) FILTER (c <= p) AS lx, max(c) FILTER (c <= p) AS lc, min(x) FILTER (c >= p) AS hx, min(c) FILTER (c >= p) AS hc
  FROM c CROSS JOIN (VALUES (0.1::DOUBLE), (0.5::DOUBLE), (0.9::DOUBLE)) t(p) GROUP BY scope, p),
k AS (SELECT scope, p, CASE WHEN lx IS NULL THEN hx WHEN hx IS NULL THEN lx WHEN hc = lc THEN lx ELSE lx + (hx - lx) * (p - lc) / (hc - lc) END AS z FROM q),
s AS (SELECT scope, sum(w) AS population, sum(w * x) / sum(w) AS mean, sum(w * (v * wb - sb)) / (max(wt) * max(st)) AS gini,
  sum(CASE WHEN ratio > 0 THEN w * ratio * ln(ratio) ELSE 0 END) / sum(w) AS theil,
  sqrt(sum(w * x * x) / sum(w) - (sum(w * x) / sum(w)) ^ 2) / abs(sum(w * x) / sum(w)) AS cv,
  sum(CASE WHEN x < 1000 THEN w ELSE 0 END) / sum(w) AS pov_share, max(st) AS st FROM c GROUP BY scope),
b AS (SELECT sum(g.st / a.st * ln((g.st / g.population) / (a.st / a.population))) AS btw, sum(g.st / a.st * g.theil) AS wth FROM s g, s a WHERE g.scope <> 'ALL' AND a.scope = 'ALL')
SELECT s.scope, round(population, 6) AS population, round(mean, 6) AS mean, round(m.z, 6) AS median, round(gini, 6) AS gini, round(theil, 6) AS theil,
  CASE WHEN s.scope = 'ALL' THEN round(btw, 6) ELSE 0.0::DOUBLE END AS theil_btw, CASE WHEN s.scope = 'ALL' THEN round(wth, 6) ELSE 0.0::DOUBLE END AS theil_wth,
  round(cv, 6) AS cv, CASE WHEN l.z > 0 THEN round(h.z / l.z, 6) ELSE 0.0::DOUBLE END AS p90_p10, round(pov_share, 6) AS pov_share
FROM s, b, k m, k l, k h WHERE m.scope = s.scope AND l.scope = s.scope AND h.scope = s.scope AND m.p = 0.5 AND l.p = 0.1 AND h.p = 0.9
"""

_UNITS = f"""
WITH {_BASE}
SELECT c_custkey, round(x, 6) AS eq_value,
  round(100 * ((sum(w) OVER (ORDER BY x RANGE UNBOUNDED PRECEDING) - 0.5 * sum(w) OVER (PARTITION BY x)) / sum(w) OVER ()), 6) AS pct_rank,
  round(x - sum(w * x) OVER () / sum(w) OVER (), 6) AS dev_mean, CAST(x < 1000 AS INTEGER) AS poverty FROM u
"""

_CURVE = f"""
WITH {_BASE},
p AS (SELECT row_number() OVER o AS point, sum(w) OVER o / sum(w) OVER () AS ps, sum(w * v) OVER o / sum(w * v) OVER () AS vs FROM u
  WINDOW o AS (ORDER BY r, c_custkey ROWS UNBOUNDED PRECEDING)
  UNION ALL SELECT 0, 0, 0)
"""

_POINTS = _CURVE + "SELECT CAST(point AS INTEGER) AS point, round(ps, 6) AS pop_share, round(vs, 6) AS value_share, round(ps, 6) AS equality, round(ps - vs, 6) AS gap FROM p"

_MEASURES = _CURVE + """
, o AS (SELECT w, v, coalesce(sum(w) OVER k, 0) AS wb, coalesce(sum(w * v) OVER k, 0) AS sb FROM u WINDOW k AS (ORDER BY x, w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT sum(w) AS w, sum(w * v) AS s, sum(w * v) / sum(w) AS mu, bool_or(v <= 0) AS zero FROM u),
d AS (SELECT (ps - lag(ps) OVER (ORDER BY point)) * (vs + lag(vs) OVER (ORDER BY point)) AS a FROM p)
SELECT 'gini' AS metric, round((SELECT sum(w * (v * wb - sb)) FROM o) / (w * s), 6) AS value FROM t
UNION ALL SELECT 'atkinson_0.5', round(1 - (SELECT sum(w * sqrt(v)) FROM u) ^ 2 / w ^ 2 / mu, 6) FROM t
UNION ALL SELECT 'atkinson_0.25', round(1 - ((SELECT sum(w * v ^ 0.75) FROM u) / w) ^ (1 / 0.75) / mu, 6) FROM t
UNION ALL SELECT 'atkinson_1', CASE WHEN zero THEN 1.0::DOUBLE ELSE round(1 - exp((SELECT sum(w * ln(v)) FROM u WHERE v > 0) / w) / mu, 6) END FROM t
UNION ALL SELECT 'atkinson_2', CASE WHEN zero THEN 1.0::DOUBLE ELSE round(1 - w / (SELECT sum(w / v) FROM u WHERE v > 0) / mu, 6) END FROM t
UNION ALL SELECT 'concentration', round(1 - sum(a), 6) FROM d
"""

_CROSSTAB = f"""
WITH {_BASE},
c AS (SELECT x, (coalesce(sum(w) OVER (ORDER BY x, w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + w / 2) / sum(w) OVER () AS c FROM u),
q AS (SELECT p, max(x) FILTER (c <= p) AS lx, max(c) FILTER (c <= p) AS lc, min(x) FILTER (c >= p) AS hx, min(c) FILTER (c >= p) AS hc FROM c CROSS JOIN (SELECT range / 5.0::DOUBLE AS p FROM range(1, 5)) GROUP BY p),
e AS (SELECT CASE WHEN hc = lc THEN lx ELSE lx + (hx - lx) * (p - lc) / (hc - lc) END AS edge FROM q),
k AS (SELECT g, w, (SELECT count(*) FROM e WHERE edge < x) AS class FROM u),
cells AS (SELECT g.g, n.class, coalesce(sum(k.w), 0) AS pop FROM (SELECT DISTINCT g FROM u) g CROSS JOIN (SELECT range AS class FROM range(5)) n LEFT JOIN k ON k.g = g.g AND k.class = n.class GROUP BY ALL),
m AS (SELECT *, sum(pop) OVER (PARTITION BY class) AS c, sum(pop) OVER (PARTITION BY g) AS gp, sum(pop) OVER () AS t FROM cells)
SELECT g AS grp, CAST(class AS INTEGER) AS class, round(pop, 6) AS pop, round(pop / c, 6) AS class_share, round((pop / c) / (gp / t), 6) AS rep_ratio,
  round(0.5 * sum(abs(pop / gp - (c - pop) / (t - gp))) OVER (PARTITION BY g), 6) AS dissimilarity FROM m
"""

QUERIES = {"access_equity": access_equity, "access_equity_units": access_equity_units, "inequality_curve": inequality_curve, "inequality_measures": inequality_measures, "equity_crosstab": equity_crosstab}
ORACLES = {"access_equity": _SUMMARY, "access_equity_units": _UNITS, "inequality_curve": _POINTS, "inequality_measures": _MEASURES, "equity_crosstab": _CROSSTAB}
