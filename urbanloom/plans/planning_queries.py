"""Standards, population, demand, stress, emission, risk and grid queries over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from urbanloom.operators import planning as op
from urbanloom.plans.rounding import rounded
from urbanloom.sources.tables import table


def landuse_balance(spark: SparkSession, d: str) -> DataFrame:
    return rounded(op.landuse_balance(table(spark, d, "part"), "p_type", "p_size", 1000.0, "economy=3, large=9, stand=90"), 4)


def residential_capacity(spark: SparkSession, d: str) -> DataFrame:
    parts = table(spark, d, "part").select("p_partkey", "p_brand", F.col("p_size") * F.lit(100.0), (F.col("p_partkey") % 5 / 2.0).alias("far"), (F.col("p_retailprice") / 2).alias("held")).toDF("p_partkey", "p_brand", "area", "far", "held")
    return rounded(op.residential_capacity(parts, "area", "far", "held").select("p_partkey", "buildable_m2", "cap_units"), 4)


def capacity_by_district(spark: SparkSession, d: str) -> DataFrame:
    parts = table(spark, d, "part").select("p_brand", (F.col("p_size") * 100.0).alias("area"), (F.col("p_partkey") % 5 / 2.0).alias("far"), (F.col("p_retailprice") / 2).alias("held"))
    return rounded(op.capacity_by_district(op.residential_capacity(parts, "area", "far", "held"), "area", "p_brand"), 3)


def allocate_population(spark: SparkSession, d: str) -> DataFrame:
    return op.allocate_population(table(spark, d, "part").select("p_partkey", "p_size"), 12345, "p_partkey", "p_size").select("p_partkey", "allocated")


def housing_needs(spark: SparkSession, d: str) -> DataFrame:
    nations = table(spark, d, "customer").groupBy("c_nationkey").agg((F.count(F.lit(1)) * 100).alias("pop"), (F.max("c_custkey") % 3000).alias("stock"))
    return rounded(op.housing_needs(nations, "pop", "stock", 2.5, 0.05, 10.0, 5.0).select("c_nationkey", "households", "target_stock", "need"), 6)


def _ages(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("n_nationkey")
    return table(spark, d, "nation").select("n_nationkey", "n_name", (1000.0 + 10 * k).alias("pop"), (0.99 - k / 100.0).alias("survival"), F.when(k.between(4, 9), 0.3).otherwise(0.0).alias("fertility"), (k % 3 - 1.0).alias("migration"))


def population_projection(spark: SparkSession, d: str) -> DataFrame:
    return rounded(op.population_projection(_ages(spark, d), "n_nationkey", "n_name", "pop", "survival", "fertility", "migration", 2), 6)


def projection_totals(spark: SparkSession, d: str) -> DataFrame:
    return rounded(op.projection_totals(op.population_projection(_ages(spark, d), "n_nationkey", "n_name", "pop", "survival", "fertility", "migration", 2)), 6)


def trip_generation(spark: SparkSession, d: str) -> DataFrame:
    pop = table(spark, d, "customer").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("pop"))
    jobs = table(spark, d, "supplier").groupBy("s_nationkey").agg(F.count(F.lit(1)).alias("jobs"))
    zones = table(spark, d, "nation").join(pop, F.col("n_nationkey") == F.col("c_nationkey"), "left").join(jobs, F.col("n_nationkey") == F.col("s_nationkey"), "left")
    return rounded(op.trip_generation(zones, "pop", "jobs").select("n_nationkey", "production", "attraction"), 2)


def mode_split(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").withColumn("transit", F.col("l_quantity") * 0.8 + 5)
    found = op.mode_split(lines, "l_extendedprice", ["l_quantity", "transit"], [-0.1, -0.08], [0.0, 0.2], ["car", "transit"])
    return rounded(found.select("l_orderkey", "l_linenumber", "l_partkey", "share_car", "share_transit", "flow_car", "flow_transit"), 4)


def _segments(spark: SparkSession, d: str) -> DataFrame:
    infra = F.when(F.col("l_returnflag") == "A", "path").when(F.col("l_returnflag") == "N", "Lane ")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_quantity").alias("length"), (F.col("l_partkey") % 70).alias("speed"), (F.col("l_linenumber") % 5).alias("lanes"), (F.col("l_suppkey") * 20).alias("aadt"), infra.alias("infra"))


def cycling_stress(spark: SparkSession, d: str) -> DataFrame:
    found = op.cycling_stress(_segments(spark, d), "speed", "lanes", "aadt", "infra")
    return found.groupBy("lts", "infra_used").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("speed_used") * F.col("lanes_used")).alias("load"))


def stress_summary(spark: SparkSession, d: str) -> DataFrame:
    return rounded(op.stress_summary(op.cycling_stress(_segments(spark, d), "speed", "lanes", "aadt", "infra"), "length"), 6)


def road_emissions(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    return rounded(op.road_emissions(lines, "l_quantity", 24.0, 0.35).drop("l_quantity"), 6)


def seismic_risk(spark: SparkSession, d: str) -> DataFrame:
    parts = table(spark, d, "part").select("p_partkey", (F.col("p_size") % 12).alias("floors"), (1960 + F.col("p_partkey") % 65).alias("year"), F.col("p_retailprice").alias("area"))
    found = op.seismic_risk(parts, "floors", "year", "area", 6.5)
    return rounded(found.select("p_partkey", "height_m", "collapse_prob", "debris_radius_m", "debris_vol_m3", "expected_vol_m3"), 4)


def landcover_change(spark: SparkSession, d: str) -> DataFrame:
    return rounded(op.landcover_change(table(spark, d, "lineitem"), "l_returnflag", "l_linestatus", 0.09), 6)


def landcover_classes(spark: SparkSession, d: str) -> DataFrame:
    return rounded(op.landcover_classes(op.landcover_change(table(spark, d, "lineitem"), "l_returnflag", "l_linestatus", 0.09)), 6)


def density_grid(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    points = table(spark, d, "customer").select((k % 97 * 10.0).alias("x"), (F.floor(k / 97) % 89 * 10.0).alias("y"), F.col("c_nationkey").alias("v"))
    return rounded(op.density_grid(points, "x", "y", 150.0, "v"), 4)


def heat_risk(spark: SparkSession, d: str) -> DataFrame:
    parts = table(spark, d, "part")
    built, green = F.col("p_size") / 50.0, F.col("p_partkey") % 7 / 14.0
    risk = op.heat_risk(built, green, F.col("p_partkey") % 3 / 10.0, F.col("p_size").cast("double"))
    return rounded(parts.select("p_partkey", risk.alias("uhi_risk")), 6)


QUERIES = {f.__name__: f for f in (landuse_balance, residential_capacity, capacity_by_district, allocate_population, housing_needs, population_projection, projection_totals, trip_generation, mode_split, cycling_stress, stress_summary, road_emissions, seismic_risk, landcover_change, landcover_classes, density_grid, heat_risk)}

_CAPACITY = "c AS (SELECT p_partkey, p_brand, p_size * 100.0::DOUBLE AS area, greatest(p_size * 100.0::DOUBLE * ((p_partkey % 5) / 2.0::DOUBLE) - p_retailprice / 2, 0) AS b FROM part)"
_AGES = """a AS (SELECT n_nationkey AS k, n_name AS g, 1000.0::DOUBLE + 10 * n_nationkey AS p, 0.99::DOUBLE - n_nationkey / 100.0::DOUBLE AS s,
  CASE WHEN n_nationkey BETWEEN 4 AND 9 THEN 0.3::DOUBLE ELSE 0 END AS f, n_nationkey % 3 - 1.0::DOUBLE AS m, max(n_nationkey) OVER () AS z, min(n_nationkey) OVER () AS y FROM nation),
"""
_STEP = "SELECT *, greatest(CASE WHEN k = y THEN sum(f * p{0}) OVER () ELSE lag(s * p{0}) OVER (ORDER BY k) END + CASE WHEN k = z THEN s * p{0} ELSE 0 END + m, 0) AS p{1} FROM {2}"
_PROJECTION = "WITH " + _AGES + "b AS (" + _STEP.format("", 1, "a") + "), c AS (" + _STEP.format("1", 2, "b") + "), r AS (SELECT 0 AS step, g, p AS v FROM c UNION ALL SELECT 1, g, p1 FROM c UNION ALL SELECT 2, g, p2 FROM c)"
_SEGMENTS = """s AS (SELECT l_quantity AS length, CAST(l_partkey % 70 AS DOUBLE) AS sp, CAST(l_linenumber % 5 AS DOUBLE) AS n, l_suppkey * 20 AS v,
  CASE WHEN l_returnflag = 'A' THEN 'path' WHEN l_returnflag = 'N' THEN 'lane' ELSE 'mixed' END AS k FROM lineitem),
l AS (SELECT *, CASE WHEN k = 'path' THEN 1 WHEN k = 'lane' THEN CASE WHEN sp <= 50 AND n <= 3 THEN 2 ELSE 3 END
  WHEN sp <= 30 AND n <= 2 AND v < 1000 THEN 1 WHEN sp <= 30 AND n <= 2 THEN 2 WHEN sp <= 50 THEN 3 ELSE 4 END AS lts FROM s)"""
_CHANGE = "SELECT l_returnflag AS from_class, l_linestatus AS to_class, count(*) AS cells, count(*) * 0.09::DOUBLE AS area_ha FROM lineitem GROUP BY ALL"

ORACLES = {
    "landuse_balance": """
WITH a AS (SELECT p_type AS category, CAST(sum(p_size) AS DOUBLE) AS area, CASE WHEN lower(p_type) LIKE '%economy%' THEN 'economy' WHEN lower(p_type) LIKE '%large%' THEN 'large' WHEN lower(p_type) LIKE '%stand%' THEN 'stand' ELSE '' END AS k FROM part GROUP BY p_type),
b AS (SELECT *, CASE k WHEN 'economy' THEN 3.0::DOUBLE WHEN 'large' THEN 9.0::DOUBLE WHEN 'stand' THEN 90.0::DOUBLE END AS per FROM a)
SELECT category, round(area, 4) AS area_m2, round(area / 1000, 4) AS m2_capita, k AS std_key, coalesce(per, 0) AS std_m2cap, coalesce(per * 1000, 0) AS required,
  CASE WHEN per IS NULL THEN 0.0::DOUBLE ELSE round(area - per * 1000, 4) END AS balance_m2, CASE WHEN per IS NULL THEN 'No standard' WHEN area - per * 1000 >= 0 THEN 'Meets standard' ELSE 'Deficit' END AS status FROM b""",
    "residential_capacity": f"WITH {_CAPACITY} SELECT p_partkey, round(b, 4) AS buildable_m2, CAST(floor(b * 0.85::DOUBLE / 90) AS BIGINT) AS cap_units FROM c",
    "capacity_by_district": f"WITH {_CAPACITY} SELECT p_brand AS district, round(sum(area), 3) AS area_m2, round(sum(b), 3) AS buildable_m2, CAST(sum(floor(b * 0.85::DOUBLE / 90)) AS BIGINT) AS cap_units FROM c GROUP BY p_brand",
    "allocate_population": """
WITH q AS (SELECT p_partkey, 12345.0::DOUBLE * (CAST(p_size AS DOUBLE) / sum(CAST(p_size AS DOUBLE)) OVER ()) AS q FROM part),
r AS (SELECT p_partkey, floor(q) AS w, row_number() OVER (ORDER BY q - floor(q) DESC, p_partkey) AS k, 12345 - sum(floor(q)) OVER () AS rest FROM q)
SELECT p_partkey, CAST(w + CASE WHEN k <= rest THEN 1 ELSE 0 END AS INTEGER) AS allocated FROM r""",
    "housing_needs": """
WITH n AS (SELECT c_nationkey, count(*) * 100 AS pop, max(c_custkey) % 3000 AS stock FROM customer GROUP BY c_nationkey)
SELECT c_nationkey, round(pop / 2.5::DOUBLE, 6) AS households, round(pop / 2.5::DOUBLE * 1.05::DOUBLE, 6) AS target_stock, round(pop / 2.5::DOUBLE * 1.05::DOUBLE - stock + 15, 6) AS need FROM n""",
    "population_projection": _PROJECTION + " SELECT step, step * 5 AS year_offset, g AS age_group, round(v, 6) AS population FROM r",
    "projection_totals": _PROJECTION + ", t AS (SELECT step, sum(v) AS v FROM r GROUP BY step) SELECT step, step * 5 AS year_offset, round(v, 6) AS population, coalesce(round(100 * (v - lag(v) OVER (ORDER BY step)) / lag(v) OVER (ORDER BY step), 6), 0) AS growth_pct FROM t",
    "trip_generation": """
SELECT n_nationkey, round((SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) * 1.5::DOUBLE, 2) AS production, round((SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) * 2.0::DOUBLE, 2) AS attraction FROM nation""",
    "mode_split": """
WITH u AS (SELECT *, -0.1::DOUBLE * l_quantity AS a, 0.2::DOUBLE - 0.08::DOUBLE * (l_quantity * 0.8::DOUBLE + 5) AS b FROM lineitem),
e AS (SELECT *, exp(a) / (exp(a) + exp(b)) AS s FROM u)
SELECT l_orderkey, l_linenumber, l_partkey, round(s, 4) AS share_car, round(1 - s, 4) AS share_transit, round(l_extendedprice * s, 4) AS flow_car, round(l_extendedprice * (1 - s), 4) AS flow_transit FROM e""",
    "cycling_stress": f"WITH {_SEGMENTS} SELECT lts, k AS infra_used, count(*) AS n, sum(sp * n) AS load FROM l GROUP BY lts, k",
    "stress_summary": f"WITH {_SEGMENTS} SELECT CAST(r.range AS INTEGER) AS lts, CASE r.range WHEN 1 THEN 'LTS 1 low stress' WHEN 2 THEN 'LTS 2 low stress' WHEN 3 THEN 'LTS 3 moderate stress' ELSE 'LTS 4 high stress' END AS label, round(coalesce(sum(length), 0), 6) AS length_m, round(100 * coalesce(sum(length), 0) / (SELECT sum(length) FROM l), 6) AS share_len, count(length) AS segments FROM range(1, 5) r LEFT JOIN l ON l.lts = r.range GROUP BY r.range",
    "road_emissions": "SELECT l_orderkey, l_linenumber, l_partkey, round(l_quantity * 24 * 0.35::DOUBLE, 6) AS emission, round(l_quantity * 24, 6) AS vol_used FROM lineitem",
    "seismic_risk": """
WITH b AS (SELECT p_partkey, greatest(p_size % 12, 1) * 3.0::DOUBLE AS h, 1960 + p_partkey % 65 AS y, p_retailprice AS a FROM part),
c AS (SELECT *, least(CASE WHEN y <= 1985 THEN 0.85::DOUBLE WHEN y <= 2000 THEN 0.6::DOUBLE WHEN y <= 2018 THEN 0.25::DOUBLE ELSE 0.05::DOUBLE END * exp(0.8::DOUBLE * -0.5::DOUBLE), 1) AS p FROM b)
SELECT p_partkey, round(h, 4) AS height_m, round(p, 4) AS collapse_prob, round(h * 0.4::DOUBLE, 4) AS debris_radius_m, round(a * h * 0.3::DOUBLE, 4) AS debris_vol_m3, round(p * (a * h * 0.3::DOUBLE), 4) AS expected_vol_m3 FROM c""",
    "landcover_change": f"SELECT from_class, to_class, cells, round(area_ha, 6) AS area_ha, CASE WHEN from_class = to_class THEN 'Persistence' ELSE 'Conversion' END AS kind FROM ({_CHANGE})",
    "landcover_classes": f"""
WITH m AS ({_CHANGE}), c AS (SELECT from_class AS class FROM m UNION SELECT to_class FROM m),
s AS (SELECT class, coalesce((SELECT sum(area_ha) FROM m WHERE from_class = class), 0) AS a, coalesce((SELECT sum(area_ha) FROM m WHERE to_class = class), 0) AS b, coalesce((SELECT sum(area_ha) FROM m WHERE to_class = class AND from_class = class), 0) AS p FROM c)
SELECT class, round(a, 6) AS t1_ha, round(b, 6) AS t2_ha, round(p, 6) AS persisted_ha, round(a - p, 6) AS lost_ha, round(b - p, 6) AS gained_ha, round(b - a, 6) AS net_ha FROM s""",
    "density_grid": """
WITH p AS (SELECT CAST(floor((c_custkey % 97) * 10.0::DOUBLE / 150) AS BIGINT) AS i, CAST(floor((c_custkey // 97 % 89) * 10.0::DOUBLE / 150) AS BIGINT) AS j, c_nationkey AS v FROM customer),
s AS (SELECT i, j, count(*) AS n, sum(v) AS v FROM p GROUP BY i, j), o AS (SELECT min(i) AS i0, min(j) AS j0, max(i) AS i1 FROM s)
SELECT i - i0 AS col, j - j0 AS row, (j - j0) * (i1 - i0 + 1) + i - i0 + 1 AS cell_id, n AS n_feat, round(CAST(v AS DOUBLE), 4) AS value, round(v / 2.25::DOUBLE, 4) AS dens_ha FROM s, o""",
    "heat_risk": """
WITH r AS (SELECT p_partkey, 0.4::DOUBLE * least(p_size / 50.0::DOUBLE, 1) + 0.2::DOUBLE * least(p_size / 20.0::DOUBLE, 1) - 0.3::DOUBLE * ((p_partkey % 7) / 14.0::DOUBLE) - 0.1::DOUBLE * ((p_partkey % 3) / 10.0::DOUBLE) AS raw FROM part)
SELECT p_partkey, round(least(greatest(100 * (raw + 0.3::DOUBLE) / 0.9::DOUBLE, 0), 100), 6) AS uhi_risk FROM r""",
}
