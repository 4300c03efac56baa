"""Street queries: suppliers as roads of 100 m, customers as receivers, parts as buildings and as a relief of 50 columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from urbanloom.operators import environment as env
from urbanloom.operators import planning
from urbanloom.operators import street as op
from urbanloom.plans.rounding import rounded
from urbanloom.sources.tables import table


def _receivers(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    return table(spark, d, "customer").select(k.alias("id"), (k * 37 % 2001 + 0.25).alias("x"), (k * 53 % 2003 + 0.25).alias("y"), (k % 7 + 1).alias("people"))


def _roads(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    x, y = k * 41 % 2011 * 1.0, k * 59 % 2017 * 1.0
    pts = F.array(F.struct(x.alias("x"), y.alias("y")), F.struct((x + 60).alias("x"), (y + 80).alias("y")))
    return table(spark, d, "supplier").select(k.alias("line_id"), pts.alias("pts"), (k * 13 % 700).cast("double").alias("volume"), (k % 20).cast("double").alias("heavy"))


def noise_from_roads(spark: SparkSession, d: str) -> DataFrame:
    samples = op.road_samples(_roads(spark, d), 30.0)
    level = env.sample_level(env.traffic_level(F.col("volume"), F.col("heavy")), F.col("seg_len"))
    heard = env.noise_at(_receivers(spark, d), samples.select(F.col("x").alias("bx"), F.col("y").alias("by"), level.alias("level")), 250.0)
    return rounded(heard.select("id", "people", "db"), 4)


def noise_exposure(spark: SparkSession, d: str) -> DataFrame:
    return op.exposure_bands(noise_from_roads(spark, d), "db", "people", op.NOISE_BREAKS, "dB")


def air_from_roads(spark: SparkSession, d: str) -> DataFrame:
    strength = op.air_strength(F.col("volume") / 100, F.col("seg_len")) * op.canyon_factor(F.col("heavy"), F.lit(12.0))
    samples = op.road_samples(_roads(spark, d), 30.0).select(F.col("x").alias("bx"), F.col("y").alias("by"), strength.alias("strength"))
    return rounded(env.air_at(_receivers(spark, d), samples, 2.0, 1.0, 5.0, 250.0).select("id", "people", "index"), 6)


def air_exposure(spark: SparkSession, d: str) -> DataFrame:
    return op.exposure_bands(air_from_roads(spark, d), "index", "people", op.AIR_BREAKS)


def walking_slope(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    relief = table(spark, d, "part").select(F.floor(k / 50).alias("line_id"), (k % 50 * 10.0).alias("d"), (F.col("p_size") / 10 + k % 7 / 10.0).alias("z"))
    return rounded(op.walking_slope(relief, (10.0, 15.0, 20.0)), 6)


def street_density(spark: SparkSession, d: str) -> DataFrame:
    points = _receivers(spark, d).select(F.col("x").alias("bx"), F.col("y").alias("by"), F.col("people").alias("weight"))
    return rounded(op.street_density(_roads(spark, d).select("line_id", "pts"), points, 150.0, 30.0), 6)


def street_comfort(spark: SparkSession, d: str) -> DataFrame:
    held = _roads(spark, d).select("line_id", "volume", "heavy").withColumn("even", F.lit(1.0)).join(street_density(spark, d), "line_id")
    return rounded(op.comfort_index(held, {"density": 1, "volume": -1, "heavy": -1, "even": 1}, {"density": 2.0}).select("line_id", "comfort"), 5)


def road_widths(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    width = F.when(k % 6 == 0, F.concat(F.col("p_size").cast("string"), F.lit(" m"))).when(k % 6 == 1, F.concat(F.col("p_size").cast("string"), F.lit(",5"))).when(k % 6 == 2, "wide").when(k % 6 == 3, "-2").when(k % 6 == 4, F.concat(F.lit(" "), F.col("p_size").cast("string"), F.lit(" Metres ")))
    name = F.when(k % 4 == 0, " Primary_link").when(k % 4 == 1, "footway").when(k % 4 == 2, "alley")
    return table(spark, d, "part").select("p_partkey", op.road_width(width, name, 7.0).alias("width_m"))


def debris_extent(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    held = table(spark, d, "part").select(k, (F.greatest(F.col("p_size") % 12, F.lit(1)) * 3.0).alias("height"), planning.collapse_probability(1960 + k % 65, 6.5).alias("p"), F.col("p_retailprice").alias("area"))
    return rounded(op.debris(op.collapsed(held, "p_partkey", "p", 7), "height", "area").select("p_partkey", "collapsed", "spread_m", "rubble_m3"), 4)


QUERIES = {f.__name__: f for f in (noise_from_roads, noise_exposure, air_from_roads, air_exposure, walking_slope, street_density, street_comfort, road_widths, debris_extent)}

_ROADS = """q AS (SELECT c_custkey AS id, c_custkey * 37 % 2001 + 0.25::DOUBLE AS x, c_custkey * 53 % 2003 + 0.25::DOUBLE AS y, c_custkey % 7 + 1 AS people FROM customer),
s AS (SELECT s_suppkey AS line_id, s_suppkey * 41 % 2011 + 60 * (g.range + 0.5::DOUBLE) / 4 AS sx, s_suppkey * 59 % 2017 + 80 * (g.range + 0.5::DOUBLE) / 4 AS sy, CAST(s_suppkey * 13 % 700 AS DOUBLE) AS v, s_suppkey % 20 AS h FROM supplier, range(4) g),
n AS (SELECT *, sqrt((x - sx) ^ 2 + (y - sy) ^ 2) AS dist FROM q, s)"""
_NOISE = _ROADS + """, l AS (SELECT id, 37.3::DOUBLE + 10 * log10(v * (1 + 0.082::DOUBLE * h)) + 10 * log10(25 * 25 / pi()) - 20 * log10(greatest(dist, 1)) AS level FROM n WHERE dist <= 250 AND v > 0),
z AS (SELECT q.id, q.people, round(coalesce(10 * log10(sum(10 ^ (level / 10))), -1), 4) AS db FROM q LEFT JOIN l ON l.id = q.id GROUP BY q.id, q.people)"""
_AIR = _ROADS + """, z AS (SELECT q.id, q.people, round(coalesce(sum(v / 100 * 25 * 25 / pi() * (1 + least(2, h / 12.0::DOUBLE)) / (2 * (dist + 5))), 0), 6) AS "index" FROM q LEFT JOIN n ON n.id = q.id AND dist <= 250 GROUP BY q.id, q.people)"""
_DENSITY = _ROADS + """, w AS (SELECT s_suppkey AS line_id, round(coalesce((SELECT sum(people * exp(-4.5::DOUBLE * (dist / 150) ^ 2)) FROM n WHERE n.line_id = s_suppkey AND dist <= 150), 0) / 4, 6) AS density FROM supplier)"""


def _bands(level: str, breaks: tuple[float, ...], unit: str) -> str:
    edges = [None, *breaks, None]
    rows = []
    for k, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
        name = f"< {b:g}{unit}" if a is None else f">= {a:g}{unit}" if b is None else f"{a:g} - {b:g}{unit}"
        rows.append(f"SELECT {k} AS band_no, '{name}' AS band, coalesce(sum(people), 0)::DOUBLE AS total FROM z WHERE " + " AND ".join([f'"{level}" >= {a}'] * (a is not None) + [f'"{level}" < {b}'] * (b is not None)))
    return " UNION ALL ".join(rows)


ORACLES = {
    "noise_from_roads": f"WITH {_NOISE} SELECT id, people, db FROM z",
    "noise_exposure": f"WITH {_NOISE} {_bands('db', op.NOISE_BREAKS, ' dB')}",
    "air_from_roads": f'WITH {_AIR} SELECT id, people, "index" FROM z',
    "air_exposure": f"WITH {_AIR} {_bands('index', op.AIR_BREAKS, '')}",
    "walking_slope": """
WITH r AS (SELECT p_partkey // 50 AS line_id, p_partkey % 50 * 10.0::DOUBLE AS d, p_size / 10.0::DOUBLE + p_partkey % 7 / 10.0::DOUBLE AS z FROM part),
s AS (SELECT line_id, lead(d) OVER w - d AS l, lead(z) OVER w - z AS up FROM r WINDOW w AS (PARTITION BY line_id ORDER BY d)),
a AS (SELECT line_id, coalesce(100 * sum(abs(up)) / sum(l), 0) AS mean, coalesce(100 * max(abs(up / l)), 0) AS most, coalesce(sum(greatest(up, 0)), 0) AS climb, coalesce(sum(greatest(-up, 0)), 0) AS descent,
coalesce(sum(l * 0.01::DOUBLE * exp(3.5::DOUBLE * abs(up / l + 0.05::DOUBLE))), 0) AS there, coalesce(sum(l * 0.01::DOUBLE * exp(3.5::DOUBLE * abs(0.05::DOUBLE - up / l))), 0) AS back FROM s GROUP BY line_id)
SELECT line_id, round(mean, 6) AS mean_grade, round(most, 6) AS max_grade, round(climb, 6) AS climb, round(descent, 6) AS descent, round(there, 6) AS minutes, round(back, 6) AS minutes_back, CASE WHEN mean <= 10 THEN 1 WHEN mean <= 15 THEN 2 WHEN mean <= 20 THEN 3 ELSE 4 END AS grade_class FROM a""",
    "street_density": f"WITH {_DENSITY} SELECT line_id, density FROM w",
    "street_comfort": f"""WITH {_DENSITY}, u AS (SELECT w.line_id, density, CAST(w.line_id * 13 % 700 AS DOUBLE) AS v, CAST(w.line_id % 20 AS DOUBLE) AS h FROM w),
m AS (SELECT min(density) AS d0, max(density) AS d1, min(v) AS v0, max(v) AS v1, min(h) AS h0, max(h) AS h1 FROM u)
SELECT line_id, round(100 * (2 * (density - d0) / (d1 - d0) + (v1 - v) / (v1 - v0) + (h1 - h) / (h1 - h0)) / 4, 5) AS comfort FROM u, m""",
    "road_widths": """SELECT p_partkey, CASE WHEN p_partkey % 6 IN (0, 4) THEN p_size WHEN p_partkey % 6 = 1 THEN p_size + 0.5::DOUBLE WHEN p_partkey % 4 = 0 THEN 18 WHEN p_partkey % 4 = 1 THEN 3 ELSE 7 END::DOUBLE AS width_m FROM part""",
    "debris_extent": """
WITH b AS (SELECT p_partkey, greatest(p_size % 12, 1) * 3.0::DOUBLE AS h, 1960 + p_partkey % 65 AS y, p_retailprice AS a FROM part),
c AS (SELECT *, least(CASE WHEN y <= 1985 THEN 0.85::DOUBLE WHEN y <= 2000 THEN 0.6::DOUBLE WHEN y <= 2018 THEN 0.25::DOUBLE ELSE 0.05::DOUBLE END * exp(0.8::DOUBLE * -0.5::DOUBLE), 1) AS p, CAST('0x' || substr(md5('7|' || p_partkey), 1, 13) AS BIGINT) / 4503599627370496.0::DOUBLE AS u FROM b)
SELECT p_partkey, u < p AS collapsed, round(CASE WHEN u < p THEN h * 0.4::DOUBLE ELSE 0 END, 4) AS spread_m, round(CASE WHEN u < p THEN a * h * 0.3::DOUBLE ELSE 0 END, 4) AS rubble_m3 FROM c""",
}
