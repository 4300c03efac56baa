"""Siting, raster and environment queries: parts as raster cells and buildings, suppliers and customers as points."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from urbanloom.operators import basins
from urbanloom.operators import environment as env
from urbanloom.operators import raster as ra
from urbanloom.operators import screening, sight
from urbanloom.operators import siting as st
from urbanloom.plans.rounding import rounded
from urbanloom.sources.tables import table


def _costs(spark: SparkSession, d: str) -> DataFrame:
    """Nations as sites and demand; costs on a 5 x 5 lattice of them, none beyond 45."""
    n = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("k"))
    a, b = n.select(F.col("k").alias("site")), n.select(F.col("k").alias("demand"))
    far = 10 * F.abs(F.col("site") % 5 - F.col("demand") % 5) + 10 * F.abs(F.floor(F.col("site") / 5) - F.floor(F.col("demand") / 5)) + (F.col("site") * 3 + F.col("demand") * 7) % 4
    return a.join(b, F.lit(True)).withColumn("cost", far.cast("double")).where("cost <= 45")


def _weights(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").groupBy(F.col("c_nationkey").cast("long").alias("demand")).agg(F.count(F.lit(1)).cast("double").alias("weight"))


def site_coverage(spark: SparkSession, d: str) -> DataFrame:
    return rounded(st.coverage(_costs(spark, d), _weights(spark, d), 15.0), 6)


def site_nearest(spark: SparkSession, d: str) -> DataFrame:
    return rounded(st.nearest_site(_costs(spark, d), _weights(spark, d), spark.createDataFrame([(3,), (11,), (20,)], "site long")), 6)


def max_coverage(spark: SparkSession, d: str) -> DataFrame:
    found = st.max_coverage(_costs(spark, d), _weights(spark, d), 4, 15.0)
    return rounded(spark.createDataFrame([(s, i + 1, g) for i, (s, g) in enumerate(found)], "site long, rank int, gain double"), 6)


def _capacities(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "supplier").groupBy(F.col("s_nationkey").cast("long").alias("site")).agg((F.count(F.lit(1)) * 12.0).alias("capacity"))


def p_median(spark: SparkSession, d: str) -> DataFrame:
    sites = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("site"))
    return st.p_median(_costs(spark, d), _weights(spark, d), sites, 4)


def capacitated_allocation(spark: SparkSession, d: str) -> DataFrame:
    sites = _capacities(spark, d)
    return st.capacitated_allocation(_costs(spark, d).join(sites.select("site"), "site", "left_semi"), _weights(spark, d), sites, 30.0)


def capacitated_siting(spark: SparkSession, d: str) -> DataFrame:
    sites = _capacities(spark, d)
    return st.capacitated_siting(_costs(spark, d).join(sites.select("site"), "site", "left_semi"), _weights(spark, d), sites, 3, 30.0)


def gravity_flows(spark: SparkSession, d: str) -> DataFrame:
    jobs = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("z")).agg(F.count(F.lit(1)).alias("j"))
    zones = _weights(spark, d).join(jobs, F.col("demand") == F.col("z"), "left").select(F.col("demand").alias("zone"), (F.col("weight") * 1.5).alias("production"), (F.coalesce("j", F.lit(0)) * 2.0).alias("attraction"))
    return rounded(st.gravity(_costs(spark, d).toDF("origin", "dest", "cost"), zones, 0.1, rounds=6, tolerance=0.0)[0], 4)


def _dem(spark: SparkSession, d: str) -> DataFrame:
    """A part is a cell of a raster that is 50 wide."""
    k = F.col("p_partkey")
    return table(spark, d, "part").select(F.floor(k / 50).cast("int").alias("row"), (k % 50).cast("int").alias("col"), (F.col("p_size") + k % 7 / 10.0 + k / 1000.0).alias("value"))


def flow_directions(spark: SparkSession, d: str) -> DataFrame:
    return ra.flow_directions(_dem(spark, d))


def flow_accumulation(spark: SparkSession, d: str) -> DataFrame:
    return ra.flow_accumulation(ra.flow_directions(_dem(spark, d)))


def height_above_drainage(spark: SparkSession, d: str) -> DataFrame:
    dirs = ra.flow_directions(_dem(spark, d))
    return rounded(ra.height_above_drainage(_dem(spark, d), dirs, ra.flow_accumulation(dirs).where("value >= 6")), 6)


def flood_exposure(spark: SparkSession, d: str) -> DataFrame:
    wet = ra.inundated(_dem(spark, d), 20.0)
    k = F.col("c_custkey")
    points = table(spark, d, "customer").select(F.col("c_mktsegment").alias("kind"), (k * 37 % 1000 / 10.0).alias("x"), (k * 53 % 800 / 10.0).alias("y"), (k % 4 + 1.0).alias("weight"))
    return rounded(ra.flood_exposure(wet, points, (0.0, 2.0, 0.0, 2.0)), 6)


def neighbour_share(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ra.neighbour_share(_dem(spark, d).where("value >= 25").select("row", "col")), 6)


def edge_length(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ra.edge_length(_dem(spark, d).where("value >= 25").select("row", "col"), 2.0), 6)


def sprawl_metrics(spark: SparkSession, d: str) -> DataFrame:
    mask = lambda v: _dem(spark, d).where(F.col("value") >= v).select("row", "col")
    return rounded(ra.sprawl_metrics(mask(40), mask(25), 100_000, 120_000, 10.0), 6)


def growth(spark: SparkSession, d: str) -> DataFrame:
    dem = _dem(spark, d)
    done = ra.grow(dem.where("value >= 45").select("row", "col"), dem, 50, 2)
    return done


def shadow_cells(spark: SparkSession, d: str) -> DataFrame:
    return ra.shadow(_dem(spark, d), 45.0, 90.0, 2.0, 40.0)


def sky_view(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ra.sky_view_factor(_dem(spark, d), 2.0, 8, 20.0), 6)


def sun_hours(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ra.sun_hours(_dem(spark, d), 2.0, 2026, 6, 21, 2.0, 45.0, 9.0, 120.0, 20.0), 6)


def _receivers(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    return table(spark, d, "customer").select(k.alias("id"), (k * 37 % 2001 + 0.25).alias("x"), (k * 53 % 2003 + 0.25).alias("y"))


def _sources(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    return table(spark, d, "supplier").select((k * 41 % 2011 * 1.0).alias("bx"), (k * 59 % 2017 * 1.0).alias("by"), (k * 13 % 700).cast("double").alias("volume"), (k % 20).cast("double").alias("heavy"), (k % 5).alias("category"))


def noise_receivers(spark: SparkSession, d: str) -> DataFrame:
    sources = _sources(spark, d).select("bx", "by", env.sample_level(env.traffic_level(F.col("volume"), F.col("heavy")), F.lit(10.0)).alias("level"))
    return rounded(env.noise_at(_receivers(spark, d), sources, 250.0).select("id", "db", "band"), 4)


def _blocks(spark: SparkSession, d: str) -> DataFrame:
    """Parts as upright rectangles of p_size x p_size / 2 + 3."""
    k, w, h = F.col("p_partkey"), F.col("p_size").cast("double"), F.col("p_size") / 2.0 + 3
    x, y = (k * 31 % 1999).cast("double"), (k * 47 % 1997).cast("double")
    at = lambda a, b: F.struct(a.alias("x"), b.alias("y"))
    return table(spark, d, "part").select(k.alias("building_id"), F.array(at(x, y), at(x + w, y), at(x + w, y + h), at(x, y + h)).alias("ext"), F.lit(None).cast("array<array<struct<x: double, y: double>>>").alias("holes"), (k % 9 * 3.0).alias("height"))


def noise_screened(spark: SparkSession, d: str) -> DataFrame:
    sources = _sources(spark, d).select("bx", "by", env.sample_level(env.traffic_level(F.col("volume"), F.col("heavy")), F.lit(10.0)).alias("level"))
    return rounded(screening.noise_screened(_receivers(spark, d), sources, _blocks(spark, d), 10.0, 150.0).select("id", "db", "band"), 4)


def canyon_factors(spark: SparkSession, d: str) -> DataFrame:
    """Straight roads along x at multiples of 50; walls above and below a receiver within 30."""
    at = lambda a, b: F.struct(a.cast("double").alias("x"), b.cast("double").alias("y"))
    roads = spark.range(0, 42).select(F.col("id").alias("line_id"), F.array(at(F.lit(-100), F.col("id") * 50), at(F.lit(2200), F.col("id") * 50)).alias("pts"))
    return rounded(screening.canyon_factors(_receivers(spark, d), roads, _blocks(spark, d), 20.0, 30.0), 6)


def air_receivers(spark: SparkSession, d: str) -> DataFrame:
    return rounded(env.air_at(_receivers(spark, d), _sources(spark, d).select("bx", "by", F.col("volume").alias("strength")), 2.0, 1.0, 5.0, 250.0).select("id", "index"), 6)


def kernel_density(spark: SparkSession, d: str) -> DataFrame:
    return rounded(env.kernel_density(_receivers(spark, d), _sources(spark, d).select("bx", "by", F.col("volume").alias("weight")), 200.0).select("id", "density"), 5)


def entropy_mix(spark: SparkSession, d: str) -> DataFrame:
    return rounded(env.entropy_mix(_receivers(spark, d), _sources(spark, d).select("bx", "by", "category"), 400.0).select("id", "mix_ent"), 6)


def viewshed(spark: SparkSession, d: str) -> DataFrame:
    watch = table(spark, d, "nation").select((F.col("n_nationkey") * 3 % 40).cast("int").alias("row"), (F.col("n_nationkey") * 7 % 50).cast("int").alias("col"))
    return sight.viewshed(_dem(spark, d), watch, 2.0, 1.6, 0.0, 40.0, 180)


def visual_exposure(spark: SparkSession, d: str) -> DataFrame:
    top = _dem(spark, d).where("value >= 50").select("row", "col")
    return sight.visual_exposure(_dem(spark, d), top, 2.0, 5.0, 1.6, 30.0)


def isovist_field(spark: SparkSession, d: str) -> DataFrame:
    dem = _dem(spark, d)
    walls = dem.where("value >= 40").select("row", "col")
    return rounded(sight.isovists(walls, dem.where("value < 40"), 2.0, 90, 40.0), 6)


def fill_depressions(spark: SparkSession, d: str) -> DataFrame:
    return rounded(basins.fill_depressions(_dem(spark, d), 16), 6)


def solar_irradiation(spark: SparkSession, d: str) -> DataFrame:
    return rounded(sight.irradiation(_dem(spark, d), 2.0, datetime.date(2026, 6, 21), 2.0, 45.0, 9.0, 30.0), 6)


def annual_solar(spark: SparkSession, d: str) -> DataFrame:
    return rounded(sight.annual_irradiation(_dem(spark, d), 2.0, 2026, 1.0, 45.0, 9.0, 60.0), 6)


QUERIES = {f.__name__: f for f in (viewshed, visual_exposure, isovist_field, fill_depressions, solar_irradiation, annual_solar, site_coverage, site_nearest, max_coverage, p_median, capacitated_allocation, capacitated_siting, gravity_flows, flow_directions, flow_accumulation, height_above_drainage, flood_exposure, neighbour_share, edge_length, sprawl_metrics, growth, shadow_cells, sky_view, sun_hours, noise_receivers, noise_screened, canyon_factors, air_receivers, kernel_density, entropy_mix)}

_SITES = """c AS (SELECT a.n_nationkey AS site, b.n_nationkey AS demand, CAST(10 * abs(a.n_nationkey % 5 - b.n_nationkey % 5) + 10 * abs(a.n_nationkey // 5 - b.n_nationkey // 5) + (a.n_nationkey * 3 + b.n_nationkey * 7) % 4 AS DOUBLE) AS cost FROM nation a, nation b),
w AS (SELECT CAST(c_nationkey AS BIGINT) AS demand, CAST(count(*) AS DOUBLE) AS weight FROM customer GROUP BY 1)"""
_DEM = """d AS (SELECT CAST(p_partkey // 50 AS INTEGER) AS r, CAST(p_partkey % 50 AS INTEGER) AS c, p_size + p_partkey % 7 / 10.0::DOUBLE + p_partkey / 1000.0::DOUBLE AS z FROM part)"""
_FLOW = _DEM + """, k(dr, dc, code, o) AS (VALUES (0, 1, 1, 0), (1, 1, 2, 1), (1, 0, 4, 2), (1, -1, 8, 3), (0, -1, 16, 4), (-1, -1, 32, 5), (-1, 0, 64, 6), (-1, 1, 128, 7)),
s AS (SELECT d.r, d.c, k.*, (d.z - e.z) / CASE WHEN dr * dc = 0 THEN 1 ELSE sqrt(2) END AS slope FROM d, k, d e WHERE e.r = d.r + dr AND e.c = d.c + dc),
b AS (SELECT *, row_number() OVER (PARTITION BY r, c ORDER BY slope DESC, o) AS n FROM s WHERE slope > 0),
f AS (SELECT d.r, d.c, d.z, coalesce(code, 0) AS dir, d.r + coalesce(dr, 0) AS tr, d.c + coalesce(dc, 0) AS tc FROM d LEFT JOIN b ON b.r = d.r AND b.c = d.c AND n = 1)"""
_ACC = _FLOW + """, p AS (SELECT r AS sr, c AS sc, r, c FROM d UNION ALL SELECT p.sr, p.sc, f.tr, f.tc FROM p JOIN f ON f.r = p.r AND f.c = p.c WHERE f.dir > 0), a AS (SELECT r, c, count(*) AS n FROM p GROUP BY r, c)"""
_MASK = _DEM + ", m AS (SELECT r, c FROM d WHERE z >= 25)"
_POINTS = """q AS (SELECT c_custkey AS id, c_custkey * 37 % 2001 + 0.25::DOUBLE AS x, c_custkey * 53 % 2003 + 0.25::DOUBLE AS y FROM customer),
s AS (SELECT s_suppkey * 41 % 2011 AS sx, s_suppkey * 59 % 2017 AS sy, CAST(s_suppkey * 13 % 700 AS DOUBLE) AS v, s_suppkey % 20 AS h, s_suppkey % 5 AS k FROM supplier),
n AS (SELECT *, sqrt((x - sx) ^ 2 + (y - sy) ^ 2) AS dist FROM q, s)"""



def _grown(k: int) -> str:
    """Step k of growth: of the cells not in the table before, the 25 with the highest scores."""
    return f"""n{k} AS (SELECT f.r, f.c, f.fit * (0.1::DOUBLE + (SELECT count(*) FROM u{k - 1} u WHERE abs(u.r - f.r) <= 1 AND abs(u.c - f.c) <= 1 AND (u.r <> f.r OR u.c <> f.c)) / 8.0::DOUBLE) AS score FROM f ANTI JOIN u{k - 1} u ON u.r = f.r AND u.c = f.c),
u{k} AS (SELECT * FROM u{k - 1} UNION ALL SELECT r, c, {k} FROM (SELECT * FROM n{k} ORDER BY score DESC, (r::BIGINT * 73856093 + c::BIGINT * 19349663) % 1000003, r, c LIMIT 25))"""


_PATCHES = """e AS (SELECT x.r * 50 + x.c AS a, y.r * 50 + y.c AS b FROM m x JOIN m y ON y.r BETWEEN x.r - 1 AND x.r + 1 AND abs(x.r - y.r) + abs(x.c - y.c) <= 1),
t AS (SELECT a, a AS b FROM e UNION SELECT t.a, e.b FROM t JOIN e ON e.a = t.b), s AS (SELECT root, count(*) AS n FROM (SELECT a, min(b) AS root FROM t GROUP BY a) GROUP BY root)"""

_ROUND = """r{1} AS MATERIALIZED (SELECT zone, p / greatest(coalesce(sum(f * s), 0), 1e-12) AS r FROM z LEFT JOIN (SELECT site, f, s FROM m JOIN s{0} ON s{0}.zone = m.demand) ON site = zone GROUP BY zone, p),
s{1} AS MATERIALIZED (SELECT zone, a / greatest(coalesce(sum(f * r), 0), 1e-12) AS s FROM z LEFT JOIN (SELECT demand, f, r FROM m JOIN r{1} ON r{1}.zone = m.site) ON demand = zone GROUP BY zone, a)"""
_PICK = """u{1} AS MATERIALIZED (SELECT site, sum(weight) AS gain FROM near WHERE demand NOT IN (SELECT demand FROM near JOIN t{0} USING (site)) AND site NOT IN (SELECT site FROM t{0}) GROUP BY site),
t{1} AS MATERIALIZED (SELECT * FROM t{0} UNION ALL (SELECT site, {1}, gain FROM u{1} WHERE gain > 0 ORDER BY gain DESC, site LIMIT 1))"""
_BLOCKS = "w AS (SELECT p_partkey % 9 * 3.0::DOUBLE AS h, p_partkey * 31 % 1999 AS x0, p_partkey * 31 % 1999 + p_size AS x1, p_partkey * 47 % 1997 AS y0, p_partkey * 47 % 1997 + p_size / 2.0::DOUBLE + 3 AS y1 FROM part)"
_PLACES = "c AS (SELECT c_custkey AS id, c_custkey * 37 % 2001 + 0.25::DOUBLE AS x, c_custkey * 53 % 2003 + 0.25::DOUBLE AS y FROM customer)"
ORACLES = {
    # A sight meets an upright rectangle where its parts over both ranges overlap.
    "noise_screened": f"""WITH {_BLOCKS}, {_PLACES}, s AS (SELECT s_suppkey * 41 % 2011 AS ox, s_suppkey * 59 % 2017 AS oy, s_suppkey * 13 % 700 * (1 + 0.082::DOUBLE * (s_suppkey % 20)) AS m FROM supplier),
p AS (SELECT id, x, y, ox, oy, x - ox AS dx, y - oy AS dy, m, sqrt((x - ox) ^ 2 + (y - oy) ^ 2) AS d FROM c, s WHERE m > 0 AND (x - ox) ^ 2 + (y - oy) ^ 2 <= 22500),
k AS (SELECT p.*, EXISTS (SELECT 1 FROM w WHERE greatest(0, least((x0 - ox) / dx, (x1 - ox) / dx), least((y0 - oy) / dy, (y1 - oy) / dy)) <= least(1, greatest((x0 - ox) / dx, (x1 - ox) / dx), greatest((y0 - oy) / dy, (y1 - oy) / dy))) AS hid FROM p),
v AS (SELECT id, 10 * log10(sum(10 ^ ((37.3::DOUBLE + 10 * log10(m) + 10 * log10(250 / pi()) - 20 * log10(greatest(d, 1)) - CASE WHEN hid THEN 10 ELSE 0 END) / 10))) AS db FROM k GROUP BY id),
r AS (SELECT c.id, coalesce(db, -1) AS db FROM c LEFT JOIN v USING (id))
SELECT id, round(db, 4) AS db, CASE WHEN db < 45 THEN '< 45 dB' WHEN db < 50 THEN '45 - 50 dB' WHEN db < 55 THEN '50 - 55 dB' WHEN db < 60 THEN '55 - 60 dB' WHEN db < 65 THEN '60 - 65 dB' WHEN db < 70 THEN '65 - 70 dB' WHEN db < 75 THEN '70 - 75 dB' ELSE '>= 75 dB' END AS band FROM r""",
    "canyon_factors": f"""WITH {_BLOCKS}, {_PLACES}, n AS (SELECT id, x, y, abs(y - 50 * least(41, floor(y / 50 + 0.5::DOUBLE))) <= 20 AS near FROM c),
u AS (SELECT id, avg(greatest(h, 1)) AS a FROM n JOIN w ON near AND x BETWEEN x0 AND x1 AND y1 >= y AND y0 <= y + 30 GROUP BY id),
l AS (SELECT id, avg(greatest(h, 1)) AS b FROM n JOIN w ON near AND x BETWEEN x0 AND x1 AND y1 >= y - 30 AND y0 <= y GROUP BY id)
SELECT n.id, CASE WHEN a IS NULL OR b IS NULL THEN 1.0 ELSE round(1 + least(2, (a + b) / 2 / 15), 6) END AS factor FROM n LEFT JOIN u USING (id) LEFT JOIN l USING (id)""",
    "fill_depressions": f"""WITH RECURSIVE {_DEM}, x AS (SELECT min(r) AS r0, max(r) AS r1, min(c) AS c0, max(c) AS c1 FROM d),
i AS (SELECT d.*, r IN (r0, r1) OR c IN (c0, c1) AS rim FROM d, x), o AS (SELECT unnest([-1, 0, 1]) AS v),
n AS MATERIALIZED (SELECT i.r, i.c, i.z, i.rim, i.r + p.v AS nr, i.c + q.v AS nc FROM i, o p, o q),
t AS (SELECT r, c, CASE WHEN rim THEN z ELSE 1e18 END AS l, 0 AS k FROM i UNION ALL
  SELECT n.r, n.c, CASE WHEN rim THEN z ELSE greatest(z, min(t.l)) END, any_value(t.k) + 1 FROM t JOIN n ON n.nr = t.r AND n.nc = t.c WHERE t.k < 150 GROUP BY n.r, n.c, z, rim)
SELECT r AS row, c AS col, round(l, 6) AS value FROM t WHERE k = 150""",
    "gravity_flows": f"""WITH {_SITES}, j AS (SELECT s_nationkey AS zone, count(*) AS j FROM supplier GROUP BY 1),
z0 AS (SELECT demand AS zone, weight * 1.5::DOUBLE AS p, coalesce(j, 0) * 2.0::DOUBLE AS a FROM w LEFT JOIN j ON zone = demand),
z AS (SELECT zone, p, a * (SELECT sum(p) / sum(a) FROM z0) AS a FROM z0), m AS (SELECT site, demand, cost, exp(-0.1::DOUBLE * cost) AS f FROM c WHERE cost <= 45 AND site IN (SELECT zone FROM z) AND demand IN (SELECT zone FROM z)),
s0 AS (SELECT zone, 1.0::DOUBLE AS s FROM z), {", ".join(_ROUND.format(k, k + 1) for k in range(6))}
SELECT CAST(site AS BIGINT) AS origin, CAST(demand AS BIGINT) AS dest, cost, round(r * f * s, 4) AS flow FROM m JOIN r6 ON r6.zone = site JOIN s6 ON s6.zone = demand""",
    "max_coverage": f"""WITH {_SITES}, near AS (SELECT site, demand, weight FROM c JOIN w USING (demand) WHERE cost <= 15),
t0 AS (SELECT site, 0 AS rank, 0.0::DOUBLE AS gain FROM near WHERE FALSE), {", ".join(_PICK.format(k, k + 1) for k in range(4))}
SELECT CAST(site AS BIGINT) AS site, rank, gain FROM t4""",
    "site_coverage": f"WITH {_SITES} SELECT CAST(site AS BIGINT) AS site, sum(weight) AS reach_dem FROM c JOIN w USING (demand) WHERE cost <= 15 GROUP BY site",
    "site_nearest": f"WITH {_SITES}, r AS (SELECT demand, site, cost, row_number() OVER (PARTITION BY demand ORDER BY cost, site) AS k FROM c WHERE site IN (3, 11, 20) AND cost <= 45) SELECT w.demand, weight, CAST(site AS BIGINT) AS site, cost FROM w LEFT JOIN r ON r.demand = w.demand AND k = 1",
    "flow_directions": f"WITH {_FLOW} SELECT r AS row, c AS col, dir FROM f",
    "flow_accumulation": f"WITH RECURSIVE {_ACC} SELECT r AS row, c AS col, n AS value FROM a",
    "height_above_drainage": f"""WITH RECURSIVE {_ACC}, g AS (SELECT f.*, n >= 6 OR dir = 0 AS stop FROM f JOIN a ON a.r = f.r AND a.c = f.c),
t AS (SELECT r AS sr, c AS sc, z AS sz, r, c FROM d UNION ALL SELECT t.sr, t.sc, t.sz, g.tr, g.tc FROM t JOIN g ON g.r = t.r AND g.c = t.c WHERE NOT g.stop)
SELECT sr AS row, sc AS col, round(sz - g.z, 6) AS value FROM t JOIN g ON g.r = t.r AND g.c = t.c WHERE g.stop""",
    "flood_exposure": f"""WITH {_DEM}, p AS (SELECT c_mktsegment AS kind, CAST(floor(c_custkey * 37 % 1000 / 20.0::DOUBLE) AS INTEGER) AS c, CAST(floor(c_custkey * 53 % 800 / 20.0::DOUBLE) AS INTEGER) AS r, c_custkey % 4 + 1.0::DOUBLE AS w FROM customer)
SELECT kind, count(d.z) AS exposed_n, count(*) AS total_n, sum(CASE WHEN d.z IS NULL THEN 0 ELSE w END) AS exposed_w, sum(w) AS total_w FROM p LEFT JOIN d ON d.r = p.r AND d.c = p.c AND d.z >= 0 AND d.z <= 20 GROUP BY kind""",
    "neighbour_share": f"WITH {_MASK} SELECT CAST(r AS INTEGER) AS row, CAST(c AS INTEGER) AS col, count(*) / 8.0::DOUBLE AS share FROM (SELECT r + i.range AS r, c + j.range AS c FROM m, range(-1, 2) i, range(-1, 2) j WHERE i.range <> 0 OR j.range <> 0) GROUP BY ALL",
    "sprawl_metrics": f"""WITH RECURSIVE {_MASK}, {_PATCHES}, v AS (SELECT (SELECT count(*) FROM d WHERE z >= 40) AS a, (SELECT count(*) FROM m) AS b, (SELECT count(*) FROM s) AS p, (SELECT max(n) FROM s) AS big, 10.0::DOUBLE * (4 * (SELECT count(*) FROM m) - (SELECT count(*) FROM m x, m y WHERE abs(x.r - y.r) + abs(x.c - y.c) = 1)) AS edge)
SELECT t.metric, round(t.value, 6) AS value FROM v, LATERAL (VALUES ('Urban area t1 (ha)', a / 100.0::DOUBLE), ('Urban area t2 (ha)', b / 100.0::DOUBLE), ('Urban growth (pct)', 100 * (b / a::DOUBLE - 1)), ('Population t1', 100000), ('Population t2', 120000), ('Population growth (pct)', 20),
  ('Land consumption rate (LCR)', ln(b / a::DOUBLE)), ('Population growth rate (PGR)', ln(1.2::DOUBLE)), ('LCRPGR (SDG 11.3.1)', ln(b / a::DOUBLE) / ln(1.2::DOUBLE)), ('Urban patches (t2)', p), ('Largest patch share', big / b::DOUBLE), ('Edge density (m per ha)', edge / (b / 100.0::DOUBLE))) t(metric, value)""",
    "edge_length": f"WITH {_MASK} SELECT 2.0::DOUBLE * (4 * (SELECT count(*) FROM m) - (SELECT count(*) FROM m a, m b WHERE abs(a.r - b.r) + abs(a.c - b.c) = 1)) AS edge_m",
    "growth": f"""WITH {_DEM}, b AS (SELECT min(z) AS lo, max(z) AS hi FROM d), f AS (SELECT r, c, (z - lo) / (hi - lo) AS fit FROM d, b), u0 AS (SELECT r, c, 0 AS k FROM d WHERE z >= 45),
{_grown(1)}, {_grown(2)} SELECT r AS row, c AS col, k AS year_of FROM u2""",
    "shadow_cells": f"WITH {_DEM} SELECT d.r AS row, d.c AS col, CAST(coalesce(max(e.z - 2 * (e.c - d.c)) > d.z + 0.01::DOUBLE, false) AS INTEGER) AS shadow FROM d LEFT JOIN d e ON e.r = d.r AND e.c > d.c AND e.c <= d.c + 20 GROUP BY d.r, d.c, d.z",
    "noise_receivers": f"""WITH {_POINTS}, l AS (SELECT id, 37.3::DOUBLE + 10 * log10(v * (1 + 0.082::DOUBLE * h)) + 10 * log10(25 * 10 / pi()) - 20 * log10(greatest(dist, 1)) AS level FROM n WHERE dist <= 250 AND v > 0),
z AS (SELECT q.id, coalesce(10 * log10(sum(10 ^ (level / 10))), -1) AS db FROM q LEFT JOIN l ON l.id = q.id GROUP BY q.id)
SELECT id, round(db, 4) AS db, CASE WHEN db < 45 THEN '< 45 dB' WHEN db >= 75 THEN '>= 75 dB' ELSE printf('%d - %d dB', CAST(floor(db / 5) * 5 AS INTEGER), CAST(floor(db / 5) * 5 + 5 AS INTEGER)) END AS band FROM z""",
    "air_receivers": f'WITH {_POINTS} SELECT q.id, round(coalesce(sum(v / (2 * (dist + 5))), 0), 6) AS "index" FROM q LEFT JOIN n ON n.id = q.id AND dist <= 250 GROUP BY q.id',
    "kernel_density": f"WITH {_POINTS} SELECT q.id, round(coalesce(sum(v * (1 - (dist / 200) ^ 2) ^ 2), 0), 5) AS density FROM q LEFT JOIN n ON n.id = q.id AND dist <= 200 GROUP BY q.id",
    "entropy_mix": f"""WITH {_POINTS}, g AS (SELECT id, k, count(*) AS n FROM n WHERE dist <= 400 GROUP BY id, k), t AS (SELECT id, sum(n) AS t, count(*) AS k, sum(n * ln(n)) AS s FROM g GROUP BY id)
SELECT q.id, round(CASE WHEN t.k > 1 THEN (ln(t.t) - t.s / t.t) / ln(t.k) ELSE 0 END, 6) AS mix_ent FROM q LEFT JOIN t ON t.id = q.id""",
}
