"""Service areas on the lattice of streets, and overlays of rectangles from parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from urbanloom.operators import blockage, contiguity, network, overlay
from urbanloom.operators import service_areas as sa
from urbanloom.operators import tessellation as cell_map
from urbanloom.plans.form_queries import _buildings
from urbanloom.plans.network_queries import _COSTS, _N, _centres, lattice
from urbanloom.plans.rounding import rounded
from urbanloom.sources.tables import table

BREAKS = [120.0, 260.0, 420.0]


def service_area_pieces(spark: SparkSession, d: str) -> DataFrame:
    """Reached parts of streets for each nation's place, and for all together (source null), by band."""
    _, edges = network.build_graph(lattice(spark), cost="cost", keep=["pts"])
    placed = sa.entries(edges, _centres(spark, d).select("id", "x", "y"), snap_counts=False)
    found = sa.pieces(edges, sa.reach(edges, placed, BREAKS, each=True), BREAKS)
    return rounded(found.select("source", "edge_id", "band", "lo", "hi", "len_m"), 5)


def service_area_hulls(spark: SparkSession, d: str) -> DataFrame:
    """Area and reached street length of each nation's bands, hulls as areas, with the share of the circles' area."""
    _, edges = network.build_graph(lattice(spark), cost="cost", keep=["pts"])
    placed = sa.entries(edges, _centres(spark, d).select("id", "x", "y"), snap_counts=False)
    reached = sa.reach(edges, placed, BREAKS, each=True)
    return rounded(sa.summary(placed, edges, reached, BREAKS, each=True, method="hull"), 4)


def _rectangles(spark: SparkSession, d: str) -> DataFrame:
    """Rectangles of p_size x p_size / 2 that lie over one another."""
    k, w = F.col("p_partkey"), F.col("p_size").cast("double")
    x, y, h = (k * 37 % 199).cast("double"), (k * 53 % 197).cast("double"), F.col("p_size") / 2.0
    at = lambda a, b: F.struct(a.alias("x"), b.alias("y"))
    return table(spark, d, "part").select("p_brand", F.array(at(x, y), at(x + w, y), at(x + w, y + h), at(x, y + h)).alias("ring"))


def union_footprints(spark: SparkSession, d: str) -> DataFrame:
    """The area that each brand's rectangles cover together."""
    return rounded(overlay.union_area(_rectangles(spark, d), ["p_brand"]), 5)


def polygon_density(spark: SparkSession, d: str) -> DataFrame:
    """Buildings with courts split over a grid of 100 m, their heights by area."""
    return rounded(overlay.polygon_grid(_buildings(spark, d), 100.0, "height"), 6)


def shared_walls(spark: SparkSession, d: str) -> DataFrame:
    """Terraces: parts side by side in rows, 20 m wide and p_size deep."""
    k, depth = F.col("p_partkey"), F.col("p_size").cast("double")
    x, y = (F.floor(k / 40) * 20).cast("double"), (k % 40 * 100).cast("double")
    at = lambda a, b: F.struct(a.alias("x"), b.alias("y"))
    rows = table(spark, d, "part").select(k.alias("id"), F.array(at(x, y), at(x + 20, y), at(x + 20, y + depth), at(x, y + depth)).alias("ext"), F.lit(None).cast("array<array<struct<x: double, y: double>>>").alias("holes"))
    return rounded(overlay.shared_walls(rows), 6)


def tessellation(spark: SparkSession, d: str) -> DataFrame:
    """The cells of suppliers' houses of 8 x 6 m."""
    k = F.col("s_suppkey")
    x, y = (k * 37 % 397).cast("double"), (k * 53 % 401).cast("double")
    at = lambda a, b: F.struct(a.alias("x"), b.alias("y"))
    houses = table(spark, d, "supplier").select(k.alias("id"), F.array(at(x, y), at(x + 8, y), at(x + 8, y + 6), at(x, y + 6)).alias("ext"))
    return rounded(cell_map.tessellation(houses, 0.4, 2.0, 30.0)[0], 6)


def contiguous_allocation(spark: SparkSession, d: str) -> DataFrame:
    """Each brand's parts as parcels of a grid eight wide, two uses that are one region each."""
    k = F.row_number().over(Window.partitionBy("p_brand").orderBy("p_partkey")) - 1
    parcels = table(spark, d, "part").select(F.col("p_partkey").alias("id"), "p_brand", k.alias("k"), F.lit(10.0).alias("area"), F.col("p_size").cast("double").alias("suit_homes"), (F.col("p_retailprice") % 50).alias("suit_shops"))
    # Each parcel asks for the places to its right and below, so the join is on equal places.
    beside = F.explode(F.when(F.col("k") % 8 < 7, F.array(F.col("k") + 1, F.col("k") + 8)).otherwise(F.array(F.col("k") + 8)))
    a = parcels.select(F.col("id").alias("a"), "p_brand", beside.alias("l"))
    b = parcels.select(F.col("id").alias("b"), "p_brand", F.col("k").alias("l"))
    borders = a.join(b, ["p_brand", "l"]).select("a", "b", F.lit(5.0).alias("length"))
    found = contiguity.contiguous_allocation(parcels, {"homes": 30.0, "shops": 20.0}, borders, 0.5, study="p_brand")
    return rounded(found, 6)


def blocked_streets(spark: SparkSession, d: str) -> DataFrame:
    """Every third part as a fallen building, suppliers as straight streets of 6 to 14 m."""
    k = F.col("s_suppkey")
    at = lambda a, b: F.struct(a.cast("double").alias("x"), b.cast("double").alias("y"))
    y, w = k * 59 % 1997, 6 + k % 5 * 2
    streets = table(spark, d, "supplier").select(F.array(at(F.lit(-50), y), at(F.lit(2050), y), at(F.lit(2050), y + w), at(F.lit(-50), y + w)).alias("ring"))
    houses = _buildings(spark, d).select("ext", (F.col("height") * 0.4).alias("spread_m"), (F.col("id") % 3 == 0).alias("collapsed"))
    return rounded(blockage.blockage(blockage.blocked_streets(houses, streets)), 4)


QUERIES = {f.__name__: f for f in (service_area_pieces, service_area_hulls, union_footprints, polygon_density, shared_walls, tessellation, contiguous_allocation, blocked_streets)}

_GAPS = """cut AS (SELECT DISTINCT source, edge, band, greatest(lo, 0) AS lo, least(hi, 1) AS hi FROM raw WHERE least(hi, 1) - greatest(lo, 0) > 1e-9),
m AS (SELECT *, max(hi) OVER (PARTITION BY source, edge, band ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM cut),
g AS (SELECT *, sum(CASE WHEN before IS NULL OR lo > before + 1e-9 THEN 1 ELSE 0 END) OVER (PARTITION BY source, edge, band ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS island FROM m),
i AS (SELECT source, edge, band, min(lo) AS lo, max(hi) AS hi, island FROM g GROUP BY source, edge, band, island),
inner_ AS (SELECT o.source, o.edge, o.band, o.island, o.lo AS olo, o.hi AS ohi, p.lo, p.hi FROM i o JOIN k ON TRUE JOIN i p ON p.source = o.source AND p.edge = o.edge AND p.band = k.band AND p.lo >= o.lo - 1e-9 AND p.hi <= o.hi + 1e-9
  WHERE k.band = (SELECT max(q.band) FROM k q WHERE q.band < o.band)),
gaps AS (SELECT source, edge, band, island, coalesce(lag(hi) OVER w, olo) AS lo, lo AS hi FROM inner_ WINDOW w AS (PARTITION BY source, edge, band, island ORDER BY lo)
  UNION ALL SELECT source, edge, band, island, max(hi), max(ohi) FROM inner_ GROUP BY source, edge, band, island
  UNION ALL SELECT source, edge, band, island, lo, hi FROM i WHERE NOT EXISTS (SELECT 1 FROM inner_ n WHERE n.source = i.source AND n.edge = i.edge AND n.band = i.band AND n.island = i.island))"""
_PIECES = f"""WITH {_COSTS},
z AS (SELECT CAST(n_nationkey AS BIGINT) AS source, n_nationkey * 37 % 701 + 0.25::DOUBLE AS x, n_nationkey * 53 % 701 + 0.25::DOUBLE AS y FROM nation),
s AS (SELECT edge, a, b, cost, a % 8 * 100.0::DOUBLE AS ax, a // 8 * 100.0::DOUBLE AS ay, (b - a) % 8 * 100.0::DOUBLE AS ux, (b - a) // 8 * 100.0::DOUBLE AS uy FROM e),
u AS (SELECT source, edge, x, y, ax, ay, ux, uy, least(greatest(((x - ax) * ux + (y - ay) * uy) / 10000, 0), 1) AS t FROM z, s),
f AS (SELECT source, arg_min(edge, round(sqrt((x - ax - t * ux) ^ 2 + (y - ay - t * uy) ^ 2), 9) * 1000 + edge * 1e-6) AS edge, arg_min(t, round(sqrt((x - ax - t * ux) ^ 2 + (y - ay - t * uy) ^ 2), 9) * 1000 + edge * 1e-6) AS t FROM u GROUP BY source),
st AS (SELECT source, a AS node, t * cost AS off FROM f JOIN e USING (edge) UNION ALL SELECT source, b, (1 - t) * cost FROM f JOIN e USING (edge)),
c1 AS (SELECT source, d.b AS node, min(off + d.cost) AS cost FROM st JOIN d ON d.a = st.node GROUP BY source, d.b),
c AS (SELECT * FROM c1 UNION ALL SELECT -1, node, min(cost) FROM c1 GROUP BY node),
en AS (SELECT source, edge, t FROM f UNION ALL SELECT -1, edge, t FROM f),
k AS (SELECT unnest([{", ".join(str(b) for b in BREAKS)}])::DOUBLE AS band),
raw AS (SELECT c.source, edge, band, 0.0::DOUBLE AS lo, (band - c.cost) / e.cost AS hi FROM e JOIN c ON c.node = e.a, k UNION ALL
  SELECT c.source, edge, band, 1 - (band - c.cost) / e.cost, 1 FROM e JOIN c ON c.node = e.b, k UNION ALL
  SELECT source, edge, band, t - band / cost, t + band / cost FROM en JOIN e USING (edge), k),
{_GAPS}"""

ORACLES = {
    "service_area_edges": f"""WITH {_COSTS}, {_N}, c AS (SELECT d.b AS node, min(d.cost) AS cost FROM z0 JOIN d ON d.a = z0.node GROUP BY d.b), k AS (SELECT unnest([150, 300, 500])::DOUBLE AS band),
raw AS (SELECT 0 AS source, edge, band, 0.0::DOUBLE AS lo, (band - c.cost) / e.cost AS hi FROM e JOIN c ON c.node = e.a, k UNION ALL SELECT 0, edge, band, 1 - (band - c.cost) / e.cost, 1 FROM e JOIN c ON c.node = e.b, k),
{_GAPS} SELECT band, count(*) AS pieces, round(sum((hi - lo) * 100), 6) AS length_m FROM gaps WHERE hi - lo > 1e-9 GROUP BY band""",
    # Areas of unions in slabs of x: of streets, of debris and of both together; blocked is what the sums count twice.
    "blocked_streets": """WITH s AS (SELECT 'a' AS k, -50.0::DOUBLE AS x0, 2050.0::DOUBLE AS x1, s_suppkey * 59 % 1997 * 1.0::DOUBLE AS y0, s_suppkey * 59 % 1997 + 6 + s_suppkey % 5 * 2.0::DOUBLE AS y1 FROM supplier),
b AS (SELECT 'b' AS k, p_partkey * 37 % 1999 - m AS x0, p_partkey * 37 % 1999 + p_size + m AS x1, p_partkey * 53 % 1997 - m AS y0, p_partkey * 53 % 1997 + p_size / 2.0::DOUBLE + m AS y1
  FROM (SELECT *, (p_partkey % 9 * 3.0::DOUBLE + 3) * 0.4::DOUBLE AS m FROM part) WHERE p_partkey % 3 = 0),
r AS (SELECT * FROM s UNION ALL SELECT * FROM b UNION ALL SELECT 'u', x0, x1, y0, y1 FROM s UNION ALL SELECT 'u', x0, x1, y0, y1 FROM b),
x AS (SELECT k, x, lead(x) OVER (PARTITION BY k ORDER BY x) AS z FROM (SELECT k, x0 AS x FROM r UNION SELECT k, x1 FROM r)),
a AS (SELECT x.k, x.x, x.z, y0, y1, max(y1) OVER (PARTITION BY x.k, x.x ORDER BY y0, y1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM x JOIN r ON r.k = x.k AND r.x0 <= x.x AND r.x1 >= x.z),
m AS (SELECT k, sum((z - x) * greatest(0, y1 - greatest(y0, coalesce(top, y0)))) AS m FROM a GROUP BY k),
v AS (SELECT (SELECT m FROM m WHERE k = 'a') AS a, coalesce((SELECT m FROM m WHERE k = 'b'), 0) AS b, (SELECT m FROM m WHERE k = 'u') AS u)
SELECT 'envelope' AS what, round(b, 4) AS area_m2 FROM v UNION ALL SELECT 'blocked', round(a + b - u, 4) FROM v UNION ALL SELECT 'corridors', round(u - b, 4) FROM v""",
    "service_area_pieces": _PIECES + """ SELECT CASE WHEN source >= 0 THEN source END AS source, edge AS edge_id, band, round(lo, 5) AS lo, round(hi, 5) AS hi, round((hi - lo) * 100, 5) AS len_m FROM gaps WHERE hi - lo > 1e-9""",
    "union_footprints": """WITH r AS (SELECT DISTINCT p_brand, p_partkey * 37 % 199 * 1.0::DOUBLE AS x0, p_partkey * 37 % 199 + p_size * 1.0::DOUBLE AS x1, p_partkey * 53 % 197 * 1.0::DOUBLE AS y0, p_partkey * 53 % 197 + p_size / 2.0::DOUBLE AS y1 FROM part),
x AS (SELECT p_brand, x, lead(x) OVER (PARTITION BY p_brand ORDER BY x) AS z FROM (SELECT p_brand, x0 AS x FROM r UNION SELECT p_brand, x1 FROM r)),
a AS (SELECT x.p_brand, x.x, x.z, y0, y1, max(y1) OVER (PARTITION BY x.p_brand, x.x ORDER BY y0, y1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM x JOIN r ON r.p_brand = x.p_brand AND r.x0 <= x.x AND r.x1 >= x.z)
SELECT p_brand, round(sum((z - x) * greatest(0, y1 - greatest(y0, coalesce(top, y0)))), 5) AS area FROM a GROUP BY p_brand""",
    "polygon_density": """WITH r AS (SELECT p_partkey AS k, p_partkey % 9 * 3.0::DOUBLE + 3 AS v, p_partkey * 37 % 1999 * 1.0::DOUBLE AS x, p_partkey * 53 % 1997 * 1.0::DOUBLE AS y, p_size * 1.0::DOUBLE AS w, p_size / 2.0::DOUBLE AS h FROM part),
c AS (SELECT *, unnest(range(CAST(floor(x / 100) AS BIGINT), CAST(floor((x + w) / 100) AS BIGINT) + 1)) AS i FROM r), q AS (SELECT *, unnest(range(CAST(floor(y / 100) AS BIGINT), CAST(floor((y + h) / 100) AS BIGINT) + 1)) AS j FROM c),
p AS (SELECT i, j, v, w * h - CASE WHEN k % 3 = 0 THEN w * h / 16 ELSE 0 END AS area,
  greatest(0, least(x + w, i * 100 + 100) - greatest(x, i * 100)) * greatest(0, least(y + h, j * 100 + 100) - greatest(y, j * 100)) -
  CASE WHEN k % 3 = 0 THEN greatest(0, least(x + w / 2, i * 100 + 100) - greatest(x + w / 4, i * 100)) * greatest(0, least(y + h / 2, j * 100 + 100) - greatest(y + h / 4, j * 100)) ELSE 0 END AS part FROM q),
s AS (SELECT i, j, count(*) AS n, sum(v * part / area) AS value FROM p WHERE part > 0 GROUP BY i, j), o AS (SELECT min(i) AS i0, min(j) AS j0, max(i) AS i1 FROM s)
SELECT i - i0 AS col, j - j0 AS row, (j - j0) * (i1 - i0 + 1) + i - i0 + 1 AS cell_id, n AS n_feat, round(value, 6) AS value, round(value, 6) AS dens_ha FROM s, o""",
    "shared_walls": """WITH r AS (SELECT p_partkey AS id, p_partkey // 40 AS i, p_partkey % 40 AS j, p_size * 1.0::DOUBLE AS h FROM part),
m AS (SELECT a.id, sum(least(a.h, b.h)) AS s FROM r a JOIN r b ON b.j = a.j AND abs(b.i - a.i) = 1 GROUP BY a.id)
SELECT r.id, round(coalesce(s, 0), 6) AS shared_m, round(least(1, coalesce(s, 0) / (40 + 2 * h)), 6) AS sharedwall FROM r LEFT JOIN m USING (id)""",
}
