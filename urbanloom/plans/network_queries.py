"""Network queries on a lattice of streets; points come from suppliers, customers and parts.

Measures of streets alone run on a town of suppliers that grows with the table, the others on 8 x 8 points.
The SQL oracles get all shortest costs by squaring the cost matrix five times (paths of up to 32 streets).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from urbanloom.operators import network as op
from urbanloom.operators import noding, walkability as walk
from urbanloom.plans.rounding import rounded
from urbanloom.sources.tables import table

SIDE = 8


def lattice(spark: SparkSession, at: DataFrame | None = None, side: int = SIDE) -> DataFrame:
    """Lines to the right and upper neighbour of each lattice point, with costs, stress levels and their ends."""
    at = (spark.range(side * side) if at is None else at).select((F.col("id") % side).alias("c"), F.floor(F.col("id") / side).alias("r"), "id")
    point = lambda x, y: F.struct((x * 100.0).alias("x"), (y * 100.0).alias("y"))
    right = at.where(F.col("c") < side - 1).select((2 * F.col("id")).alias("line_id"), F.array(point(F.col("c"), F.col("r")), point(F.col("c") + 1, F.col("r"))).alias("pts"), "c", "r", "id", F.lit(0).alias("up"))
    up = at.where(F.col("r") < side - 1).select((2 * F.col("id") + 1).alias("line_id"), F.array(point(F.col("c"), F.col("r")), point(F.col("c"), F.col("r") + 1)).alias("pts"), "c", "r", "id", F.lit(1).alias("up"))
    cost = 100.0 + (F.col("c") * 7 + F.col("r") * 13 + F.col("up") * 3) % 11 * 7.5
    return right.unionByName(up).select("line_id", "pts", cost.alias("cost"), ((F.col("id") * 5 + F.col("up")) % 7 / 2 + 1).alias("lts"))


def town(spark: SparkSession, d: str) -> DataFrame:
    """Streets between suppliers, who live on the points of a square lattice that grows with their number."""
    suppliers = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"))
    side = int(suppliers.count() ** 0.5)
    return lattice(spark, suppliers.where(F.col("id") < side * side), side)


def _town_graph(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return op.build_graph(town(spark, d), cost="cost", keep=["lts"])


def _points(spark: SparkSession, d: str, name: str, key: str, *more) -> DataFrame:
    k = F.col(key)
    return table(spark, d, name).select(k.alias("id"), (k * 37 % 701 + 0.25).alias("x"), (k * 53 % 701 + 0.25).alias("y"), *more)


def _graph(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    return op.build_graph(lattice(spark), cost="cost", keep=["lts"])


def _facilities(spark: SparkSession, d: str) -> DataFrame:
    return _points(spark, d, "supplier", "s_suppkey", F.col("s_suppkey").alias("pos"), (F.col("s_acctbal") / 100).alias("capacity"))


def _centres(spark: SparkSession, d: str) -> DataFrame:
    return _points(spark, d, "nation", "n_nationkey", F.col("n_nationkey").alias("pos"))


def _demand(spark: SparkSession, d: str) -> DataFrame:
    return _points(spark, d, "customer", "c_custkey", (F.col("c_custkey") % 4 + 1).alias("pop"))


def od_matrix(spark: SparkSession, d: str) -> DataFrame:
    nodes, edges = _graph(spark)
    return op.od_matrix(nodes, edges, _facilities(spark, d).select("id", "x", "y"), cutoff=900.0, digits=6)


def costs_by_joins(spark: SparkSession, d: str) -> DataFrame:
    nodes, edges = _graph(spark)
    starts = op.nearest_node(_centres(spark, d).select("id", "x", "y"), nodes).select("node_id").distinct()
    found = op.costs_by_joins(edges, starts, 600.0)
    ends = nodes.select("node_id", "x", "y")
    return rounded(found.join(ends.toDF("source", "sx", "sy"), "source").join(ends.toDF("node", "nx", "ny"), "node").select("sx", "sy", "nx", "ny", "cost"), 6)


def od_routes(spark: SparkSession, d: str) -> DataFrame:
    nodes, edges = _graph(spark)
    near = op.od_routes(nodes, edges, _facilities(spark, d).select("id", "x", "y"), _centres(spark, d).select("id", "x", "y"), 3)
    return rounded(near.select("origin_id", "dest_id", "k", "net_cost"), 6)


def nearest_facility(spark: SparkSession, d: str) -> DataFrame:
    nodes, edges = _graph(spark)
    return rounded(op.nearest_facility(nodes, edges, _demand(spark, d), _facilities(spark, d), 500.0).select("id", "facility", "net_cost"), 6)


def facility_summary(spark: SparkSession, d: str) -> DataFrame:
    nodes, edges = _graph(spark)
    f = _facilities(spark, d)
    return rounded(op.facility_summary(op.nearest_facility(nodes, edges, _demand(spark, d), f, 500.0), f), 6)


def facility_adequacy(spark: SparkSession, d: str) -> DataFrame:
    nodes, edges = _graph(spark)
    f = _facilities(spark, d)
    return rounded(op.facility_adequacy(op.nearest_facility(nodes, edges, _demand(spark, d), f, 500.0), f, "pop", "capacity"), 6)


def access_score(spark: SparkSession, d: str) -> DataFrame:
    nodes, edges = _graph(spark)
    found = op.access_score(nodes, edges, _demand(spark, d), {"shop": _facilities(spark, d), "school": _centres(spark, d)}, 4.8, 3.0)
    return rounded(found.select("id", "t_shop", "t_school", "n_reach", "score"), 2)


def green_access_summary(spark: SparkSession, d: str) -> DataFrame:
    nodes, edges = _graph(spark)
    greens = _points(spark, d, "supplier", "s_suppkey", (F.col("s_suppkey") % 8).cast("double").alias("area_ha"))
    return rounded(op.green_access(nodes, edges, _demand(spark, d), greens, [(0.5, 150.0), (2.0, 400.0), (6.0, 900.0)], "pop")[1], 6)


def street_nodes(spark: SparkSession, d: str) -> DataFrame:
    nodes, edges = _town_graph(spark, d)
    found = op.street_nodes(nodes, edges).join(nodes, "node_id")
    return found.select("x", "y", "degree", "node_type")


def low_stress_islands(spark: SparkSession, d: str) -> DataFrame:
    nodes, edges = _town_graph(spark, d)
    return rounded(op.low_stress_islands(edges, "lts", 2).select("edge_id", "lowstress", "island_m"), 6)


def network_centrality(spark: SparkSession, d: str) -> DataFrame:
    nodes, edges = _town_graph(spark, d)
    return rounded(op.centrality(nodes, edges).join(nodes, "node_id").select("x", "y", "degree", "reach", "closeness", "harm_clo", "straight"), 8)


def network_betweenness(spark: SparkSession, d: str) -> DataFrame:
    nodes, edges = _town_graph(spark, d)
    return rounded(op.centrality(nodes, edges).join(nodes, "node_id").select("x", "y", "betweenness", "betw_norm"), 6)


def network_edge_betweenness(spark: SparkSession, d: str) -> DataFrame:
    nodes, edges = _town_graph(spark, d)
    return rounded(op.edge_centrality(nodes, edges), 6)


def link_criticality(spark: SparkSession, d: str) -> DataFrame:
    nodes, edges = _graph(spark)
    return rounded(op.link_criticality(nodes, edges, _centres(spark, d).select("id", "x", "y")), 6)


def service_area_edges(spark: SparkSession, d: str) -> DataFrame:
    nodes, edges = _graph(spark)
    starts = op.nearest_node(_centres(spark, d).select("id", "x", "y"), nodes).select("node_id", F.lit(0).alias("start"), F.lit(0.0).alias("offset"))
    pieces = op.isochrone_edges(edges, op.nearest_source(edges, starts, 500.0), [150.0, 300.0, 500.0])
    return rounded(pieces.groupBy("band").agg(F.count(F.lit(1)).alias("pieces"), F.sum(F.col("to_m") - F.col("from_m")).alias("length_m")), 6)


def network_eigenvector(spark: SparkSession, d: str) -> DataFrame:
    nodes, edges = _town_graph(spark, d)
    return rounded(op.eigenvector(edges).join(nodes, "node_id").select("x", "y", "eigen"), 6)


def prepare_network(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers as straight streets of 500 to 870 m that cross one another."""
    k = F.col("s_suppkey")
    x, y = k * 41 % 2011 * 1.0, k * 59 % 2017 * 1.0
    end = F.struct((x + 400 + k % 7 * 50).alias("x"), (y + (k % 2 * 2 - 1) * (300 + k % 5 * 40)).alias("y"))
    streets = table(spark, d, "supplier").select(k.alias("line_id"), F.array(F.struct(x.alias("x"), y.alias("y")), end).alias("pts"))
    return rounded(noding.prepare_network(streets).select("line_id", "length_m"), 4)


def walkability(spark: SparkSession, d: str) -> DataFrame:
    """The lattice with customers as destinations and a relief of 8 x 8 cells from parts."""
    k = F.col("p_partkey")
    relief = table(spark, d, "part").groupBy((F.floor(k / 8) % 8).cast("int").alias("row"), (k % 8).cast("int").alias("col")).agg(F.avg("p_size").alias("z"))
    found = walk.walkability(lattice(spark).select("line_id", "pts"), 260.0, pois=_demand(spark, d), dem=relief, grid=(0.0, 100.0, 0.0, 100.0))
    return rounded(found.select("line_id", "walk_score", "int_km2", "blk_len", "n_pois", "slope_pct"), 6)


QUERIES = {f.__name__: f for f in (network_eigenvector, prepare_network, walkability, od_matrix, costs_by_joins, od_routes, nearest_facility, facility_summary, facility_adequacy, access_score, green_access_summary, street_nodes, low_stress_islands, network_centrality, network_betweenness, network_edge_betweenness, link_criticality, service_area_edges)}

_EDGES = """l AS (SELECT range AS id, range % 8 AS c, range // 8 AS r FROM range(64)),
e AS (SELECT id * 2 AS edge, id AS a, id + 1 AS b, 100 + (c * 7 + r * 13) % 11 * 7.5::DOUBLE AS cost, (id * 5) % 7 / 2.0::DOUBLE + 1 AS lts FROM l WHERE c < 7
  UNION ALL SELECT id * 2 + 1, id, id + 8, 100 + (c * 7 + r * 13 + 3) % 11 * 7.5::DOUBLE, (id * 5 + 1) % 7 / 2.0::DOUBLE + 1 FROM l WHERE r < 7)"""
_TOWN_EDGES = """side AS (SELECT CAST(floor(sqrt(count(*))) AS BIGINT) AS s FROM supplier), l AS (SELECT s_suppkey AS id, s_suppkey % s AS c, s_suppkey // s AS r FROM supplier, side WHERE s_suppkey < s * s),
e AS (SELECT id * 2 AS edge, id AS a, id + 1 AS b, 100 + (c * 7 + r * 13) % 11 * 7.5::DOUBLE AS cost, (id * 5) % 7 / 2.0::DOUBLE + 1 AS lts FROM l, side WHERE c < s - 1
  UNION ALL SELECT id * 2 + 1, id, id + s, 100 + (c * 7 + r * 13 + 3) % 11 * 7.5::DOUBLE, (id * 5 + 1) % 7 / 2.0::DOUBLE + 1 FROM l, side WHERE r < s - 1)"""
_SQUARE = "d{1} AS MATERIALIZED (SELECT p.a, q.b, min(p.cost + q.cost) AS cost FROM d{0} p JOIN d{0} q ON p.b = q.a GROUP BY p.a, q.b)"
_COSTS = _EDGES + """, d0 AS (SELECT a, b, cost FROM e UNION ALL SELECT b, a, cost FROM e UNION ALL SELECT id, id, 0 FROM l),
""" + ",\n".join(_SQUARE.format(i, i + 1) for i in range(5)) + ",\nd AS (SELECT * FROM d5)"


def _at(name: str, source: str, key: str, more: str = "", where: str = "TRUE") -> str:
    return f"""{name} AS (SELECT id, x, y, CAST(floor(x / 100 + 0.5::DOUBLE) + 8 * floor(y / 100 + 0.5::DOUBLE) AS BIGINT) AS node {more}
  FROM (SELECT *, {key} AS id, {key} * 37 % 701 + 0.25::DOUBLE AS x, {key} * 53 % 701 + 0.25::DOUBLE AS y FROM {source}) WHERE {where})"""


_F = _at("f", "supplier", "s_suppkey", ", s_acctbal / 100 AS capacity")
_N = _at("z0", "nation", "n_nationkey")
_C = _at("c", "customer", "c_custkey", ", c_custkey % 4 + 1 AS pop")
_NEAREST = f"""WITH {_COSTS}, {_F}, {_C},
n AS (SELECT c.id, c.pop, f.id AS fid, d.cost, row_number() OVER (PARTITION BY c.id ORDER BY round(d.cost, 6), f.id) AS k FROM c JOIN d ON d.a = c.node JOIN f ON f.node = d.b WHERE d.cost <= 500),
z AS (SELECT c.id, c.pop, coalesce(CAST(n.fid AS VARCHAR), '') AS facility, coalesce(n.cost, -1) AS net_cost FROM c LEFT JOIN n ON n.id = c.id AND n.k = 1)"""
_TIMES = "coalesce((SELECT min(d.cost) / 80 FROM d JOIN {0} s ON s.node = d.b WHERE d.a = c.node AND d.cost <= 480), -1)"


def _green(i: int, ha: float, far: float) -> str:
    return f"""SELECT {i} AS class, {ha}::DOUBLE AS min_ha, {far}::DOUBLE AS max_dist, CAST(sum(CASE WHEN near THEN pop ELSE 0 END) AS DOUBLE) AS covered_pop, round(100.0::DOUBLE * sum(CASE WHEN near THEN pop ELSE 0 END) / sum(pop), 6) AS coverage_pct, (SELECT count(*) FROM g WHERE ha >= {ha}) AS n_greens
FROM (SELECT c.pop, EXISTS (SELECT 1 FROM d JOIN g ON g.node = d.b WHERE d.a = c.node AND g.ha >= {ha} AND d.cost + g.snap <= {far}) AS near FROM c)"""


ORACLES = {
    "od_matrix": f"""WITH {_COSTS}, {_F}
SELECT o.id AS origin_id, p.id AS dest_id, round(cost, 6) AS net_cost, round(sqrt((o.x - p.x) ^ 2 + (o.y - p.y) ^ 2), 6) AS euclid_m,
  CASE WHEN o.x = p.x AND o.y = p.y THEN 0 ELSE round(cost / sqrt((o.x - p.x) ^ 2 + (o.y - p.y) ^ 2), 6) END AS detour
FROM f o JOIN d ON d.a = o.node JOIN f p ON p.node = d.b WHERE o.id <> p.id AND cost <= 900""",
    "costs_by_joins": f"WITH {_COSTS}, {_N} SELECT DISTINCT a % 8 * 100.0::DOUBLE AS sx, a // 8 * 100.0::DOUBLE AS sy, b % 8 * 100.0::DOUBLE AS nx, b // 8 * 100.0::DOUBLE AS ny, round(cost, 6) AS cost FROM d JOIN z0 ON z0.node = d.a WHERE cost <= 600",
    "od_routes": f"""WITH {_COSTS}, {_F}, {_N},
r AS (SELECT f.id AS origin_id, z0.id AS dest_id, row_number() OVER (PARTITION BY f.id ORDER BY round(cost, 6), z0.id) AS k, cost, f.node AS a, z0.node AS b FROM f JOIN d ON d.a = f.node JOIN z0 ON z0.node = d.b)
SELECT origin_id, dest_id, CAST(k AS INTEGER) AS k, round(cost, 6) AS net_cost FROM r WHERE k <= 3 AND a <> b""",
    "nearest_facility": _NEAREST + " SELECT id, facility, round(net_cost, 6) AS net_cost FROM z",
    "facility_summary": _NEAREST + " SELECT CAST(f.id AS VARCHAR) AS facility, count(z.id) AS demand_n, coalesce(round(avg(z.net_cost), 6), 0) AS mean_cost, coalesce(round(max(z.net_cost), 6), 0) AS max_cost FROM f LEFT JOIN z ON z.facility = CAST(f.id AS VARCHAR) GROUP BY f.id",
    "facility_adequacy": _NEAREST + """, a AS (SELECT CAST(f.id AS VARCHAR) AS facility, f.capacity, CAST(coalesce(sum(z.pop), 0) AS DOUBLE) AS assigned FROM f LEFT JOIN z ON z.facility = CAST(f.id AS VARCHAR) GROUP BY f.id, f.capacity)
SELECT facility, round(capacity, 6) AS capacity, assigned, CASE WHEN capacity > 0 THEN round(100 * assigned / capacity, 6) WHEN assigned > 0 THEN 9999 ELSE 0 END AS utilization,
  CASE WHEN assigned <= 0 THEN 'Unused' WHEN assigned > capacity THEN 'Overloaded' ELSE 'Adequate' END AS status FROM a""",
    "access_score": f"""WITH {_COSTS}, {_C}, {_F}, {_N},
t AS (SELECT id, {_TIMES.format("f")} AS a, {_TIMES.format("z0")} AS b FROM c)
SELECT id, round(a, 2) AS t_shop, round(b, 2) AS t_school, CAST(CASE WHEN a BETWEEN 0 AND 3 THEN 1 ELSE 0 END + CASE WHEN b BETWEEN 0 AND 3 THEN 1 ELSE 0 END AS INTEGER) AS n_reach,
  50.0::DOUBLE * (CASE WHEN a BETWEEN 0 AND 3 THEN 1 ELSE 0 END + CASE WHEN b BETWEEN 0 AND 3 THEN 1 ELSE 0 END) AS score FROM t""",
    "green_access_summary": f"""WITH {_COSTS}, {_C}, g0 AS (SELECT * FROM supplier), {_at("g1", "g0", "s_suppkey", ", CAST(s_suppkey % 8 AS DOUBLE) AS ha")},
g AS (SELECT *, sqrt((x - node % 8 * 100) ^ 2 + (y - node // 8 * 100) ^ 2) AS snap FROM g1)
{_green(1, 0.5, 150.0)} UNION ALL {_green(2, 2.0, 400.0)} UNION ALL {_green(3, 6.0, 900.0)}""",
    "street_nodes": f"""WITH {_EDGES}, n AS (SELECT node, count(*) AS g FROM (SELECT a AS node FROM e UNION ALL SELECT b FROM e) GROUP BY node)
SELECT node % 8 * 100.0::DOUBLE AS x, node // 8 * 100.0::DOUBLE AS y, CAST(g AS INTEGER) AS degree, CASE g WHEN 1 THEN 'cul-de-sac' WHEN 2 THEN 'continuation' ELSE 'intersection' END AS node_type FROM n""",
    "low_stress_islands": "WITH " + _EDGES + ", k AS (SELECT a, b FROM e WHERE lts <= 2), d0 AS (SELECT a, b FROM k UNION SELECT b, a FROM k UNION SELECT a, a FROM k UNION SELECT b, b FROM k),\n" + ",\n".join(f"d{i + 1} AS MATERIALIZED (SELECT DISTINCT p.a, q.b FROM d{i} p JOIN d{i} q ON p.b = q.a)" for i in range(6)) + """,
c AS (SELECT a AS node, min(b) AS comp FROM d6 GROUP BY a), s AS (SELECT comp, count(*) * 100.0::DOUBLE AS m FROM e JOIN c ON c.node = e.a WHERE lts <= 2 GROUP BY comp)
SELECT edge AS edge_id, CAST(lts <= 2 AS INTEGER) AS lowstress, CASE WHEN lts <= 2 THEN m ELSE 0 END AS island_m FROM e LEFT JOIN c ON c.node = e.a LEFT JOIN s ON s.comp = c.comp""",
    "network_centrality": f"""WITH {_COSTS}, n AS (SELECT node, count(*) AS g FROM (SELECT a AS node FROM e UNION ALL SELECT b FROM e) GROUP BY node),
s AS (SELECT a, sum(cost) AS f, sum(1 / cost) AS h, avg(sqrt((a % 8 - b % 8) ^ 2 + (a // 8 - b // 8) ^ 2) * 100 / cost) AS st FROM d WHERE a <> b GROUP BY a)
SELECT a % 8 * 100.0::DOUBLE AS x, a // 8 * 100.0::DOUBLE AS y, CAST(g AS INTEGER) AS degree, 64 AS reach, round(63 / f, 8) AS closeness, round(h, 8) AS harm_clo, round(st, 8) AS straight FROM s JOIN n ON n.node = s.a""",
    # The number of shortest paths by their number of streets; a node lies on those where its two parts are shortest too.
    "network_betweenness": f"""WITH RECURSIVE {_COSTS}, w AS (SELECT a, b, cost FROM e UNION ALL SELECT b, a, cost FROM e),
p AS (SELECT id AS s, id AS v, 0 AS k, 1.0::DOUBLE AS n FROM l UNION ALL
  SELECT p.s, w.b, p.k + 1, sum(p.n) FROM p JOIN w ON w.a = p.v JOIN d x ON x.a = p.s AND x.b = p.v JOIN d z ON z.a = p.s AND z.b = w.b WHERE x.cost + w.cost = z.cost AND p.k < 32 GROUP BY p.s, w.b, p.k),
g AS MATERIALIZED (SELECT p.s, p.v, d.cost, sum(n) AS n FROM p JOIN d ON d.a = p.s AND d.b = p.v GROUP BY p.s, p.v, d.cost),
t AS (SELECT i.v, sum(i.n * j.n / h.n) / 2 AS bc FROM g i JOIN g j ON j.s = i.v JOIN g h ON h.s = i.s AND h.v = j.v WHERE i.s <> i.v AND j.v <> i.v AND i.s <> j.v AND i.cost + j.cost = h.cost GROUP BY i.v)
SELECT id % 8 * 100.0::DOUBLE AS x, id // 8 * 100.0::DOUBLE AS y, round(coalesce(bc, 0), 6) AS betweenness, round(coalesce(bc, 0) / 1953, 6) AS betw_norm FROM l LEFT JOIN t ON t.v = l.id""",
    # A street lies on the paths whose parts before and behind it are shortest too.
    "network_edge_betweenness": f"""WITH RECURSIVE {_COSTS}, w AS (SELECT edge, a, b, cost FROM e UNION ALL SELECT edge, b, a, cost FROM e),
p AS (SELECT id AS s, id AS v, 0 AS k, 1.0::DOUBLE AS n FROM l UNION ALL
  SELECT p.s, w.b, p.k + 1, sum(p.n) FROM p JOIN w ON w.a = p.v JOIN d x ON x.a = p.s AND x.b = p.v JOIN d z ON z.a = p.s AND z.b = w.b WHERE x.cost + w.cost = z.cost AND p.k < 32 GROUP BY p.s, w.b, p.k),
g AS MATERIALIZED (SELECT p.s, p.v, d.cost, sum(n) AS n FROM p JOIN d ON d.a = p.s AND d.b = p.v GROUP BY p.s, p.v, d.cost),
t AS (SELECT w.edge, sum(i.n * j.n / h.n) / 2 AS bc FROM w JOIN g i ON i.v = w.a JOIN g j ON j.s = w.b JOIN g h ON h.s = i.s AND h.v = j.v WHERE i.cost + w.cost + j.cost = h.cost GROUP BY w.edge),
q AS (SELECT d.a, 63 / sum(d.cost) AS clo, avg(100 * sqrt((x.c - y.c) ^ 2 + (x.r - y.r) ^ 2) / d.cost) AS str FROM d JOIN l x ON x.id = d.a JOIN l y ON y.id = d.b WHERE d.a <> d.b GROUP BY d.a)
SELECT e.edge AS edge_id, round(coalesce(bc, 0), 6) AS betw_edge, round((u.clo + v.clo) / 2, 6) AS clo_mean, round((u.str + v.str) / 2, 6) AS str_mean FROM e LEFT JOIN t USING (edge) JOIN q u ON u.a = e.a JOIN q v ON v.a = e.b""",
    "network_eigenvector": f"""WITH RECURSIVE {_EDGES}, w AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e UNION ALL SELECT id, id FROM l),
p AS (SELECT id, 1.0::DOUBLE AS x, 0 AS k FROM l UNION ALL SELECT w.b, sum(p.x) / 5, p.k + 1 FROM p JOIN w ON w.a = p.id WHERE p.k < 200 GROUP BY w.b, p.k)
SELECT id % 8 * 100.0::DOUBLE AS x, id // 8 * 100.0::DOUBLE AS y, round(x / max(x) OVER (), 6) AS eigen FROM p WHERE k = 200""",
    "prepare_network": """WITH s AS (SELECT s_suppkey AS i, s_suppkey * 41 % 2011 * 1.0::DOUBLE AS x, s_suppkey * 59 % 2017 * 1.0::DOUBLE AS y, 400.0::DOUBLE + s_suppkey % 7 * 50 AS u, (s_suppkey % 2 * 2 - 1) * (300.0::DOUBLE + s_suppkey % 5 * 40) AS v FROM supplier),
c AS (SELECT p.i, ((q.x - p.x) * q.v - (q.y - p.y) * q.u) / (p.u * q.v - p.v * q.u) AS t, ((q.x - p.x) * p.v - (q.y - p.y) * p.u) / (p.u * q.v - p.v * q.u) AS z FROM s p JOIN s q ON p.i <> q.i AND p.u * q.v <> p.v * q.u),
m AS (SELECT i, t FROM c WHERE t BETWEEN 0 AND 1 AND z BETWEEN -1e-9 AND 1 + 1e-9 UNION ALL SELECT i, 0 FROM s UNION ALL SELECT i, 1 FROM s),
g AS (SELECT i, lead(t) OVER (PARTITION BY i ORDER BY t) - t AS part FROM m)
SELECT i AS line_id, round(part * sqrt(u * u + v * v), 4) AS length_m FROM g JOIN s USING (i) WHERE part * sqrt(u * u + v * v) > 0.05::DOUBLE""",
    "walkability": f"""WITH {_EDGES}, {_C}, n AS (SELECT id, c * 100 AS x, r * 100 AS y FROM l WHERE NOT (c IN (0, 7) AND r IN (0, 7))),
h AS (SELECT p_partkey // 8 % 8 * 8 + p_partkey % 8 AS id, avg(p_size) AS z FROM part GROUP BY 1),
m AS (SELECT edge, a, b, (a % 8 + b % 8) * 50.0::DOUBLE AS x, (a // 8 + b // 8) * 50.0::DOUBLE AS y FROM e),
j AS (SELECT edge, count(n.id) / (pi() * 0.0676::DOUBLE) AS km2 FROM m LEFT JOIN n ON (m.x - n.x) ^ 2 + (m.y - n.y) ^ 2 <= 67600 GROUP BY edge),
o AS (SELECT edge, count(c.id) AS pois FROM m LEFT JOIN c ON (m.x - c.x) ^ 2 + (m.y - c.y) ^ 2 <= 67600 GROUP BY edge),
s AS (SELECT m.edge, km2, pois, coalesce(abs(ha.z - hb.z), 0) AS slope FROM m JOIN j USING (edge) JOIN o USING (edge) LEFT JOIN h ha ON ha.id = m.a LEFT JOIN h hb ON hb.id = m.b)
SELECT edge AS line_id, round((30 * least(km2 / 120, 1) + 25 * least(pois / 25.0::DOUBLE, 1) + 10 * 0.9375::DOUBLE + 10 * greatest(least((12 - slope) / 12, 1), 0)) / 0.75::DOUBLE, 6) AS walk_score, round(km2, 6) AS int_km2, 100.0::DOUBLE AS blk_len, CAST(pois AS INTEGER) AS n_pois, round(slope, 6) AS slope_pct FROM s""",
}

_NODES = "(SELECT count(*) FROM l)"
#: The same over the town, whose number of points and side are read from the table.
for _name in ("street_nodes", "low_stress_islands", "network_centrality", "network_betweenness", "network_edge_betweenness", "network_eigenvector"):
    _sql = ORACLES[_name].replace(_EDGES, _TOWN_EDGES)
    for _old, _new in ((" % 8", " % (SELECT s FROM side)"), (" // 8", " // (SELECT s FROM side)"), ("64 AS reach", f"CAST({_NODES} AS INTEGER) AS reach"), ("63 / ", f"({_NODES} - 1) / "), ("/ 1953", f"/ (({_NODES} - 1) * ({_NODES} - 2) / 2)")):
        _sql = _sql.replace(_old, _new)
    ORACLES[_name] = _sql
