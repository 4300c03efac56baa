"""Street networks: graph building, snapping, shortest costs and routes, and what is measured on them.

Lines are rows (line_id, pts array<struct<x, y>>, optional cost). A graph is two tables, nodes(node_id, x, y) and
edges(edge_id, a, b, cost, len). Searches run in parallel over their sources: each task has the graph as arrays,
which are broadcast if the edge table has at most BROADCAST_EDGES rows; for larger networks costs are relaxed by
joins instead, a frontier at a time, with nothing broadcast.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from urbanloom.functions.ordered import numbered
from urbanloom.functions.scratch import written

BROADCAST_EDGES = 2_000_000
#: Nodes in 3 x 3 cells that a point meets as one array.
CROWD = 4_096
INF = float("inf")
#: Places (nodes times starts), about, that are searched at once.
SEARCH_PLACES = 1 << 20
#: Ids of one place that are paired as one array.
IDS = 1024


def length(pts: str | Column) -> Column:
    """Length of a polyline."""
    p = F.col(pts) if isinstance(pts, str) else pts
    steps = F.zip_with(F.slice(p, 1, F.size(p) - 1), F.slice(p, 2, F.size(p)), lambda a, b: F.hypot(a["x"] - b["x"], a["y"] - b["y"]))
    return F.aggregate(steps, F.lit(0.0), lambda s, d: s + d)


def build_graph(lines: DataFrame, tolerance: float = 0.01, cost: str | None = None, keep: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of lines: ends that round to one grid point of `tolerance` are one node.

    Nodes are numbered 0.. in the order of their first line end (by line_id, start before end) and have that
    end's place. Costs that are missing, not finite or not positive are the length. Lines with fewer than two
    points are left out; edges keep the columns `keep`.
    """
    held = lines.where(F.size("pts") >= 2).withColumns({"_len": length("pts"), "_s": F.col("pts")[0], "_e": F.element_at("pts", -1)})
    key = lambda p: F.struct(F.bround(p["x"] / tolerance).cast("long").alias("i"), F.bround(p["y"] / tolerance).cast("long").alias("j"))
    held = held.withColumns({"_ks": key(F.col("_s")), "_ke": key(F.col("_e"))})
    ends = held.select(F.explode(F.array(*[F.struct(F.struct(F.col("line_id"), F.lit(n).alias("n")).alias("at"), F.col(f"_k{c}").alias("k"), F.col(f"_{c}").alias("p")) for n, c in ((0, "s"), (1, "e"))])).alias("v")).select("v.*")
    nodes = ends.groupBy("k").agg(F.min("at").alias("at"), F.min_by("p", "at").alias("p"))
    nodes = numbered(nodes, ["at"], "node_id")
    nodes = written(nodes.select("k", "node_id", F.col("p.x").alias("x"), F.col("p.y").alias("y")))
    a, b = (nodes.select(F.col("k").alias(f"_k{c}"), F.col("node_id").alias(n)) for c, n in (("s", "a"), ("e", "b")))
    edges = held.join(a, "_ks").join(b, "_ke")
    given = F.col(cost).try_cast("double") if cost else F.lit(None).cast("double")
    paid = F.when((given > 0) & (given < INF), given).otherwise(F.col("_len"))
    edges = written(edges.select(F.col("line_id").alias("edge_id"), "a", "b", paid.alias("cost"), F.col("_len").alias("len"), *(keep or [])))
    return nodes.drop("k"), edges


def nearest_node(points: DataFrame, nodes: DataFrame, cell: float | None = None) -> DataFrame:
    """points (x, y) with node_id and snap_m of their nearest node (ties: smaller node_id).

    Points meet the nodes of the 3 x 3 cells around them; those whose best node is not surely the nearest go on
    with cells four times as large, so each round's join is on equal cells and local. A point outside the nodes'
    bounds looks around its nearest place on them, at distance out: a node farther than one cell from there is
    farther than hypot(out, cell) from the point, so a best node within that is the nearest. Once a cell is as
    large as the bounds every node is in reach, so each point with coordinates finds its node. Where no 3 x 3 cells
    hold more than CROWD nodes, a point meets them as one array, in its own row: points are not multiplied or sorted.
    """
    bounds = nodes.agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"), F.count(F.lit(1)).alias("n")).first()
    none = [F.lit(None).cast("long").alias("node_id"), F.lit(None).cast("double").alias("snap_m")]
    if not bounds.n:
        return points.select("*", *none)
    span = max(bounds.x1 - bounds.x0, bounds.y1 - bounds.y0, 1.0)
    cell = cell or max(span / max(1.0, bounds.n**0.5), span * 1e-6)
    near = lambda c: F.least(F.greatest(F.col(c), F.lit(bounds[f"{c}0"])), F.lit(bounds[f"{c}1"]))
    known = "x is not null and y is not null and not isnan(x) and not isnan(y)"
    done = [points.where(f"not ({known})").select("*", *none)]
    todo = points.where(known).withColumns({"_px": near("x"), "_py": near("y")})
    around = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    out = F.hypot(F.col("x") - F.col("_px"), F.col("y") - F.col("_py"))
    while True:
        last = cell >= span
        own = todo.withColumns({"_ci": F.floor(F.col("_px") / cell), "_cj": F.floor(F.col("_py") / cell)})
        spots = nodes.select("node_id", F.col("x").alias("nx"), F.col("y").alias("ny"), around.alias("o"))
        spots = spots.select("node_id", "nx", "ny", (F.floor(F.col("nx") / cell) + F.col("o.i")).alias("_ci"), (F.floor(F.col("ny") / cell) + F.col("o.j")).alias("_cj"))
        crowd = spots.groupBy("_ci", "_cj").count().agg(F.max("count")).first()[0]
        if crowd <= CROWD:
            held = written(spots.groupBy("_ci", "_cj").agg(F.collect_list(F.struct("node_id", "nx", "ny")).alias("_near")))
            d = lambda n: F.struct(F.hypot(F.col("x") - n["nx"], F.col("y") - n["ny"]).alias("d"), n["node_id"].alias("node_id"))
            seen = own.join(held, ["_ci", "_cj"], "left").withColumn("_b", F.array_min(F.transform("_near", d))).drop("_near")
        else:
            own = written(own.withColumn("_pid", F.monotonically_increasing_id()))
            d = F.hypot(F.col("x") - F.col("nx"), F.col("y") - F.col("ny"))
            best = own.select("_pid", "x", "y", "_ci", "_cj").join(spots, ["_ci", "_cj"]).groupBy("_pid").agg(F.min(F.struct(d.alias("d"), "node_id")).alias("_b"))
            seen = own.join(best, "_pid", "left").drop("_pid")
        sure = F.lit(True) if last else F.coalesce(F.col("_b.d") <= F.hypot(out, F.lit(cell)), F.lit(False))
        seen = written(seen.withColumn("_sure", sure).drop("_ci", "_cj"))
        done.append(seen.where("_sure").select(*points.columns, F.col("_b.node_id").alias("node_id"), F.col("_b.d").alias("snap_m")))
        todo = seen.where("not _sure").drop("_b", "_sure")
        if last or not todo.limit(1).count():
            break
        cell *= 4
    every = done[0]
    for more in done[1:]:
        every = every.unionByName(more)
    return every


class Csr:
    """A graph as arrays: the neighbours of node u are entries indptr[u] to indptr[u + 1]."""

    def __init__(self, n: int, a: np.ndarray, b: np.ndarray, cost: np.ndarray, edge: np.ndarray):
        src, dst = np.concatenate([a, b]), np.concatenate([b, a])
        order = np.argsort(src, kind="stable")
        self.n = n
        self.dst, self.cost, self.edge = dst[order], np.tile(cost, 2)[order], np.tile(edge, 2)[order]
        self.indptr = np.concatenate([[0], np.cumsum(np.bincount(src, minlength=n))])
        self.lists = None

    def neighbours(self) -> list[list[tuple[int, float, int]]]:
        if self.lists is None:
            rows = list(zip(self.dst.tolist(), self.cost.tolist(), self.edge.tolist(), strict=True))
            at = self.indptr.tolist()
            self.lists = [rows[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
        return self.lists

    def search(self, starts: list[tuple[int, float]], cutoff: float | None = None, drop: int | None = None) -> tuple[dict[int, float], dict[int, int], dict[int, tuple[int, int]]]:
        """(cost, start's place, (node, edge) before) of all nodes within the cutoff; ties keep the earlier start."""
        near = self.neighbours()
        dist: dict[int, float] = {}
        label: dict[int, int] = {}
        before: dict[int, tuple[int, int]] = {}
        best: dict[int, float] = {}
        heap = []
        for i, (s, offset) in enumerate(starts):
            if offset < best.get(s, INF) and (cutoff is None or offset <= cutoff):
                best[s] = offset
                label[s] = i
                heap.append((offset, i, s))
        heapq.heapify(heap)
        while heap:
            d, i, u = heapq.heappop(heap)
            if u in dist or d > best[u]:
                continue
            dist[u] = d
            for v, c, e in near[u]:
                if e == drop or v in dist:
                    continue
                nd = d + c
                if (cutoff is None or nd <= cutoff) and nd < best.get(v, INF):
                    best[v] = nd
                    label[v] = label[u]
                    before[v] = (u, e)
                    heapq.heappush(heap, (nd, label[u], v))
        return dist, label, before

    @staticmethod
    def path(before: dict[int, tuple[int, int]], target: int) -> list[int]:
        """Edges from the start to the target."""
        out = []
        while target in before:
            target, e = before[target]
            out.append(e)
        return out[::-1]


def csr_of(edges: DataFrame) -> Csr:
    """The arrays of an edge table of at most BROADCAST_EDGES rows (an error beyond)."""
    n = edges.count()
    if n > BROADCAST_EDGES:
        raise ValueError(f"{n} edges are too many to be sent to every task")
    rows = edges.select("a", "b", "cost", "edge_id").orderBy("edge_id").toPandas()
    nodes = int(max(rows["a"].max(), rows["b"].max())) + 1 if len(rows) else 0
    return Csr(nodes, rows["a"].to_numpy("i8"), rows["b"].to_numpy("i8"), rows["cost"].to_numpy("f8"), rows["edge_id"].to_numpy("i8"))


def per_source(edges: DataFrame, sources: DataFrame, kernel: Callable[[Csr, pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """Runs kernel(graph, rows) over the rows of sources, dealt evenly over tasks."""
    spark = edges.sparkSession
    shared = spark.sparkContext.broadcast(csr_of(edges))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            yield kernel(shared.value, rows)

    return sources.repartition(spark.sparkContext.defaultParallelism * 2).mapInPandas(run, schema)


def costs_from(edges: DataFrame, sources: DataFrame, cutoff: float | None = None, targets: DataFrame | None = None) -> DataFrame:
    """(source, node, cost) for all nodes within the cutoff of each source node (sources: node_id, distinct).

    With targets (node), only those nodes leave the search; they are at most the graph's nodes, which are broadcast too.
    """
    if edges.count() > BROADCAST_EDGES:
        found = costs_by_joins(edges, sources, cutoff)
        return found if targets is None else found.join(targets.select("node").distinct(), "node", "left_semi").select("source", "node", "cost")
    wanted = None
    if targets is not None:
        wanted = targets.select("node").where("node is not null").distinct().toPandas()["node"].to_numpy("i8")
        wanted = edges.sparkSession.sparkContext.broadcast(set(wanted.tolist()))

    def kernel(graph: Csr, rows: pd.DataFrame) -> pd.DataFrame:
        source, node, cost = [], [], []
        for s in rows["node_id"]:
            dist = graph.search([(int(s), 0.0)], cutoff)[0]
            if wanted is not None:
                dist = {n: dist[n] for n in wanted.value & dist.keys()}
            source.append(np.full(len(dist), int(s)))
            node += dist
            cost += dist.values()
        return pd.DataFrame({"source": np.concatenate(source) if source else [], "node": node, "cost": cost})

    return per_source(edges, sources.select("node_id").distinct(), kernel, "source long, node long, cost double")


def costs_by_joins(edges: DataFrame, sources: DataFrame, cutoff: float | None = None, rounds: int = 10_000) -> DataFrame:
    """The same by relaxation: each round extends the pairs that got cheaper by one edge and keeps the minimum."""
    starts = sources.select(F.col("node_id").alias("source"), "node_id", F.lit(0.0).alias("offset")).distinct()
    return _relaxed(edges, starts, cutoff, rounds)


def _relaxed(edges: DataFrame, starts: DataFrame, cutoff: float | None, rounds: int) -> DataFrame:
    """(source, node, cost) from starts (source, node_id, offset) by joins, until no cost falls any more."""
    both = written(edges.select("a", "b", "cost").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "cost")).groupBy("a", "b").agg(F.min("cost").alias("step")))
    first = starts if cutoff is None else starts.where(F.col("offset") <= cutoff)
    known = written(first.groupBy("source", F.col("node_id").alias("node")).agg(F.min("offset").alias("cost")))
    frontier = known
    for _ in range(rounds):
        reach = frontier.join(both, frontier["node"] == both["a"]).select("source", F.col("b").alias("node"), (F.col("cost") + F.col("step")).alias("new"))
        reach = reach if cutoff is None else reach.where(F.col("new") <= cutoff)
        reach = reach.groupBy("source", "node").agg(F.min("new").alias("new"))
        merged = written(known.join(reach, ["source", "node"], "full").withColumn("better", F.coalesce(F.col("new") < F.col("cost"), F.col("cost").isNull())))
        known = merged.select("source", "node", F.when(F.col("better"), F.col("new")).otherwise(F.col("cost")).alias("cost"))
        frontier = merged.where("better").select("source", "node", F.col("new").alias("cost"))
        if not frontier.limit(1).count():
            return known
    raise RuntimeError(f"costs still fall after {rounds} rounds")


def costs_from_places(edges: DataFrame, starts: DataFrame, cutoff: float | None = None) -> DataFrame:
    """(source, node, cost) of all nodes within the cutoff of each source, which enters the network at several nodes.

    starts: source (a long), node_id, offset (the cost of getting there; not below 0), any number of rows a source.
    """
    if edges.count() > BROADCAST_EDGES:
        return _relaxed(edges, starts, cutoff, 10_000)

    def kernel(graph: Csr, rows: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"source": [], "node": [], "cost": []})]
        for source, at in zip(rows["source"], rows["at"], strict=True):
            dist = graph.search([(int(x["node_id"]), float(x["offset"])) for x in at], cutoff)[0]
            out.append(pd.DataFrame({"source": int(source), "node": list(dist), "cost": list(dist.values())}))
        return pd.concat(out)

    each = starts.groupBy("source").agg(F.sort_array(F.collect_list(F.struct("offset", "node_id"))).alias("at"))
    return per_source(edges, each, kernel, "source long, node long, cost double")


def nearest_source(edges: DataFrame, starts: DataFrame, cutoff: float | None = None, rounds: int = 10_000) -> DataFrame:
    """(node, cost, start) of each node's cheapest start (starts: node_id, start, offset), ties to the smaller start.

    All starts spread at once by joins; a node keeps the minimum of (cost, start), so the work is one label per node.
    """
    both = written(edges.select("a", "b", "cost").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "cost")).groupBy("a", "b").agg(F.min("cost").alias("step")))
    first = starts.where("offset is not null" if cutoff is None else f"offset <= {cutoff}")
    known = written(first.groupBy(F.col("node_id").alias("node")).agg(F.min(F.struct(F.col("offset").alias("cost"), "start")).alias("s")))
    frontier = known
    for _ in range(rounds):
        reach = frontier.join(both, frontier["node"] == both["a"]).select(F.col("b").alias("node"), F.struct((F.col("s.cost") + F.col("step")).alias("cost"), F.col("s.start").alias("start")).alias("new"))
        reach = reach if cutoff is None else reach.where(F.col("new.cost") <= cutoff)
        reach = reach.groupBy("node").agg(F.min("new").alias("new"))
        merged = written(known.join(reach, "node", "full").withColumn("better", F.coalesce(F.col("new") < F.col("s"), F.col("s").isNull())))
        known = merged.select("node", F.when(F.col("better"), F.col("new")).otherwise(F.col("s")).alias("s"))
        frontier = merged.where("better").select("node", F.col("new").alias("s"))
        if not frontier.limit(1).count():
            return known.select("node", "s.cost", "s.start")
    raise RuntimeError(f"costs still fall after {rounds} rounds")


def _by_place(points: DataFrame, names: list[str]) -> DataFrame:
    """Points (id, x, y, node_id) as one row a place, with at most about IDS of their ids as an array; without a node, none."""
    spot = ["x", "y", "node_id"]
    held = points.where("node_id is not null")
    parts = held.groupBy(*spot).agg(F.ceil(F.count(F.lit(1)) / IDS).alias("_n"))
    dealt = held.join(parts, spot).withColumn("_k", F.pmod(F.xxhash64("id"), F.col("_n")))
    return written(dealt.groupBy(*spot, "_k").agg(F.collect_list("id").alias("ids")).select(*spot, "_k", "ids").toDF(*names))


def od_matrix(nodes: DataFrame, edges: DataFrame, origins: DataFrame, destinations: DataFrame | None = None, cutoff: float | None = None, digits: int | None = None) -> DataFrame:
    """origin_id, dest_id, net_cost, euclid_m, detour of all pairs that are connected within the cutoff.

    origins and destinations: id, x, y. Without destinations the origins serve, and no row pairs with itself.
    detour is cost over distance (0 for distance 0). With digits the measures are rounded. They are taken once for each
    pair of places (equal x and y), which is then dealt over tasks and gives its rows.
    """
    same = destinations is None
    o = written(nearest_node(origins.select("id", "x", "y"), nodes).drop("snap_m"))
    d = o if same else written(nearest_node(destinations.select("id", "x", "y"), nodes).drop("snap_m"))
    o, d = _by_place(o, ["ox", "oy", "source", "_ok", "_o"]), _by_place(d, ["dx", "dy", "node", "_dk", "_d"])
    costs = costs_from(edges, o.select(F.col("source").alias("node_id")), cutoff, d)
    straight = F.hypot(F.col("ox") - F.col("dx"), F.col("oy") - F.col("dy"))
    measures = {"net_cost": F.col("cost"), "euclid_m": straight, "detour": F.when(straight > 0, F.col("cost") / straight).otherwise(0.0)}
    if digits is not None:
        measures = {name: F.round(value, digits) + F.lit(0.0) for name, value in measures.items()}
    places = costs.join(d, "node").join(o, "source").select("ox", "oy", "_ok", "dx", "dy", "_dk", "_o", "_d", *[value.alias(name) for name, value in measures.items()])
    # A number of parts that is given stays: by their size, small before they give their rows, they would become one.
    dealt = places.repartition(edges.sparkSession.sparkContext.defaultParallelism * 8, "ox", "oy", "_ok", "dx", "dy", "_dk")
    pairs = dealt.select(F.explode("_o").alias("origin_id"), "_d", *measures).select("origin_id", F.explode("_d").alias("dest_id"), *measures)
    return pairs.where("origin_id <> dest_id") if same else pairs


def od_routes(nodes: DataFrame, edges: DataFrame, origins: DataFrame, destinations: DataFrame, k_nearest: int = 0, cutoff: float | None = None) -> DataFrame:
    """origin_id, dest_id, k (rank by cost, ties by dest_id), net_cost, n_edges, path (edge ids); pairs on one node
    take a rank but give no row."""
    o = nearest_node(origins.select(F.col("id").alias("origin_id"), "x", "y"), nodes).select("origin_id", F.col("node_id").alias("source"))
    d = nearest_node(destinations.select(F.col("id").alias("dest_id"), "x", "y"), nodes).select("dest_id", F.col("node_id").alias("node"))
    wanted = d.select("node").distinct().agg(F.collect_set("node").alias("targets")).first().targets
    aim = edges.sparkSession.sparkContext.broadcast(set(wanted))

    def kernel(graph: Csr, rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        for s in rows["node_id"]:
            dist, _, before = graph.search([(int(s), 0.0)], cutoff)
            out += [(int(s), t, c, graph.path(before, t)) for t, c in dist.items() if t in aim.value]
        return pd.DataFrame(out, columns=["source", "node", "cost", "path"])

    found = per_source(edges, o.select(F.col("source").alias("node_id")).distinct(), kernel, "source long, node long, cost double, path array<long>")
    pairs = found.join(d, "node").join(o, "source")
    ranked = pairs.withColumn("k", F.row_number().over(W.partitionBy("origin_id").orderBy("cost", "dest_id")))
    ranked = ranked.where(F.col("k") <= k_nearest) if k_nearest else ranked
    return ranked.where("source <> node").select("origin_id", "dest_id", "k", F.col("cost").alias("net_cost"), F.size("path").alias("n_edges"), "path")


def nearest_facility(nodes: DataFrame, edges: DataFrame, demand: DataFrame, facilities: DataFrame, cutoff: float | None = None) -> DataFrame:
    """Rows of demand (id, x, y, ...) with facility ('' if none) and net_cost (-1 if none).

    facilities: id, x, y, pos (their order): of those that share a node the first counts, and it wins ties.
    """
    f = nearest_node(facilities.select(F.col("id").alias("fid"), "pos", "x", "y"), nodes)
    starts = f.select("node_id", F.struct("pos", F.col("fid").cast("string").alias("fid")).alias("start"), F.lit(0.0).alias("offset"))
    label = nearest_source(edges, starts, cutoff).select(F.col("node").alias("node_id"), "cost", F.col("start.fid").alias("fid"))
    d = nearest_node(demand, nodes).drop("snap_m")
    return d.join(label, "node_id", "left").select(*demand.columns, F.coalesce("fid", F.lit("")).alias("facility"), F.coalesce("cost", F.lit(-1.0)).alias("net_cost"))


def facility_summary(assigned: DataFrame, facilities: DataFrame) -> DataFrame:
    """facility, demand_n, mean_cost, max_cost for every facility, zeros for those that nobody uses."""
    sums = assigned.where("facility <> ''").groupBy("facility").agg(F.count(F.lit(1)).alias("demand_n"), F.avg("net_cost").alias("mean_cost"), F.max("net_cost").alias("max_cost"))
    every = facilities.select(F.col("id").cast("string").alias("facility"))
    return every.join(sums, "facility", "left").select("facility", F.coalesce("demand_n", F.lit(0)).alias("demand_n"), F.coalesce("mean_cost", F.lit(0.0)).alias("mean_cost"), F.coalesce("max_cost", F.lit(0.0)).alias("max_cost"))


def facility_adequacy(assigned: DataFrame, facilities: DataFrame, pop: str, capacity: str) -> DataFrame:
    """facility, capacity, assigned, utilization (percent; 9999 without capacity but load), status."""
    load = assigned.where("facility <> ''").groupBy("facility").agg(F.sum(F.col(pop).cast("double")).alias("assigned"))
    every = facilities.select(F.col("id").cast("string").alias("facility"), F.coalesce(F.col(capacity).try_cast("double"), F.lit(0.0)).alias("capacity"))
    held = every.join(load, "facility", "left").withColumn("assigned", F.coalesce("assigned", F.lit(0.0)))
    use = F.when(F.col("capacity") > 0, 100 * F.col("assigned") / F.nullif("capacity", F.lit(0.0))).when(F.col("assigned") > 0, 9999.0).otherwise(0.0)
    status = F.when(F.col("assigned") <= 0, "Unused").when(F.col("assigned") > F.col("capacity"), "Overloaded").otherwise("Adequate")
    return held.select("facility", "capacity", "assigned", use.alias("utilization"), status.alias("status"))


def access_score(nodes: DataFrame, edges: DataFrame, origins: DataFrame, amenities: dict[str, DataFrame], speed_kmh: float = 4.8, threshold_min: float = 15.0) -> DataFrame:
    """Rows of origins (id, x, y) with t_<category> minutes (-1 beyond twice the threshold), n_reach and score."""
    per_min = speed_kmh * 1000 / 60
    found = nearest_node(origins, nodes).drop("snap_m")
    for name, points in amenities.items():
        starts = nearest_node(points.select("x", "y"), nodes).select("node_id", F.lit(0).alias("start"), F.lit(0.0).alias("offset")).distinct()
        cost = nearest_source(edges, starts, 2 * threshold_min * per_min).select(F.col("node").alias("node_id"), (F.col("cost") / per_min).alias(f"t_{name}"))
        found = found.join(cost, "node_id", "left")
    times = [F.coalesce(f"t_{n}", F.lit(-1.0)) for n in amenities]
    reach = sum((((t >= 0) & (t <= threshold_min)).cast("int") for t in times), F.lit(0))
    return found.select(*origins.columns, *[t.alias(f"t_{n}") for t, n in zip(times, amenities, strict=True)], reach.alias("n_reach"), (100.0 * reach / len(amenities)).alias("score"))


def green_access(nodes: DataFrame, edges: DataFrame, demand: DataFrame, greens: DataFrame, hierarchy: list[tuple[float, float]], pop: str) -> tuple[DataFrame, DataFrame]:
    """(demand with d_c<i> and ok_c<i>, summary by class): greens (x, y, area_ha) of at least min_ha within max_dist.

    The way from a green to its node counts; -1 where no green is near enough.
    """
    found, rows = nearest_node(demand, nodes).drop("snap_m"), []
    g = nearest_node(greens, nodes)
    for i, (min_ha, max_dist) in enumerate(hierarchy, 1):
        starts = g.where(F.col("area_ha") >= min_ha).groupBy("node_id").agg(F.min("snap_m").alias("offset")).withColumn("start", F.lit(0))
        cost = nearest_source(edges, starts, max_dist).select(F.col("node").alias("node_id"), F.col("cost").alias(f"d_c{i}"))
        found = found.join(cost, "node_id", "left").withColumn(f"ok_c{i}", F.col(f"d_c{i}").isNotNull().cast("int")).withColumn(f"d_c{i}", F.coalesce(f"d_c{i}", F.lit(-1.0)))
        n = g.agg(F.count(F.when(F.col("area_ha") >= min_ha, 1)).alias("n_greens"))
        sums = found.agg(F.coalesce(F.sum(F.col(pop).cast("double") * F.col(f"ok_c{i}")), F.lit(0.0)).alias("covered_pop"), F.sum(F.col(pop).cast("double")).alias("_all"))
        rows.append(sums.crossJoin(n).select(F.lit(i).alias("class"), F.lit(min_ha).alias("min_ha"), F.lit(max_dist).alias("max_dist"), "covered_pop", F.coalesce(100 * F.try_divide("covered_pop", "_all"), F.lit(0.0)).alias("coverage_pct"), "n_greens"))
    summary = rows[0]
    for more in rows[1:]:
        summary = summary.unionByName(more)
    return found.drop("node_id"), summary


def street_nodes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node_id, degree, node_type: cul-de-sac (1), continuation (2), intersection; loops count twice."""
    ends = edges.select(F.explode(F.array("a", "b")).alias("node_id")).groupBy("node_id").agg(F.count(F.lit(1)).cast("int").alias("degree"))
    kind = F.when(F.col("degree") == 1, "cul-de-sac").when(F.col("degree") == 2, "continuation").otherwise("intersection")
    return nodes.select("node_id").join(ends, "node_id").select("node_id", "degree", kind.alias("node_type"))


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) of an edge table (a, b): comp is the smallest node that is connected.

    Rounds lower labels to the neighbours' smallest, the old label's node with them, and jump to the label's own
    label, about log n times, until no label changes.
    """
    both = written(edges.select(F.col("a").alias("src"), F.col("b").alias("dst")).unionByName(edges.select(F.col("b").alias("src"), F.col("a").alias("dst"))).distinct())
    labels = written(both.groupBy(F.col("src").alias("node")).agg(F.min("dst").alias("low")).select("node", F.least("node", "low").alias("comp")))
    none = F.lit(None).cast(labels.schema["comp"].dataType)
    while True:
        low = both.join(labels.withColumnRenamed("node", "dst"), "dst").groupBy(F.col("src").alias("node")).agg(F.min("comp").alias("low"))
        near = labels.join(low, "node").select("node", F.least("comp", "low").alias("near"), F.col("comp").alias("old"))
        hook = F.struct(F.col("old").alias("node"), "near", none.alias("old"))
        near = near.select(F.explode(F.array(F.struct("node", "near", "old"), hook)).alias("s")).select("s.*")
        near = written(near.groupBy("node").agg(F.min("near").alias("near"), F.max("old").alias("old")))
        jump = near.select(F.col("node").alias("near"), F.col("near").alias("far"))
        after = written(near.join(jump, "near").select("node", F.least("near", "far").alias("comp"), "old"))
        labels = after.select("node", "comp")
        if not after.where("comp <> old").limit(1).count():
            return labels


def low_stress_islands(edges: DataFrame, lts: str, threshold: float = 2) -> DataFrame:
    """Edges with lowstress, island_id (0.. by smallest node; -1 for others) and island_m, the island's length."""
    level = F.coalesce(F.col(lts).try_cast("double"), F.lit(4.0))
    held = edges.withColumn("lowstress", (level <= threshold).cast("int"))
    calm = held.where("lowstress = 1")
    label = components(calm).select(F.col("node").alias("a"), "comp")
    size = calm.join(label, "a").groupBy("comp").agg(F.sum("len").alias("island_m"))
    ids = written(size.withColumn("island_id", (F.row_number().over(W.orderBy("comp")) - 1).cast("int")))
    named = label.join(ids, "comp").select("a", "island_id", "island_m")
    found = held.join(named, "a", "left")
    own = F.col("lowstress") == 1
    return found.select(*held.columns, F.when(own, F.col("island_id")).otherwise(-1).alias("island_id"), F.when(own, F.col("island_m")).otherwise(0.0).alias("island_m"))


def _searches(graph: Csr, starts: np.ndarray, n: int, radius: float) -> tuple[np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray, np.ndarray]]]:
    """(costs, numbers of shortest paths, rounds) of all n nodes from each start, as flat arrays of n places a start.

    A round settles, in all searches at once, the nodes that no unsettled node can reach for less or the same: below the
    least cost at hand plus their own cheapest edge, or plus each node's cheapest edge. It holds its steps as (place before,
    place, edge's place); a node's steps lie in one round, behind the rounds of all nodes before it.
    """
    degree, ends = np.zeros(n, "i8"), np.full(n, INF)
    degree[: graph.n] = np.diff(graph.indptr)
    first = np.cumsum(degree) - degree
    np.minimum.at(ends, np.repeat(np.arange(n), degree), graph.cost)
    cost, paths = np.full(len(starts) * n, INF), np.zeros(len(starts) * n)
    settled, owner = np.zeros(len(cost), bool), np.zeros(len(cost), "i8")
    edge, rounds = np.nan_to_num(ends, posinf=0.0), []
    front = np.arange(len(starts)) * n + starts
    cost[front], paths[front] = 0.0, 1.0
    while len(front):
        d, own = cost[front], edge[front % n]
        low = d.min()
        sure = np.maximum(low + own, (d + own).min())
        now = (d < sure - 2e-9 * np.maximum(sure, 1.0)) | (d == low)
        done, front = front[now], front[~now]
        node = done % n
        k = degree[node]
        at = np.repeat(first[node] - np.cumsum(k) + k, k) + np.arange(k.sum())
        here, there = np.repeat(done, k), np.repeat(done - node, k) + graph.dst[at]
        dh, dt, step = cost[here], cost[there], graph.cost[at]
        back = settled[there] & (np.abs(dt + step - dh) <= 1e-9 * np.maximum(dh, 1.0))
        before, after = there[back], here[back]
        np.add.at(paths, after, paths[before])
        rounds.append((before, after, at[back]))
        settled[done] = True
        new = dh + step
        on = np.flatnonzero((new < dt) & (new <= radius) & ~settled[there])
        fresh = there[on[np.isinf(dt[on])]]
        np.minimum.at(cost, there[on], new[on])
        owner[fresh] = np.arange(len(fresh))
        front = np.concatenate([front, fresh[owner[fresh] == np.arange(len(fresh))]])
    return cost, paths, rounds


def _shortest_paths(nodes: DataFrame, edges: DataFrame, radius: float | None, samples: int, by_edge: bool) -> tuple[DataFrame, DataFrame, int]:
    """(a row for each node: reach, closeness, harm_clo, straight; (place, between) of the places on paths; number of
    nodes). A task adds up its searches' shares, so a place has one row a task. With samples, only paths from so many
    nodes count, for all."""
    spots = nodes.select("node_id", "x", "y").orderBy("node_id").toPandas() if nodes.count() <= BROADCAST_EDGES else None
    if spots is None:
        raise ValueError("too many nodes to be sent to every task")
    context = edges.sparkSession.sparkContext
    shared, place = context.broadcast(csr_of(edges)), context.broadcast((spots["x"].to_numpy(), spots["y"].to_numpy()))
    total = len(spots)
    used = samples if 0 < samples < total else total
    # The sample: the nodes whose digests are smallest, the same ones in every run.
    chosen = nodes.select("node_id").orderBy(F.xxhash64("node_id"), "node_id").limit(used).withColumn("counts", F.lit(True))
    sources = nodes.select("node_id").join(F.broadcast(chosen), "node_id", "left").select("node_id", F.coalesce("counts", F.lit(False)).alias("counts"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        graph, (x, y) = shared.value, place.value
        names, number = np.unique(graph.edge, return_inverse=True) if by_edge else (np.arange(total), None)
        sums = np.zeros(len(names))
        for rows in batches:
            for i in range(0, len(rows), at_once := max(1, SEARCH_PLACES // max(total, 1))):
                some = rows.iloc[i : i + at_once]
                s, counts = some["node_id"].to_numpy("i8"), some["counts"].to_numpy(bool)
                flat, paths, rounds = _searches(graph, s, total, INF if radius is None else radius)
                share = np.zeros(len(flat))
                for before, after, at in reversed(rounds):
                    part = paths[before] / paths[after] * (1 + share[after]) * counts[after // total]
                    np.add.at(share, before, part)
                    if by_edge:
                        np.add.at(sums, number[at], part)
                if not by_edge:
                    share[np.arange(len(s)) * total + s] = 0.0
                    sums += share.reshape(-1, total).sum(axis=0)
                cost = flat.reshape(-1, total)
                reach, far = np.isfinite(cost).sum(axis=1), np.isfinite(cost) & (cost > 0)
                given = np.where(far, cost, 1.0)
                farness, n_far = np.where(far, cost, 0.0).sum(axis=1), far.sum(axis=1)
                straight = np.where(far, np.hypot(x - x[s][:, None], y - y[s][:, None]) / given, 0.0).sum(axis=1) / np.maximum(n_far, 1)
                close = np.where((farness > 0) & (total > 1), (reach - 1) / np.where(farness > 0, farness, 1.0) * (reach - 1) / max(total - 1, 1), 0.0)
                yield pd.DataFrame({"node_id": s, "reach": reach, "closeness": close, "harm_clo": np.where(far, 1 / given, 0.0).sum(axis=1), "straight": straight, "place": None, "part": None})
        on = np.flatnonzero(sums)
        for i in range(0, len(on), 100_000):
            some = on[i : i + 100_000]
            yield pd.DataFrame({"node_id": None, "reach": None, "closeness": None, "harm_clo": None, "straight": None, "place": names[some], "part": sums[some]})

    dealt = sources.repartition(context.defaultParallelism * 2)
    found = written(dealt.mapInPandas(run, "node_id long, reach int, closeness double, harm_clo double, straight double, place long, part double"))
    between = found.where("place is not null").groupBy("place").agg((F.sum("part") * (total / used / 2 if used else 0.0)).alias("between"))
    return found.where("node_id is not null").drop("place", "part"), between, total


def centrality(nodes: DataFrame, edges: DataFrame, radius: float | None = None, samples: int = 0) -> DataFrame:
    """node_id, degree, reach, closeness, harm_clo, straight, betweenness (each pair once), betw_norm.

    reach counts nodes within the radius, the source too; closeness is (reach - 1) / cost sum, times the share of
    all other nodes that is reached. One shortest path search per node, many at once as arrays; equal paths share their count. With samples,
    betweenness is estimated from the paths of so many nodes (picked by a digest of node_id), scaled to all.
    """
    found, between, total = _shortest_paths(nodes, edges, radius, samples, by_edge=False)
    pairs = (total - 1) * (total - 2) / 2
    held = found.join(between.toDF("node_id", "betweenness"), "node_id", "left").join(street_nodes(nodes, edges).drop("node_type"), "node_id", "left").withColumn("betweenness", F.coalesce("betweenness", F.lit(0.0)))
    return held.select("node_id", F.coalesce("degree", F.lit(0)).alias("degree"), "reach", "closeness", "harm_clo", "straight", "betweenness", (F.col("betweenness") / pairs if pairs > 0 else F.lit(0.0)).alias("betw_norm"))


def edge_centrality(nodes: DataFrame, edges: DataFrame, radius: float | None = None, samples: int = 0) -> DataFrame:
    """edge_id, betw_edge (shortest paths along an edge, each pair once), clo_mean and str_mean (of its two ends).

    samples as in centrality().
    """
    found, between, _ = _shortest_paths(nodes, edges, radius, samples, by_edge=True)
    ends = found.select("node_id", "closeness", "straight")
    held = edges.select("edge_id", "a", "b").join(ends.toDF("a", "ca", "sa"), "a").join(ends.toDF("b", "cb", "sb"), "b").join(between.toDF("edge_id", "betw_edge"), "edge_id", "left")
    mean = lambda one, other: (F.col(one) + F.col(other)) / 2
    return held.select("edge_id", F.coalesce("betw_edge", F.lit(0.0)).alias("betw_edge"), mean("ca", "cb").alias("clo_mean"), mean("sa", "sb").alias("str_mean"))


def eigenvector(edges: DataFrame, rounds: int = 200, tolerance: float = 1e-10) -> DataFrame:
    """node_id, eigen (largest 1): power iteration on the adjacency and the identity, parallel edges counted apart.

    One task multiplies the broadcast arrays (at most BROADCAST_EDGES edges): each round needs the whole of the last.
    """
    spark = edges.sparkSession
    shared = spark.sparkContext.broadcast(csr_of(edges))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        graph = shared.value
        src = np.repeat(np.arange(graph.n), np.diff(graph.indptr))
        for _ in batches:
            x = np.ones(graph.n)
            for _ in range(rounds):
                y = x + np.bincount(graph.dst, weights=x[src], minlength=graph.n)
                y /= max(y.max(), 1e-300)
                done = np.abs(y - x).max() < tolerance
                x = y
                if done:
                    break
            yield pd.DataFrame({"node_id": np.arange(graph.n), "eigen": x})

    return spark.range(1 if shared.value.n else 0).coalesce(1).mapInPandas(run, "node_id long, eigen double")


def link_criticality(nodes: DataFrame, edges: DataFrame, origins: DataFrame, destinations: DataFrame | None = None, cutoff: float | None = None) -> DataFrame:
    """edge_id, criticality, extra_cost, n_disconnected, used_by, length_m: what losing an edge adds to all routes.

    Base paths and, for each edge that some path uses, the paths of its users without it run in parallel over
    edges; edges that no path uses have zeros.
    """
    o = nearest_node(origins, nodes).select("node_id").distinct()
    d = o if destinations is None else nearest_node(destinations, nodes).select("node_id").distinct()
    ends = sorted(r.node_id for r in d.collect())
    aim = edges.sparkSession.sparkContext.broadcast(ends)

    def base(graph: Csr, rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        for s in map(int, rows["node_id"]):
            dist, _, before = graph.search([(s, 0.0)], cutoff)
            out += [(s, t, dist[t], graph.path(before, t)) for t in aim.value if t != s and t in dist]
        return pd.DataFrame(out, columns=["source", "target", "cost", "path"])

    routes = written(per_source(edges, o, base, "source long, target long, cost double, path array<long>"))
    total = routes.agg(F.sum("cost")).first()[0] or 0.0
    users = routes.select(F.explode("path").alias("edge_id"), "source", "target", "cost").groupBy("edge_id", "source").agg(F.collect_list(F.struct("target", "cost")).alias("pairs"))

    def again(graph: Csr, rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        for e, s, pairs in zip(rows["edge_id"], rows["source"], rows["pairs"], strict=True):
            dist = graph.search([(int(s), 0.0)], cutoff, drop=int(e))[0]
            lost = [p for p in pairs if p["target"] not in dist]
            extra = sum(dist[p["target"]] - p["cost"] for p in pairs if p["target"] in dist)
            out.append((e, float(extra), len(lost), len(pairs)))
        return pd.DataFrame(out, columns=["edge_id", "extra", "lost", "used"])

    found = per_source(edges, users, again, "edge_id long, extra double, lost long, used long").groupBy("edge_id").agg(F.sum("extra").alias("extra"), F.sum("lost").alias("lost"), F.sum("used").alias("used"))
    held = edges.select("edge_id", F.col("len").alias("length_m")).join(found, "edge_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    extra = F.coalesce("extra", F.lit(0.0))
    return held.select("edge_id", (extra / total if total > 0 else F.lit(0.0)).alias("criticality"), extra.alias("extra_cost"), zero("lost").cast("long").alias("n_disconnected"), zero("used").cast("long").alias("used_by"), "length_m")


def isochrone_edges(edges: DataFrame, reach: DataFrame, breaks: list[float]) -> DataFrame:
    """Pieces of edges by cost band: edge_id, from_m, to_m, band (the break that covers the piece).

    reach: (node, cost). A point of an edge has the smaller of the costs over its two ends; each end covers the
    part of the edge up to what the break leaves, and the parts may meet in the middle.
    """
    r = reach.select(F.col("node").alias("n"), F.col("cost").alias("c"))
    held = edges.join(r.withColumnsRenamed({"n": "a", "c": "ca"}), "a", "left").join(r.withColumnsRenamed({"n": "b", "c": "cb"}), "b", "left")
    rate = F.col("len") / F.col("cost")
    limits = F.array(*[F.lit(float(b)) for b in sorted(breaks)])
    spans = F.transform(limits, lambda t: F.struct(t.alias("t"), F.least(F.greatest(t - F.coalesce("ca", F.lit(INF)), F.lit(0.0)) * rate, F.col("len")).alias("u"), F.least(F.greatest(t - F.coalesce("cb", F.lit(INF)), F.lit(0.0)) * rate, F.col("len")).alias("v")))
    each = held.withColumn("_spans", spans).select("edge_id", "len", F.posexplode("_spans").alias("i", "s"), "_spans")
    before = F.when(F.col("i") > 0, F.get("_spans", F.col("i") - 1))
    lo_u, lo_v = F.coalesce(before["u"], F.lit(0.0)), F.coalesce(before["v"], F.lit(0.0))
    u, v, whole = F.col("s.u"), F.col("s.v"), F.col("len")
    meets = u + v >= whole
    # From a: (lo_u, u); from b: (len - v, len - lo_v); if they meet, the piece between what the smaller break left.
    parts = F.when(lo_u + lo_v >= whole, F.array()).when(meets, F.array(F.struct(lo_u.alias("from_m"), (whole - lo_v).alias("to_m")))).otherwise(F.array(F.struct(lo_u.alias("from_m"), u.alias("to_m")), F.struct((whole - v).alias("from_m"), (whole - lo_v).alias("to_m"))))
    pieces = each.select("edge_id", F.col("s.t").alias("band"), F.explode(parts.cast("array<struct<from_m: double, to_m: double>>")).alias("p"))
    return pieces.select("edge_id", "p.from_m", "p.to_m", "band").where("to_m - from_m > 1e-9")
