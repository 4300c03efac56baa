"""Service areas: which part of every street is within a cost of a facility, exactly, and the areas around it.

A facility enters the network at the nearest place of the nearest street, so within an edge: both ends are starts,
with what the way to them costs, and the edge has a piece around the entry. What is reached of an edge is a set of
intervals of its length from 0 (end a) to 1 (end b); their union and difference are column expressions. Edges are rows
(edge_id, a, b, cost, len, pts), as of network.build_graph(lines, keep=["pts"]). All facilities together are the scope
with a null source.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from urbanloom.functions.scratch import written
from urbanloom.operators import network, overlay

EPS = 1e-9
SPANS = "array<struct<lo: double, hi: double>>"
#: Segments of a quarter circle in buffers of streets, and in the circles that areas are held against.
ARC, CIRCLE_ARC = 8, 64


def merge_spans(spans: Column) -> Column:
    """The union of intervals (structs lo, hi), cut to 0..1, in order; parts up to EPS are left out."""
    cut = F.transform(spans, lambda s: F.struct(F.greatest(F.lit(0.0), s["lo"]).alias("lo"), F.least(F.lit(1.0), s["hi"]).alias("hi")))
    real = F.array_sort(F.filter(cut, lambda s: s["hi"] - s["lo"] > EPS))

    def add(done: Column, s: Column) -> Column:
        last = F.element_at(done, -1)
        joined = F.array(F.struct(last["lo"].alias("lo"), F.greatest(last["hi"], s["hi"]).alias("hi")))
        return F.when((F.size(done) > 0) & (s["lo"] <= F.try_element_at(done, F.lit(-1))["hi"] + EPS), F.concat(F.slice(done, 1, F.size(done) - 1), joined)).otherwise(F.concat(done, F.array(s)))

    return F.aggregate(real, F.array().cast(SPANS), add)


def subtract_spans(spans: Column, others: Column) -> Column:
    """The difference of two unions of intervals."""

    def cut(pieces: Column, o: Column) -> Column:
        def each(p: Column) -> Column:
            left = F.struct(p["lo"].alias("lo"), F.least(o["lo"], p["hi"]).alias("hi"))
            right = F.struct(F.greatest(o["hi"], p["lo"]).alias("lo"), p["hi"].alias("hi"))
            return F.when((o["hi"] <= p["lo"] + EPS) | (o["lo"] >= p["hi"] - EPS), F.array(p)).otherwise(F.filter(F.array(left, right), lambda x: x["hi"] - x["lo"] > EPS))

        return F.flatten(F.transform(pieces, each))

    return F.aggregate(others, spans.cast(SPANS), cut)


def spans_length(spans: Column) -> Column:
    return F.aggregate(spans, F.lit(0.0), lambda n, s: n + s["hi"] - s["lo"])


def _along(pts: Column) -> Column:
    """The length of a polyline up to each of its points."""
    steps = F.zip_with(F.slice(pts, 1, F.size(pts) - 1), F.slice(pts, 2, F.size(pts)), lambda a, b: F.hypot(a["x"] - b["x"], a["y"] - b["y"]))
    return F.aggregate(steps, F.array(F.lit(0.0)), lambda done, d: F.concat(done, F.array(F.element_at(done, -1) + d)))


def point_at(pts: Column, t: Column) -> Column:
    """The point at a fraction of a polyline's length."""
    cum = _along(pts)
    at = F.least(F.greatest(t, F.lit(0.0)), F.lit(1.0)) * F.element_at(cum, -1)
    i = F.least(F.greatest(F.size(F.filter(cum, lambda c: c <= at)), F.lit(1)), F.size(pts) - 1)
    step = F.element_at(cum, i + 1) - F.element_at(cum, i)
    u = F.when(step > EPS, (at - F.element_at(cum, i)) / F.when(step > EPS, step)).otherwise(0.0)
    p, q = F.element_at(pts, i), F.element_at(pts, i + 1)
    return F.struct((p["x"] + u * (q["x"] - p["x"])).alias("x"), (p["y"] + u * (q["y"] - p["y"])).alias("y"))


def cut_line(pts: Column, lo: Column, hi: Column) -> Column:
    """The polyline between two fractions of its length, its points within included; null if it has no length."""
    cum = _along(pts)
    whole = F.element_at(cum, -1)
    flat = F.transform(pts, lambda p: F.struct(p["x"].cast("double").alias("x"), p["y"].cast("double").alias("y")))
    inner = F.filter(flat, lambda p, i: (F.element_at(cum, i + 1) > lo * whole + EPS) & (F.element_at(cum, i + 1) < hi * whole - EPS))
    every = F.concat(F.array(point_at(pts, lo)), inner, F.array(point_at(pts, hi)))

    def add(done: Column, p: Column) -> Column:
        last = F.element_at(done, -1)
        return F.when(F.hypot(p["x"] - last["x"], p["y"] - last["y"]) > EPS, F.concat(done, F.array(p))).otherwise(done)

    kept = F.aggregate(F.slice(every, 2, F.size(every)), F.slice(every, 1, 1), add)
    return F.when((whole > EPS) & (hi - lo > EPS) & (F.size(kept) > 1), kept)


def nearest_edge(points: DataFrame, edges: DataFrame, cell: float | None = None) -> DataFrame:
    """points (x, y) with edge_id, t (the nearest place's fraction of its length) and snap_m of their nearest edge
    (ties: smaller edge_id, then the earlier segment). Points without coordinates find none.

    Segments lie in the cells that their boxes meet. Points meet the segments of the 3 x 3 cells around them; those
    whose best segment is not surely the nearest go on with cells four times as large. A point outside the bounds
    looks around its nearest place on them (see network.nearest_node).
    """
    pairs = F.zip_with(F.slice("pts", 1, F.size("pts") - 1), F.slice("pts", 2, F.size("pts")), lambda a, b: F.struct(a["x"].alias("ax"), a["y"].alias("ay"), b["x"].alias("bx"), b["y"].alias("by")))
    segments = written(edges.where(F.size("pts") >= 2).select("edge_id", F.posexplode(pairs).alias("i", "s")).select("edge_id", "i", "s.*"))
    far = F.hypot(F.col("bx") - F.col("ax"), F.col("by") - F.col("ay"))
    bounds = segments.agg(*[f(g(f"a{c}", f"b{c}")).alias(f"{c}{n}") for c in "xy" for n, f, g in ((0, F.min, F.least), (1, F.max, F.greatest))], F.count(F.lit(1)).alias("n"), F.avg(far).alias("mean")).first()
    if not bounds.n:
        return points.select("*", F.lit(None).cast("long").alias("edge_id"), F.lit(None).cast("double").alias("t"), F.lit(None).cast("double").alias("snap_m"))
    span = max(bounds.x1 - bounds.x0, bounds.y1 - bounds.y0, 1.0)
    cell = cell or max(span / max(1.0, bounds.n**0.5), bounds.mean, span * 1e-6)
    near = lambda c: F.least(F.greatest(F.col(c), F.lit(bounds[f"{c}0"])), F.lit(bounds[f"{c}1"]))
    whole, done = written(points.repartition(4 * points.sparkSession.sparkContext.defaultParallelism).select("*", F.monotonically_increasing_id().alias("_pid"))), []
    todo = whole.where("x is not null and y is not null and not isnan(x) and not isnan(y)")
    todo = todo.select("_pid", "x", "y", near("x").alias("px"), near("y").alias("py"))
    around = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    out = F.hypot(F.col("x") - F.col("px"), F.col("y") - F.col("py"))

    def best_of(get: Callable[[str], Column]) -> Column:
        """struct<d, edge_id, i, u> of the point to a segment."""
        ux, uy = get("bx") - get("ax"), get("by") - get("ay")
        square = ux * ux + uy * uy
        u = F.when(square > 0, F.least(F.greatest(((F.col("x") - get("ax")) * ux + (F.col("y") - get("ay")) * uy) / F.when(square > 0, square), F.lit(0.0)), F.lit(1.0))).otherwise(0.0)
        d = F.hypot(F.col("x") - get("ax") - u * ux, F.col("y") - get("ay") - u * uy)
        return F.struct(d.alias("d"), get("edge_id").alias("edge_id"), get("i").alias("i"), u.alias("u"))

    while True:
        last = cell >= span
        cells = lambda c: F.sequence(F.floor(F.least(f"a{c}", f"b{c}") / cell), F.floor(F.greatest(f"a{c}", f"b{c}") / cell))
        at = segments.withColumn("ci", F.explode(cells("x"))).withColumn("cj", F.explode(cells("y"))).select("*", around.alias("o"))
        at = at.withColumns({"ci": F.col("ci") + F.col("o.i"), "cj": F.col("cj") + F.col("o.j")}).drop("o").distinct()
        own = todo.withColumns({"ci": F.floor(F.col("px") / cell), "cj": F.floor(F.col("py") / cell)})
        crowd = at.groupBy("ci", "cj").count().agg(F.max("count")).first()[0]
        if crowd <= network.CROWD:
            held = written(at.groupBy("ci", "cj").agg(F.collect_list(F.struct(*segments.columns)).alias("_near")))
            best = own.join(held, ["ci", "cj"]).select("_pid", F.array_min(F.transform("_near", lambda s: best_of(lambda c: s[c]))).alias("b"), out.alias("out"))
        else:
            best = own.join(at, ["ci", "cj"]).groupBy("_pid").agg(F.min(best_of(F.col)).alias("b"), F.first(out).alias("out"))
        best = best.select("_pid", "b.edge_id", "b.i", "b.u", F.col("b.d").alias("snap_m"), "out")
        best = written((best if last else best.where(F.col("snap_m") <= F.hypot("out", F.lit(cell)))).drop("out"))
        done.append(best)
        # Rows of points are never broadcast, however small their files are.
        todo = written(todo.join(best.hint("merge"), "_pid", "left_anti"))
        if last or not todo.limit(1).count():
            break
        cell *= 4
    every = done[0]
    for more in done[1:]:
        every = every.unionByName(more)
    cum = _along(F.col("pts"))
    arc = F.element_at(cum, F.col("i") + 1) + F.col("u") * (F.element_at(cum, F.col("i") + 2) - F.element_at(cum, F.col("i") + 1))
    fraction = F.when(F.element_at(cum, -1) > 0, F.least(arc / F.when(F.element_at(cum, -1) > 0, F.element_at(cum, -1)), F.lit(1.0))).otherwise(0.0)
    placed = every.join(edges.select("edge_id", "pts"), "edge_id").select("_pid", "edge_id", fraction.alias("t"), "snap_m")
    return whole.join(placed.hint("merge"), "_pid", "left").drop("_pid")


def entries(edges: DataFrame, facilities: DataFrame, snap_counts: bool = True) -> DataFrame:
    """source, edge_id, t, snap (the cost of the way to the street: its length, or 0 if costs are no lengths) and
    snap_m for facilities (id, x, y)."""
    found = nearest_edge(facilities.select(F.col("id").alias("source"), "x", "y"), edges).where("edge_id is not null")
    return written(found.select("source", "edge_id", "t", (F.col("snap_m") if snap_counts else F.lit(0.0)).alias("snap"), "snap_m", "x", "y"))


def _starts(edges: DataFrame, placed: DataFrame) -> DataFrame:
    """source, node_id, offset: both ends of the street of each entry."""
    both = placed.join(edges.select("edge_id", "a", "b", "cost"), "edge_id")
    ends = F.array(F.struct(F.col("a").alias("node_id"), (F.col("snap") + F.col("t") * F.col("cost")).alias("offset")), F.struct(F.col("b").alias("node_id"), (F.col("snap") + (1 - F.col("t")) * F.col("cost")).alias("offset")))
    return both.select("source", F.explode(ends).alias("e")).select("source", "e.*")


def reach(edges: DataFrame, placed: DataFrame, breaks: list[float], each: bool = False) -> DataFrame:
    """source, edge_id, spans: for every edge with any reach, an array with the union of its reached intervals for each
    break, in rising order. The scope of all facilities has a null source; with `each`, each facility has one too."""
    starts = written(_starts(edges, placed))
    top = max(breaks)
    together = network.nearest_source(edges, starts.select("node_id", F.lit(0).alias("start"), "offset"), top)
    costs = together.select(F.lit(None).cast("long").alias("source"), "node", "cost")
    entered = placed.select(F.lit(None).cast("long").alias("source"), "edge_id", "t", "snap")
    if each:
        costs = costs.unionByName(network.costs_from_places(edges, starts, top))
        entered = entered.unionByName(placed.select("source", "edge_id", "t", "snap"))
    costs = written(costs)
    nothing = F.lit(None).cast("double")
    links = edges.select("edge_id", "a", "b")

    def over(end: str) -> DataFrame:
        """Costs at one end of the edges."""
        met = links.join(costs, links[end] == costs["node"])
        return met.select("source", "edge_id", *[(F.col("cost") if e == end else nothing).alias(f"c{e}") for e in "ab"], nothing.alias("t"), nothing.alias("snap"))

    rows = over("a").unionByName(over("b")).unionByName(entered.select("source", "edge_id", nothing.alias("ca"), nothing.alias("cb"), "t", "snap"))
    held = rows.groupBy("source", "edge_id").agg(F.min("ca").alias("ca"), F.min("cb").alias("cb"), F.collect_list(F.when(F.col("t").isNotNull(), F.struct("t", "snap"))).alias("at"))
    held = held.join(edges.select("edge_id", F.greatest("cost", F.lit(EPS)).alias("c")), "edge_id")

    def spans(limit: float) -> Column:
        part = lambda c: F.least(F.greatest((limit - F.coalesce(c, F.lit(float("inf")))) / F.col("c"), F.lit(0.0)), F.lit(1.0))
        fa, fb = part(F.col("ca")), part(F.col("cb"))
        own = F.array(F.struct(F.lit(0.0).alias("lo"), fa.alias("hi")), F.struct((1 - fb).alias("lo"), F.lit(1.0).alias("hi")))
        left = lambda e: F.greatest(limit - e["snap"], F.lit(0.0)) / F.col("c")
        around = F.transform("at", lambda e: F.struct((e["t"] - left(e)).alias("lo"), (e["t"] + left(e)).alias("hi")))
        return merge_spans(F.concat(own, around))

    found = held.select("source", "edge_id", F.array(*[spans(float(b)) for b in sorted(breaks)]).alias("spans"))
    return found.where(F.size(F.element_at("spans", -1)) > 0)


def pieces(edges: DataFrame, reached: DataFrame, breaks: list[float], rings: bool = True) -> DataFrame:
    """source, edge_id, band (the break), lo, hi, len_m and pts of the reached parts of streets; with rings, each band
    without the part that the smaller break reaches."""
    order = sorted(float(b) for b in breaks)
    rows = [F.struct(F.lit(b).alias("band"), (subtract_spans(F.col("spans")[i], F.col("spans")[i - 1]) if rings and i else F.col("spans")[i]).alias("s")) for i, b in enumerate(order)]
    each = reached.select("source", "edge_id", F.explode(F.array(*rows)).alias("r")).select("source", "edge_id", "r.band", F.explode("r.s").alias("s"))
    held = each.join(edges.select("edge_id", "len", "pts"), "edge_id")
    out = held.select("source", "edge_id", "band", "s.lo", "s.hi", ((F.col("s.hi") - F.col("s.lo")) * F.col("len")).alias("len_m"), cut_line(F.col("pts"), F.col("s.lo"), F.col("s.hi")).alias("pts"))
    return out.where("pts is not null")


def _arc(x: Column, y: Column, radius: float | Column, first: Column, steps: int, step: float) -> Column:
    """Points of a circle from the angle `first` on."""
    angles = F.transform(F.sequence(F.lit(0), F.lit(steps)), lambda k: first + k * step)
    return F.transform(angles, lambda a: F.struct((x + radius * F.cos(a)).alias("x"), (y + radius * F.sin(a)).alias("y")))


def street_buffers(cut: DataFrame, width: float | Column, keys: list[str] | None = None) -> DataFrame:
    """The keys (source and band) and convex rings whose union is everything within `width` of polylines (pts)."""
    keys = ["source", "band"] if keys is None else keys
    width = width if isinstance(width, Column) else F.lit(float(width))
    pairs = F.zip_with(F.slice("pts", 1, F.size("pts") - 1), F.slice("pts", 2, F.size("pts")), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    rows = cut.select(*keys, width.alias("_w"), F.explode(pairs).alias("s"))
    width = F.col("_w")
    a, b = F.col("s.a"), F.col("s.b")
    away, step = F.atan2(b["y"] - a["y"], b["x"] - a["x"]), 3.141592653589793 / 2 / ARC
    ring = F.concat(_arc(b["x"], b["y"], width, away - 3.141592653589793 / 2, 2 * ARC, step), _arc(a["x"], a["y"], width, away + 3.141592653589793 / 2, 2 * ARC, step))
    return rows.select(*keys, ring.alias("ring"))


def circles(placed: DataFrame, breaks: list[float], each: bool = False) -> DataFrame:
    """source, band and rings of circles of the breaks around facilities."""
    step = 3.141592653589793 / 2 / CIRCLE_ARC
    rows = placed.select(F.lit(None).cast("long").alias("source"), "x", "y")
    rows = rows.unionByName(placed.select("source", "x", "y")) if each else rows
    whole = F.explode(F.array(*[F.struct(F.lit(float(b)).alias("band"), _arc(F.col("x"), F.col("y"), float(b), F.lit(0.0), 4 * CIRCLE_ARC - 1, step).alias("ring")) for b in breaks]))
    return rows.select("source", whole.alias("c")).select("source", "c.*")


def areas(placed: DataFrame, cut: DataFrame, method: str = "buffer", width: float = 30.0) -> DataFrame:
    """source, band, area of what cumulative pieces (rings=False) cover: buffers of the streets, or the convex hull of
    their points (no farther apart than a 32nd of the band) and the facilities of the scope."""
    if method == "buffer":
        return overlay.union_area(street_buffers(cut, width), ["source", "band"])
    if method != "hull":
        raise ValueError("the method must be buffer or hull")
    pairs = F.zip_with(F.slice("pts", 1, F.size("pts") - 1), F.slice("pts", 2, F.size("pts")), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    rows = cut.select("source", "band", F.explode(pairs).alias("s"))
    size = F.hypot(F.col("s.b.x") - F.col("s.a.x"), F.col("s.b.y") - F.col("s.a.y"))
    n = F.greatest(F.ceil(size / F.greatest(F.col("band") / 32, F.lit(1.0))), F.lit(1)).cast("int")
    rows = rows.select("source", "band", "s", n.alias("n"), F.explode(F.sequence(F.lit(0), n)).alias("k"))
    u = F.col("k") / F.col("n")
    points = rows.select("source", "band", *[(F.col(f"s.a.{c}") + u * (F.col(f"s.b.{c}") - F.col(f"s.a.{c}"))).alias(c) for c in "xy"])
    bands = cut.select("source", "band").distinct()
    own = bands.where("source is not null").join(placed.select("source", "x", "y"), "source").select("source", "band", "x", "y")
    all_ = bands.where("source is null").crossJoin(placed.select("x", "y")).select("source", "band", "x", "y")
    return overlay.hulls(points.unionByName(own).unionByName(all_), ["source", "band"]).select("source", "band", "area")


def summary(placed: DataFrame, edges: DataFrame, reached: DataFrame, breaks: list[float], each: bool = False, method: str = "buffer", width: float = 30.0) -> DataFrame:
    """source, band, circle_area, net_area, pedshed (their ratio), street_len for every scope and break."""
    cut = written(pieces(edges, reached, breaks, rings=False))
    streets = cut.groupBy("source", "band").agg(F.sum("len_m").alias("street_len"))
    net = areas(placed, cut, method, width).withColumnRenamed("area", "net_area")
    round_ = overlay.union_area(circles(placed, breaks, each), ["source", "band"]).withColumnRenamed("area", "circle_area")
    out = round_
    for more in (net, streets):
        name = more.columns[-1]
        other = more.select(F.col("source").alias("_s"), F.col("band").alias("_b"), name)
        out = out.join(other, F.col("source").eqNullSafe(F.col("_s")) & (F.col("band") == F.col("_b")), "left").drop("_s", "_b")
    zero = lambda c: F.coalesce(c, F.lit(0.0)).alias(c)
    return out.select("source", "band", "circle_area", zero("net_area"), F.when(F.col("circle_area") > 0, F.coalesce("net_area", F.lit(0.0)) / F.col("circle_area")).otherwise(0.0).alias("pedshed"), zero("street_len"))
