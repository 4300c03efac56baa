"""Lines of sight and buildings: which ones meet, noise behind buildings, air in streets with walls on both sides.

A sight is a straight line from (ax, ay) to (bx, by); buildings are rows (building_id, ext, holes) of rings. Sights and
the sides of buildings meet in the square cells that they run through, so a pair is tested only where both pass; tests
are signs of cross products of the given coordinates. Buildings that hold a whole sight are found by its start.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from urbanloom.functions.scratch import written
from urbanloom.operators import environment, street
from urbanloom.operators.form import _pairs
from urbanloom.operators.overlay import POINTS
from urbanloom.operators.service_areas import nearest_edge, point_at

#: Widening of what a line covers of a column of cells, as part of a cell: no line that touches a border is missed.
EDGE = 1e-6
#: Pairs of a sight and a side that are tested at once, about.
PAIRS = 200_000


def _cells(rows: DataFrame, cell: float) -> DataFrame:
    """rows (ax, ay, bx, by, ...) once for each cell (ci, cj) that the line runs through, or within EDGE of it."""
    low = lambda a, b: F.floor(F.least(a, b) / cell - EDGE)
    high = lambda a, b: F.floor(F.greatest(a, b) / cell + EDGE)
    each = rows.withColumn("ci", F.explode(F.sequence(low(F.col("ax"), F.col("bx")), high(F.col("ax"), F.col("bx")))))
    left, right = F.least("ax", "bx"), F.greatest("ax", "bx")
    span = F.col("bx") - F.col("ax")

    def at(x: Column) -> Column:
        inside = F.least(F.greatest(x, left), right)
        return F.when(span == 0, F.lit(None)).otherwise(F.col("ay") + (inside - F.col("ax")) / F.nullif(span, F.lit(0.0)) * (F.col("by") - F.col("ay")))

    u, v = at((F.col("ci") - EDGE) * cell), at((F.col("ci") + 1 + EDGE) * cell)
    # A steep line covers much of y within EDGE of a column: both ends of the widened column bound it.
    u, v = F.coalesce(u, F.col("ay")), F.coalesce(v, F.col("by"))
    return each.withColumn("cj", F.explode(F.sequence(low(u, v), high(u, v))))


def _turn(ax: Column, ay: Column, bx: Column, by: Column, cx: Column, cy: Column) -> Column:
    """-1, 0 or 1: the side of c on the way from a to b."""
    return F.signum((bx - ax) * (cy - ay) - (by - ay) * (cx - ax))


def sides_of(buildings: DataFrame) -> DataFrame:
    """building_id and the ends of every side of all rings."""
    rings = F.concat(F.array(F.col("ext").cast(POINTS)), F.coalesce(F.col("holes").cast(f"array<{POINTS}>"), F.array().cast(f"array<{POINTS}>")))
    each = buildings.where(F.size("ext") >= 3).select("building_id", F.explode(F.flatten(F.transform(rings, _pairs))).alias("s"))
    return each.select("building_id", *[F.col(f"s.{p}.{c}").alias(f"{p}{c}") for p in "ab" for c in "xy"])


def within_buildings(points: DataFrame, buildings: DataFrame, cell: float) -> DataFrame:
    """(point_id, building_id) of points (point_id, x, y) inside buildings, by the parity of sides to their right."""
    ring = lambda f, axis: f(F.transform("ext", lambda p: p[axis]))
    boxes = buildings.where(F.size("ext") >= 3)
    for axis, name in (("x", "ci"), ("y", "cj")):
        boxes = boxes.withColumn(name, F.explode(F.sequence(F.floor(ring(F.array_min, axis) / cell), F.floor(ring(F.array_max, axis) / cell))))
    at = points.withColumns({"ci": F.floor(F.col("x") / cell), "cj": F.floor(F.col("y") / cell)})
    rings = F.concat(F.array(F.col("ext").cast(POINTS)), F.coalesce(F.col("holes").cast(f"array<{POINTS}>"), F.array().cast(f"array<{POINTS}>")))

    def right(s: Column) -> Column:
        a, b = s["a"], s["b"]
        meet = a["x"] + (F.col("y") - a["y"]) * (b["x"] - a["x"]) / F.nullif(b["y"] - a["y"], F.lit(0.0))
        return F.coalesce(((a["y"] > F.col("y")) != (b["y"] > F.col("y"))) & (F.col("x") < meet), F.lit(False))

    odd = F.size(F.filter(F.flatten(F.transform(rings, _pairs)), right)) % 2 == 1
    return at.join(boxes, ["ci", "cj"]).where(odd).select("point_id", "building_id")


def crossings(sights: DataFrame, buildings: DataFrame, cell: float = 50.0) -> DataFrame:
    """(sight_id, building_id), each pair once, of sights (sight_id, ax, ay, bx, by) and the buildings they meet: cross,
    touch or lie in. Rows with a null coordinate meet nothing; a sight without length is a point."""
    known = sights.where("ax is not null and ay is not null and bx is not null and by is not null").select("sight_id", "ax", "ay", "bx", "by")
    held = _cells(known, cell)
    walls = _cells(sides_of(buildings), cell).select("building_id", "ci", "cj", *[F.col(f"{p}{c}").alias(f"{q}{c}") for p, q in (("a", "p"), ("b", "q")) for c in "xy"])
    a, b, p, q = ((F.col(f"{n}x"), F.col(f"{n}y")) for n in "abpq")
    t1, t2, t3, t4 = _turn(*a, *b, *p), _turn(*a, *b, *q), _turn(*p, *q, *a), _turn(*p, *q, *b)
    # On one line: the boxes overlap.
    boxes = (F.least("ax", "bx") <= F.greatest("px", "qx")) & (F.least("px", "qx") <= F.greatest("ax", "bx")) & (F.least("ay", "by") <= F.greatest("py", "qy")) & (F.least("py", "qy") <= F.greatest("ay", "by"))
    meet = (t1 * t2 <= 0) & (t3 * t4 <= 0) & boxes
    found = held.join(walls, ["ci", "cj"]).where(meet).select("sight_id", "building_id")
    starts = known.select(F.col("sight_id").alias("point_id"), F.col("ax").alias("x"), F.col("ay").alias("y"))
    inside = within_buildings(starts, buildings, cell).withColumnRenamed("point_id", "sight_id")
    return found.unionByName(inside).distinct()


def met_by_sights(sights: DataFrame, buildings: DataFrame, value: Column, cell: float = 50.0) -> DataFrame:
    """sight_id, n, total: how many buildings each sight meets, as crossings() says, and their sum of a value (a column of
    buildings); sights that meet none are absent.

    Sights and buildings go to the square cells of their boxes; a pair counts in the one cell where both ranges of
    cells begin. Pairs never leave their task: a cell's sights meet its sides in blocks.
    """
    low = lambda *c: F.floor(F.least(*c) / cell)
    high = lambda *c: F.floor(F.greatest(*c) / cell)
    known = sights.where("ax is not null and ay is not null and bx is not null and by is not null").select("sight_id", "ax", "ay", "bx", "by", F.monotonically_increasing_id().alias("_n"))
    left = known.withColumns({"_lx": low("ax", "bx"), "_ly": low("ay", "by")})
    left = left.withColumn("_i", F.explode(F.sequence("_lx", high("ax", "bx")))).withColumn("_j", F.explode(F.sequence("_ly", high("ay", "by"))))
    rings = F.concat(F.array(F.col("ext").cast(POINTS)), F.coalesce(F.col("holes").cast(f"array<{POINTS}>"), F.array().cast(f"array<{POINTS}>")))
    side = F.transform(F.flatten(F.transform(rings, _pairs)), lambda s: F.struct(*[s[p][c].cast("double").alias(f"{q}{c}") for p, q in (("a", "p"), ("b", "q")) for c in "xy"]))
    right = buildings.where(F.size("ext") >= 3).select(F.monotonically_increasing_id().alias("_n"), value.cast("double").alias("v"), side.alias("s"))
    box = {f"_{n}{c}": F.floor(f(F.transform("s", lambda s: s[f"p{c}"])) / cell) for c in "xy" for n, f in (("l", F.array_min), ("h", F.array_max))}
    right = right.withColumns(box).withColumn("_i", F.explode(F.sequence("_lx", "_hx"))).withColumn("_j", F.explode(F.sequence("_ly", "_hy")))
    right = right.select("_n", F.col("_n").alias("b"), "v", "_lx", "_ly", "_i", "_j", F.explode("s").alias("s")).select("_n", "b", "v", "_lx", "_ly", "_i", "_j", "s.*")

    def kernel(own: pd.DataFrame, sides: pd.DataFrame) -> pd.DataFrame:
        out = {c: np.zeros(len(own), t) for c, t in (("n", "i8"), ("total", "f8"))}
        sides = sides.sort_values("b", kind="stable")
        first = np.flatnonzero(np.append(True, np.diff(sides["b"].to_numpy()) != 0)) if len(sides) else np.zeros(0, "i8")
        if first.size and len(own):
            i, j = own["_i"].iat[0], own["_j"].iat[0]
            ends = sides[["px", "py", "qx", "qy"]].to_numpy("f8").T
            v, lx, ly = (sides[c].to_numpy()[first] for c in ("v", "_lx", "_ly"))
            count = np.diff(np.append(first, len(sides)))
            x0, x1, y0, y1 = (f.reduceat(ends[c], first) for c in (0, 1) for f in (np.minimum, np.maximum))
            # Sights in the order of x: a block meets the buildings of its own box.
            order, step = np.argsort(own["ax"].to_numpy(), kind="stable"), max(1, PAIRS // len(sides))
            for k in range(0, len(own), step):
                at = order[k : k + step]
                rows = own.iloc[at]
                ax, ay, bx, by = (rows[c].to_numpy("f8")[:, None] for c in ("ax", "ay", "bx", "by"))
                near = (x0 <= np.maximum(ax, bx).max()) & (x1 >= np.minimum(ax, bx).min()) & (y0 <= np.maximum(ay, by).max()) & (y1 >= np.minimum(ay, by).min())
                if not near.any():
                    continue
                starts = np.cumsum(np.append(0, count[near][:-1]))
                px, py, qx, qy = ends[:, np.repeat(near, count)][:, None, :]
                slope = np.divide(qx - px, qy - py, out=np.zeros_like(px), where=qy != py)
                turn = lambda ax, ay, bx, by, cx, cy: np.sign((bx - ax) * (cy - ay) - (by - ay) * (cx - ax))
                meet = turn(ax, ay, bx, by, px, py) * turn(ax, ay, bx, by, qx, qy) <= 0
                meet &= turn(px, py, qx, qy, ax, ay) * turn(px, py, qx, qy, bx, by) <= 0
                meet &= (np.minimum(ax, bx) <= np.maximum(px, qx)) & (np.minimum(px, qx) <= np.maximum(ax, bx))
                meet &= (np.minimum(ay, by) <= np.maximum(py, qy)) & (np.minimum(py, qy) <= np.maximum(ay, by))
                right_of = ((py > ay) != (qy > ay)) & (ax < px + (ay - py) * slope)
                hit = np.logical_or.reduceat(meet, starts, axis=1) | (np.add.reduceat(right_of, starts, axis=1, dtype="i4") % 2 == 1)
                hit &= (np.maximum(rows["_lx"].to_numpy()[:, None], lx[near]) == i) & (np.maximum(rows["_ly"].to_numpy()[:, None], ly[near]) == j)
                out["n"][at], out["total"][at] = hit.sum(axis=1), np.where(hit, v[near], 0.0).sum(axis=1)
        found = pd.DataFrame({"sight_id": own["sight_id"], **out})
        return found[found["n"] > 0]

    met = environment.dealt(left, right, kernel, f"sight_id {sights.schema['sight_id'].dataType.simpleString()}, n long, total double")
    return met.groupBy("sight_id").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))


def _told_within(points: DataFrame, x: str, y: str, buildings: DataFrame, cell: float) -> DataFrame:
    """points with _in: whether a building holds them. The search for one ends at the first."""
    rings = F.concat(F.array(F.col("ext").cast(POINTS)), F.coalesce(F.col("holes").cast(f"array<{POINTS}>"), F.array().cast(f"array<{POINTS}>")))
    boxes = buildings.where(F.size("ext") >= 3).select(F.flatten(F.transform(rings, _pairs)).alias("s"))
    boxes = boxes.withColumns({f"{n}{c}": f(F.transform("s", lambda s: s["a"][c])) for c in "xy" for n, f in (("l", F.array_min), ("h", F.array_max))})
    for c, name in (("x", "ci"), ("y", "cj")):
        boxes = boxes.withColumn(name, F.explode(F.sequence(F.floor(F.col(f"l{c}") / cell), F.floor(F.col(f"h{c}") / cell))))
    at = written(points.withColumns({"_id": F.monotonically_increasing_id(), "ci": F.floor(F.col(x) / cell), "cj": F.floor(F.col(y) / cell)}))

    def right(s: Column) -> Column:
        a, b = s["a"], s["b"]
        meet = a["x"] + (F.col(y) - a["y"]) * (b["x"] - a["x"]) / F.nullif(b["y"] - a["y"], F.lit(0.0))
        return F.coalesce(((a["y"] > F.col(y)) != (b["y"] > F.col(y))) & (F.col(x) < meet), F.lit(False))

    box = F.col(x).between(F.col("lx"), F.col("hx")) & F.col(y).between(F.col("ly"), F.col("hy"))
    own, box_rows = at.alias("p"), boxes.hint("merge").alias("q")
    odd = box & (F.size(F.filter("s", right)) % 2 == 1)
    found = own.join(box_rows, (F.col("p.ci") == F.col("q.ci")) & (F.col("p.cj") == F.col("q.cj")) & odd, "left_semi").select("_id", F.lit(True).alias("_in"))
    held = at.join(found.hint("merge"), "_id", "left").select(*points.columns, F.coalesce("_in", F.lit(False)).alias("_in"))
    return written(held)


def noise_screened(receivers: DataFrame, sources: DataFrame, buildings: DataFrame, screen_db: float = 10.0, cutoff: float = 300.0, nearest: float = 1.0, cell: float = 50.0) -> DataFrame:
    """Rows of receivers (id, x, y, ...) with db and band, as environment.noise_at; sources whose line of sight meets a
    building count screen_db less."""
    # What stands in a building is hidden from everything: only pairs of free places need a test of their sight, the
    # others are summed within tasks.
    loud = sources.where("level is not null").withColumn("_power", F.pow(F.lit(10.0), F.col("level") / 10)).select("bx", "by", "_power")
    low = 10 ** (-screen_db / 10)
    heard = _told_within(receivers.select("id", "x", "y"), "x", "y", buildings, cell)
    made = _told_within(loud, "bx", "by", buildings, cell)

    def share(d: np.ndarray) -> np.ndarray:
        return low / np.maximum(d, nearest) ** 2

    inside = environment.summed_within(heard, made.where("_in"), cutoff, "_power", share)
    inside = inside.unionByName(environment.summed_within(heard.where("_in"), made.where("not _in"), cutoff, "_power", share))
    pairs = written(environment.within(heard.where("not _in").drop("_in"), made.where("not _in").drop("_in"), cutoff).withColumn("sight_id", F.monotonically_increasing_id()))
    sights = pairs.select("sight_id", F.col("bx").alias("ax"), F.col("by").alias("ay"), F.col("x").alias("bx"), F.col("y").alias("by"))
    hidden = met_by_sights(sights, buildings, F.lit(0.0), cell).select("sight_id", F.lit(low).alias("_low"))
    free = pairs.join(hidden.hint("merge"), "sight_id", "left").select("id", (F.col("_power") * F.coalesce("_low", F.lit(1.0)) / F.pow(F.greatest("d", F.lit(nearest)), F.lit(2.0))).alias("s"))
    sums = inside.unionByName(free).groupBy("id").agg((10 * F.log10(F.sum("s"))).alias("db"))
    level = F.coalesce("db", F.lit(-1.0))
    return receivers.join(sums, "id", "left").select(*receivers.columns, level.alias("db"), environment.noise_bands(level).alias("band"))


def canyon_factors(receivers: DataFrame, roads: DataFrame, buildings: DataFrame, buffer: float = 20.0, search: float = 30.0, width: float = 15.0, cell: float = 50.0) -> DataFrame:
    """id and factor of receivers (id, x, y): more than 1 where buildings (with height) stand on both sides of the
    nearest road (line_id, pts), at right angles to it within `search`, and the road is within `buffer`.

    The height is the mean of the sides' means; the factor is street.canyon_factor of it and the width.
    """
    edges = written(roads.where(F.size("pts") >= 2).select(F.col("line_id").alias("edge_id"), "pts", F.lit(None).cast("double").alias("cost")))
    near = nearest_edge(receivers.select("id", "x", "y"), edges).where(F.col("snap_m") <= buffer).join(edges.select("edge_id", "pts"), "edge_id")
    steps = F.zip_with(F.slice("pts", 1, F.size("pts") - 1), F.slice("pts", 2, F.size("pts")), lambda a, b: F.hypot(a["x"] - b["x"], a["y"] - b["y"]))
    part = 0.1 / F.greatest(F.aggregate(steps, F.lit(0.0), lambda s, d: s + d), F.lit(1e-9))
    near = near.withColumns({"p": point_at(F.col("pts"), F.col("t") - part), "q": point_at(F.col("pts"), F.col("t") + part)})
    dx, dy = F.col("q.x") - F.col("p.x"), F.col("q.y") - F.col("p.y")
    size = F.hypot(dx, dy)
    across = F.when(size < 1e-6, F.struct(F.lit(0.0).alias("x"), F.lit(1.0).alias("y"))).otherwise(F.struct((-dy / F.nullif(size, F.lit(0.0))).alias("x"), (dx / F.nullif(size, F.lit(0.0))).alias("y")))
    sides = near.select("id", "x", "y", across.alias("n"), F.explode(F.array(F.lit(1), F.lit(-1))).alias("side"))
    sights = written(sides.select("id", "side", F.col("x").alias("ax"), F.col("y").alias("ay"), (F.col("x") + F.col("side") * search * F.col("n.x")).alias("bx"), (F.col("y") + F.col("side") * search * F.col("n.y")).alias("by"), F.monotonically_increasing_id().alias("sight_id")))
    # Heights are summed within tasks, as pairs would grow with the product of both tables; rows of receivers are never broadcast.
    hits = met_by_sights(sights, buildings, F.greatest(F.col("height").cast("double"), F.lit(1.0)), cell).select("sight_id", (F.col("total") / F.col("n")).alias("h"))
    means = sights.select("sight_id", "id").join(hits.hint("merge"), "sight_id")
    both = means.groupBy("id").agg(F.avg("h").alias("h"), F.count(F.lit(1)).alias("n")).where("n = 2")
    return receivers.select("id").join(both.hint("merge"), "id", "left").select("id", F.when(F.col("h").isNotNull(), street.canyon_factor(F.col("h"), F.lit(width))).otherwise(1.0).alias("factor"))


def air_in_streets(receivers: DataFrame, sources: DataFrame, roads: DataFrame, buildings: DataFrame, wind: float = 2.0, alpha: float = 1.0, d0: float = 5.0, cutoff: float = 300.0, **canyon: float) -> DataFrame:
    """Rows of receivers with index: environment.air_at times the canyon factor."""
    plain = environment.air_at(receivers, sources, wind, alpha, d0, cutoff)
    factors = canyon_factors(receivers, roads, buildings, **canyon)
    return plain.join(factors, "id").select(*receivers.columns, (F.col("index") * F.col("factor")).alias("index"))


def grid_receivers(df: DataFrame, x0: float, y1: float, columns: int, rows: int, cell: float) -> DataFrame:
    """id, row, col, x, y: the middles of a grid's cells, rows from the top; df only names the session.

    Any operator with receivers makes a raster of them; its cells are dealt over tasks like all rows.
    """
    each = df.sparkSession.range(columns * rows).withColumns({"row": F.floor(F.col("id") / columns).cast("int"), "col": (F.col("id") % columns).cast("int")})
    return each.select("id", "row", "col", (x0 + (F.col("col") + 0.5) * cell).alias("x"), (y1 - (F.col("row") + 0.5) * cell).alias("y"))
