"""Polygons laid over one another: unions of many shapes, polygons split over grid cells, walls that buildings share.

A ring is array<struct<x, y>>, open or closed. Unions work in square tiles: shapes meet only those of their tile, a
tile that holds many is cut into four until it holds few, and a sweep over the edges of a tile gives its part of the
union as trapezoids. Splits over cells go over arrays of rings, shared walls are column expressions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from urbanloom.functions.scratch import written
from urbanloom.operators.form import _pairs, ring_perimeter

#: Shapes of a tile's sweep, about: its work grows with their square. Tiles are halved so many times at most.
TILE_SHAPES, HALVINGS = 48, 16
#: Points, about, that polygons are cut into strips with at once.
STRIP_POINTS = 1 << 20
POINTS = "array<struct<x: double, y: double>>"


def _runs(of: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Places of the items of the runs `of`, where runs of n items follow one another."""
    k = n[of]
    return np.repeat(np.cumsum(n)[of] - n[of] - np.cumsum(k) + k, k) + np.arange(k.sum())


def _next(n: np.ndarray) -> np.ndarray:
    """For each point of rings of n points the place of the next one of its ring."""
    after, ends = np.arange(n.sum()) + 1, np.cumsum(n)
    after[ends[n > 0] - 1] = (ends - n)[n > 0]
    return after


def clipped(points: np.ndarray, n: np.ndarray, axis: int, bound: np.ndarray, above: bool) -> tuple[np.ndarray, np.ndarray]:
    """(points, n) of the parts of rings where axis (0: x, 1: y) is at least (above) or at most the ring's bound.

    points: two rows, the rings of n points after one another; rings of fewer than three points become empty. Of a
    ring that is not convex, parts may hang together by sides along the bound, which have no area.
    """
    ring, after = np.repeat(np.arange(len(n)), n), _next(n)
    u, w, b = points[axis], points[1 - axis], bound[ring]
    whole = n[ring] >= 3
    here = (u >= b if above else u <= b) & whole
    there = here[after]
    cross = here != there
    emits = cross.astype("i8") + there
    at = np.cumsum(emits) - emits
    out = np.empty((2, emits.sum()))
    c, d = np.flatnonzero(cross), after[cross]
    out[axis, at[c]], out[1 - axis, at[c]] = b[c], w[c] + (w[d] - w[c]) * ((b[c] - u[c]) / (u[d] - u[c]))
    out[:, (at + cross)[there]] = points[:, after[there]]
    return out, np.bincount(ring, emits, len(n)).astype("i8")


def _areas(points: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Areas of polygons of m rings of n points: shells count with theirs, holes against it, whatever their direction."""
    (x, y), after = points, _next(n)
    ring = np.repeat(np.arange(len(n)), n)
    own = np.where(n >= 3, np.abs(np.bincount(ring, x * y[after] - x[after] * y, len(n))) / 2, 0.0)
    shell = np.cumsum(m) - m
    return 2 * own[shell] - np.bincount(np.repeat(np.arange(len(m)), m), own, len(m))


def _strips(points: np.ndarray, n: np.ndarray, m: np.ndarray, axis: int, cell: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(polygon, strip, and points, n, m of its part) of polygons cut into strips of cells, about STRIP_POINTS at once.

    Every shell has at least three points."""
    shell = np.cumsum(m) - m
    u, starts = points[axis, _runs(shell, n)], np.cumsum(n[shell]) - n[shell]
    low = np.floor(np.minimum.reduceat(u, starts) / cell).astype("i8")
    high = np.maximum(np.ceil(np.maximum.reduceat(u, starts) / cell).astype("i8") - 1, low)
    size = np.bincount(np.repeat(np.arange(len(m)), m), n, len(m)).astype("i8")
    wide = high - low + 1
    # Strips of all polygons are numbered through; a call takes those whose points, summed up, are in one chunk.
    ends = np.cumsum(wide)
    done, total = 0, int(ends[-1])
    points_upto = np.cumsum(wide * size)
    while done < total:
        p = int(np.searchsorted(ends, done, "right"))
        seen = points_upto[p] - (ends[p] - done) * size[p]
        q = int(np.searchsorted(points_upto, seen + STRIP_POINTS, "right"))
        upto = total if q == len(m) else max(done + 1, int(ends[q] + (seen + STRIP_POINTS - points_upto[q]) // size[q]))
        strips = np.arange(done, min(upto, total))
        done = int(strips[-1]) + 1
        of = np.searchsorted(ends, strips, "right")
        at = low[of] + strips - (ends - wide)[of]
        rings = _runs(of, m)
        edge = np.repeat(at, m[of])
        part, k = clipped(points[:, _runs(rings, n)], n[rings], axis, edge * cell, True)
        part, k = clipped(part, k, axis, (edge + 1) * cell, False)
        shells = np.cumsum(m[of]) - m[of]
        held = np.flatnonzero(k[shells] >= 3)
        if len(held):
            rings = _runs(held, m[of])
            yield of[held], at[held], part[:, _runs(rings, k)], k[rings], m[of][held]


def _cell_sums(batch: pa.RecordBatch, cell: float) -> pa.RecordBatch:
    """_i, _j, n_feat, value of the cells that the batch's polygons (v, rings) touch with some area."""
    count = lambda lists: pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype("i8")
    v, rings = batch.column("v").to_numpy(zero_copy_only=False), batch.column("rings")
    m, n = count(rings), count(rings.flatten())
    points = np.array([c.to_numpy(zero_copy_only=False) for c in rings.flatten().flatten().flatten()], "f8").reshape(2, -1)
    area = _areas(points, n, m)
    good = np.flatnonzero((area > 0) & np.isfinite(area))
    sums = [pd.DataFrame({"_i": [], "_j": [], "n_feat": [], "value": []}).astype({"_i": "i8", "_j": "i8", "n_feat": "i8", "value": "f8"})]
    if len(good):
        v, area, kept = v[good], area[good], _runs(good, m)
        for p, i, *strip in _strips(points[:, _runs(kept, n)], n[kept], m[good], 0, cell):
            for q, j, *part in _strips(*strip, 1, cell):
                own = _areas(*part)
                has, of = own > 0, p[q]
                each = pd.DataFrame({"_i": i[q], "_j": j, "n_feat": 1, "value": v[of] * own / area[of]})[has]
                sums.append(each.groupby(["_i", "_j"], as_index=False).sum())
    out = pd.concat(sums).groupby(["_i", "_j"], as_index=False).sum()
    return pa.RecordBatch.from_pandas(out, preserve_index=False)


def polygon_grid(polygons: DataFrame, cell: float = 100.0, value: str | None = None) -> DataFrame:
    """Cells that polygons touch with some area: col, row, cell_id (row by row from the lower left), n_feat, value, dens_ha.

    polygons: ext (ring), holes (rings, may be null) and a value (null or none: 0; no column: 1), which is split over
    the cells by area. The grid starts at the multiple of `cell` below the smallest coordinates. Polygons are first
    cut into columns of cells and these into cells, a batch's polygons as arrays, and a batch gives one row for a cell.
    Polygons without area or with coordinates that are not finite take no part.
    """
    if cell <= 0:
        raise ValueError("the cell size must be positive")
    given = F.coalesce(F.col(value).try_cast("double"), F.lit(0.0)) if value else F.lit(1.0)
    rings = F.concat(F.array(F.col("ext").cast(POINTS)), F.coalesce(F.col("holes").cast(f"array<{POINTS}>"), F.array().cast(f"array<{POINTS}>")))
    held = polygons.where(F.size("ext") >= 3).select(given.alias("v"), rings.alias("rings"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield _cell_sums(batch, cell)

    parts = held.mapInArrow(run, "_i long, _j long, n_feat long, value double")
    sums = written(parts.groupBy("_i", "_j").agg(F.sum("n_feat").alias("n_feat"), F.sum("value").alias("value")))
    origin = sums.agg(F.min("_i").alias("_i0"), F.min("_j").alias("_j0"), F.max("_i").alias("_i1"))
    at = sums.crossJoin(F.broadcast(origin)).withColumns({"col": F.col("_i") - F.col("_i0"), "row": F.col("_j") - F.col("_j0")})
    wide = F.col("_i1") - F.col("_i0") + 1
    return at.select("col", "row", (F.col("row") * wide + F.col("col") + 1).alias("cell_id"), "n_feat", "value", (F.col("value") / (cell * cell / 10_000)).alias("dens_ha"))


def shared_walls(buildings: DataFrame, cell: float = 50.0, tolerance: float = 1e-9) -> DataFrame:
    """id, shared_m, sharedwall for every building (id, ext, holes): the length of its boundary that lies on other
    buildings' boundaries, each neighbour for itself, and its share of the outer perimeter (at most 1).

    Two sides share what they cover of one line: the ends of one lie on the line of the other, by a cross product no
    larger than tolerance times the product of the lengths. Sides meet in square cells; a pair counts in the one cell
    where both cells ranges begin. Ids tell buildings apart; walls within one building are not shared.
    """
    rings = F.concat(F.array(F.col("ext").cast(POINTS)), F.coalesce(F.col("holes").cast(f"array<{POINTS}>"), F.array().cast(f"array<{POINTS}>")))
    sides = buildings.where(F.size("ext") >= 2).select("id", F.explode(F.flatten(F.transform(rings, _pairs))).alias("s"))
    sides = sides.select("id", F.col("s.a.x").alias("ax"), F.col("s.a.y").alias("ay"), F.col("s.b.x").alias("bx"), F.col("s.b.y").alias("by")).where("ax <> bx or ay <> by")
    span = {f"{n}{axis}": f(F.floor(F.col(f"a{axis}") / cell), F.floor(F.col(f"b{axis}") / cell)) for axis in "xy" for n, f in (("lo", F.least), ("hi", F.greatest))}
    held = written(sides.select("*", *[c.alias(n) for n, c in span.items()]))
    placed = held.withColumn("cx", F.explode(F.sequence("lox", "hix"))).withColumn("cy", F.explode(F.sequence("loy", "hiy")))
    other = placed.select(*[F.col(c).alias(f"o_{c}") for c in ("id", "ax", "ay", "bx", "by", "lox", "loy")], "cx", "cy")
    ux, uy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
    size = F.hypot(ux, uy)

    def off(p: str) -> Column:
        return ux * (F.col(f"o_{p}y") - F.col("ay")) - uy * (F.col(f"o_{p}x") - F.col("ax"))

    def along(p: str) -> Column:
        return ((F.col(f"o_{p}x") - F.col("ax")) * ux + (F.col(f"o_{p}y") - F.col("ay")) * uy) / size

    limit = tolerance * size * F.greatest(size, F.hypot(F.col("o_bx") - F.col("o_ax"), F.col("o_by") - F.col("o_ay")), F.lit(1.0))
    once = (F.col("cx") == F.greatest("lox", "o_lox")) & (F.col("cy") == F.greatest("loy", "o_loy"))
    pairs = placed.join(other, ["cx", "cy"]).where((F.col("id") != F.col("o_id")) & once & (F.abs(off("a")) <= limit) & (F.abs(off("b")) <= limit))
    both = F.least(size, F.greatest(along("a"), along("b"))) - F.greatest(F.lit(0.0), F.least(along("a"), along("b")))
    shared = pairs.select("id", both.alias("m")).where("m > 0").groupBy("id").agg(F.sum("m").alias("shared_m"))
    every = buildings.select("id", ring_perimeter("ext").alias("p")).join(shared, "id", "left").withColumn("shared_m", F.coalesce("shared_m", F.lit(0.0)))
    return every.select("id", "shared_m", F.when(F.col("p") > 0, F.least(F.lit(1.0), F.col("shared_m") / F.col("p"))).otherwise(0.0).alias("sharedwall"))


def clip_box(points: np.ndarray, x0: float, y0: float, x1: float, y1: float) -> np.ndarray:
    """The part of a polygon (k, 2) in a box; parts of one that is not convex may hang together along the box's sides."""
    for axis, bound, sign in ((0, x0, 1), (0, x1, -1), (1, y0, 1), (1, y1, -1)):
        if not len(points):
            break
        d = sign * (points[:, axis] - bound)
        if (d >= 0).all():
            continue
        after, e = np.roll(points, -1, axis=0), np.roll(d, -1)
        out = []
        for p, q, a, b in zip(points, after, d, e, strict=True):
            if a >= 0:
                out.append(p)
            if (a > 0 > b) or (a < 0 < b):
                x = p + (q - p) * (a / (a - b))
                x[axis] = bound
                out.append(x)
        points = np.array(out)
    return points if len(points) >= 3 else points[:0]


def sweep(shapes: list[np.ndarray], layers: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(trapezoids, what covers them: 1 the first layer, 2 the second, 3 both) of simple polygons in one or two layers
    (0 and 1). A trapezoid is y0, y1, left and right at y0, left and right at y1.

    Heights where edges end or cross bound slabs in which no edges cross; there, edges in the order of their middles
    are the sides of the shapes that cover what is between them.
    """
    layers = np.zeros(len(shapes), "i8") if layers is None else layers
    edges = []
    for p, layer in zip(shapes, layers, strict=True):
        q = np.roll(p, -1, axis=0)
        up = q[:, 1] > p[:, 1]
        flat = q[:, 1] == p[:, 1]
        turned = ((p[:, 0] * q[:, 1]) - (q[:, 0] * p[:, 1])).sum() < 0
        low, high = np.where(up[:, None], p, q)[~flat], np.where(up[:, None], q, p)[~flat]
        # Counter-clockwise, a falling edge is the left side of its shape.
        edges.append(np.column_stack([low, high, np.where(up[~flat] ^ turned, -1, 1), np.full((~flat).sum(), layer)]))
    e = np.concatenate(edges) if edges else np.zeros((0, 6))
    if not len(e):
        return np.zeros((0, 6)), np.zeros(0, "i8")
    x, y, dx, dy, side, layer = e[:, 0], e[:, 1], e[:, 2] - e[:, 0], e[:, 3] - e[:, 1], e[:, 4], e[:, 5]
    cross = dx[:, None] * dy[None, :] - dy[:, None] * dx[None, :]
    with np.errstate(divide="ignore", invalid="ignore"):
        t = ((x[None, :] - x[:, None]) * dy[None, :] - (y[None, :] - y[:, None]) * dx[None, :]) / cross
        u = ((x[None, :] - x[:, None]) * dy[:, None] - (y[None, :] - y[:, None]) * dx[:, None]) / cross
        meet = (cross != 0) & (t > 0) & (t < 1) & (u > 0) & (u < 1)
        i, j = np.nonzero(np.triu(meet))
    heights = np.unique(np.concatenate([y, y + dy, y[i] + t[i, j] * dy[i]]))
    out, kinds = [], []
    slope = dx / dy
    for a, b in zip(heights[:-1], heights[1:], strict=True):
        on = np.flatnonzero((y <= a) & (y + dy >= b))
        if not on.size or b - a <= 0:
            continue
        low, high = x[on] + (a - y[on]) * slope[on], x[on] + (b - y[on]) * slope[on]
        order = np.lexsort((-side[on], low + high))
        step, of = side[on][order], layer[on][order]
        kind = (np.cumsum(step * (of == 0)) > 0) + 2 * (np.cumsum(step * (of == 1)) > 0)
        first = np.flatnonzero(kind != np.append(0, kind[:-1]))
        if not first.size:  # only sides that cover nothing, as where a shape touches the box
            continue
        for f, k in zip(first, np.append(first[1:], kind.size - 1), strict=True):
            if kind[f] and (low[order[k]] > low[order[f]] or high[order[k]] > high[order[f]]):
                out.append((a, b, low[order[f]], low[order[k]], high[order[f]], high[order[k]]))
                kinds.append(kind[f])
    return np.array(out).reshape(-1, 6), np.array(kinds, "i8")


#: What covers a part of an overlay.
FIRST, SECOND, BOTH = 1, 2, 3


def overlaid(shapes: DataFrame, keys: list[str], tile: float | None = None) -> DataFrame:
    """The rings of each combination of keys laid over one another: keys, part (FIRST, SECOND or BOTH, by the layers
    that cover it), y0, y1, and left and right at y0 (l0, r0) and at y1 (l1, r1) of trapezoids that do not overlap.

    shapes: keys, ring (a simple polygon), and layer (0 or 1; without the column all are 0). Equal rings of a key and
    layer count once. A tile with many shapes is quartered until it has
    few or HALVINGS is reached, so only shapes that truly meet in one place meet in one task. Where a shape covers a
    whole tile, the tile itself stands for all shapes of its layer. tile: the side of the first tiles (default: a part
    of the extent that follows the number of shapes, or their mean side; the union is the same for any).
    """
    box = {f"{n}{a}": f(F.transform("ring", lambda p: p[a])) for a in "xy" for n, f in (("lo", F.array_min), ("hi", F.array_max))}
    shapes = shapes if "layer" in shapes.columns else shapes.withColumn("layer", F.lit(0))
    held = written(shapes.where(F.size("ring") >= 3).select(*keys, F.col("layer").cast("int").alias("layer"), F.col("ring").cast(POINTS).alias("ring")).distinct().select("*", *[c.alias(n) for n, c in box.items()]))
    extent = held.agg(F.min("lox").alias("x"), F.min("loy").alias("y"), F.max(F.greatest(F.col("hix"), F.col("hiy"))).alias("top"), F.max("hix").alias("x1"), F.max("hiy").alias("y1"), F.avg(F.greatest(F.col("hix") - F.col("lox"), F.col("hiy") - F.col("loy"))).alias("mean"), F.count(F.lit(1)).alias("n")).first()
    if not extent.n:
        return held.select(*keys, F.lit(0).alias("part"), *[F.lit(0.0).alias(c) for c in ("y0", "y1", "l0", "r0", "l1", "r1")])
    span = max(extent.x1 - extent.x, extent.y1 - extent.y, 1e-9)
    tile = tile or min(span, max(span / max(1.0, (extent.n / TILE_SHAPES) ** 0.5), extent.mean))

    def dealt(rows: DataFrame, size: float) -> DataFrame:
        """rows with the tiles (i, j) of a side that their boxes meet, within the tile they had."""
        cells = lambda a, o: F.sequence(F.floor((F.col(f"lo{a}") - o) / size).cast("long"), F.floor((F.col(f"hi{a}") - o) / size).cast("long"))
        return rows.withColumn("i", F.explode(cells("x", extent.x))).withColumn("j", F.explode(cells("y", extent.y)))

    at = lambda x, y: F.struct(x.alias("x"), y.alias("y"))

    def folded(rows: DataFrame, size: float) -> DataFrame:
        """rows, with the tile's square for all shapes of a layer where one of them covers it."""
        left, low = extent.x + F.col("i") * size, extent.y + F.col("j") * size
        right, top = left + size, low + size
        corners = [(left, low), (right, low), (right, top), (left, top)]

        def beside(s: Column) -> Column:
            a, b = s["a"], s["b"]
            turns = [(b["x"] - a["x"]) * (y - a["y"]) - (b["y"] - a["y"]) * (x - a["x"]) for x, y in corners]
            apart = (F.greatest(a["x"], b["x"]) <= left) | (F.least(a["x"], b["x"]) >= right) | (F.greatest(a["y"], b["y"]) <= low) | (F.least(a["y"], b["y"]) >= top)
            return apart | (F.least(*turns) >= 0) | (F.greatest(*turns) <= 0)

        def right_of(s: Column) -> Column:
            a, b, x, y = s["a"], s["b"], left + size / 2, low + size / 2
            return ((a["y"] > y) != (b["y"] > y)) & (x < a["x"] + (y - a["y"]) * (b["x"] - a["x"]) / F.nullif(b["y"] - a["y"], F.lit(0.0)))

        holds = (F.col("lox") <= left) & (F.col("hix") >= right) & (F.col("loy") <= low) & (F.col("hiy") >= top)
        sides = _pairs(F.col("ring"))
        rows = written(rows.withColumn("_whole", F.when(holds, F.forall(sides, beside) & (F.size(F.filter(sides, right_of)) % 2 == 1)).otherwise(False)))
        whole = rows.where("_whole").groupBy(*keys, "layer", "i", "j").agg(F.min("_was").alias("_was"))
        squares = whole.withColumns({"ring": F.array(*[at(x, y) for x, y in corners]).cast(POINTS), "lox": left, "hix": right, "loy": low, "hiy": top})
        rest = rows.drop("_whole").join(whole.select(*keys, "layer", "i", "j").hint("merge"), [*keys, "layer", "i", "j"], "left_anti")
        return written(rest.unionByName(squares))

    todo, done, size = dealt(held, tile).withColumn("_was", F.lit(None).cast("long")), [], tile
    columns = [*keys, "layer", "ring", "i", "j", "size"]
    for level in range(HALVINGS + 1):
        todo = folded(todo, size)
        # Shapes as large as the tile may stay in all its quarters: tiles with mostly such ones are cut while that leaves fewer,
        # and down to an eighth of the shapes' mean side, where one may cover what is left.
        small = (F.col("hix") - F.col("lox") < size) & (F.col("hiy") - F.col("loy") < size)
        counts = todo.groupBy(*keys, "i", "j").agg(F.count(F.lit(1)).alias("_n"), F.count_if(small).alias("_small"), F.max("_was").alias("_was"))
        fewer = F.coalesce(4 * F.col("_n") <= 3 * F.col("_was"), F.lit(True)) | F.lit(size > extent.mean / 8)
        full = written(counts.where((F.col("_n") > TILE_SHAPES) & ((2 * F.col("_small") > F.col("_n")) | fewer)).select(*keys, "i", "j", "_n")) if level < HALVINGS else None
        few = todo if full is None else todo.join(full.hint("merge"), [*keys, "i", "j"], "left_anti")
        done.append(few.withColumn("size", F.lit(size)).select(*columns))
        if full is None or not full.limit(1).count():
            break
        size /= 2
        many = todo.drop("_was").join(full.withColumnRenamed("_n", "_was").hint("merge"), [*keys, "i", "j"]).withColumnsRenamed({"i": "_i", "j": "_j"})
        todo = dealt(many, size).where("floor(i / 2) = _i and floor(j / 2) = _j").drop("_i", "_j")
    every = done[0]
    for more in done[1:]:
        every = every.unionByName(more)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        size = pdf["size"].iat[0]
        x, y = extent.x + pdf["i"].iat[0] * size, extent.y + pdf["j"].iat[0] * size
        parts = [clip_box(np.array([(p["x"], p["y"]) for p in ring], "f8"), x, y, x + size, y + size) for ring in pdf["ring"]]
        some = [k for k, p in enumerate(parts) if len(p)]
        found, kinds = sweep([parts[k] for k in some], pdf["layer"].to_numpy("i8")[some])
        out = pd.DataFrame(found, columns=["y0", "y1", "l0", "r0", "l1", "r1"])
        out["part"] = kinds.astype("i4")
        for k in keys:
            out[k] = pdf[k].iat[0]
        return out[[*keys, "part", "y0", "y1", "l0", "r0", "l1", "r1"]]

    schema = ", ".join([*[f"`{k}` {held.schema[k].dataType.simpleString()}" for k in keys], "part int", *[f"{c} double" for c in ("y0", "y1", "l0", "r0", "l1", "r1")]])
    return every.groupBy(*keys, "size", "i", "j").applyInPandas(run, schema)


def trapezoid_area() -> Column:
    """Area of a row of overlaid()."""
    return (F.col("y1") - F.col("y0")) * (F.col("r0") - F.col("l0") + F.col("r1") - F.col("l1")) / 2


def union_area(shapes: DataFrame, keys: list[str], tile: float | None = None) -> DataFrame:
    """keys and area of the union of their shapes, whatever their layer."""
    return overlaid(shapes, keys, tile).groupBy(*keys).agg(F.sum(trapezoid_area()).alias("area"))


def hulls(points: DataFrame, keys: list[str]) -> DataFrame:
    """keys, ring and area of the convex hull of each combination's points (x, y).

    Every task makes the hulls of its own points first; only their corners meet.
    """
    from urbanloom.operators.form import hull

    key_schema = ", ".join(f"`{k}` {points.schema[k].dataType.simpleString()}" for k in keys)

    def local(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [batch.head(0)]
            for _, own in batch.groupby(keys, dropna=False, sort=False):
                corners = hull(own[["x", "y"]].to_numpy("f8"))
                part = pd.DataFrame(np.reshape(corners, (-1, 2)), columns=["x", "y"])
                for k in keys:
                    part[k] = own[k].iat[0]
                out.append(part)
            yield pd.concat(out)[[*keys, "x", "y"]]

    def whole(pdf: pd.DataFrame) -> pd.DataFrame:
        corners = np.reshape(hull(pdf[["x", "y"]].to_numpy("f8")), (-1, 2))
        q = np.roll(corners, -1, axis=0)
        area = abs(float((corners[:, 0] * q[:, 1] - q[:, 0] * corners[:, 1]).sum())) / 2 if len(corners) > 2 else 0.0
        return pd.DataFrame({**{k: [pdf[k].iat[0]] for k in keys}, "ring": [[{"x": a, "y": b} for a, b in corners.tolist()]], "area": [area]})

    return points.select(*keys, "x", "y").mapInPandas(local, f"{key_schema}, x double, y double").groupBy(*keys).applyInPandas(whole, f"{key_schema}, ring {POINTS}, area double")
