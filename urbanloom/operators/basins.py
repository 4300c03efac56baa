"""Pits of a height raster filled to the level they drain at, tile by tile.

A cell's level is the smallest over all ways out of the largest height on the way; ways out end at the raster's rim,
eight neighbours hang together, cells without a value are walls. Each tile is flooded from its own rim, so that every
cell has a rim cell (its label) and the level it reaches that at, and the passes between labels make a graph, of which
only a minimum spanning forest matters. Levels then spread from the raster's rim over the tiles' graphs: within a block
of tiles all at once, from block to block by a join of neighbouring rim cells, in rounds until no level falls. At last each cell
has the larger of its own level and its label's. Only rim cells take part in the rounds; nothing passes the driver.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from urbanloom.functions.scratch import written

#: Rows and columns of a tile: it holds so many squared cells, and its graph four times as many labels.
TILE = 256
#: Rows and columns, about, of a block of tiles that one call takes.
BLOCK = 512
#: Rounds of spreading, one for each block that a way out crosses.
ROUNDS = 10_000
AROUND = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if a or b]


def flood(z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(level at which each cell reaches the array's rim, that rim cell's place or -1) of heights, nan for walls."""
    rows, cols = z.shape
    # A frame of walls around the array, and lists of it: single places of lists are read faster than those of arrays.
    framed = np.pad(z, 1, constant_values=np.nan)
    wide = cols + 2
    height, done = framed.ravel().tolist(), np.isnan(framed).ravel().tolist()
    level, label = height.copy(), [-1] * len(height)
    steps = [a * wide + b for a, b in AROUND]
    rim = np.zeros(framed.shape, bool)
    rim[[1, rows], 1:-1] = rim[1:-1, [1, cols]] = True
    heap = [(height[p], p) for p in np.flatnonzero(rim & ~np.isnan(framed)).tolist()]
    for _, p in heap:
        done[p], label[p] = True, (p // wide - 1) * cols + p % wide - 1
    heapq.heapify(heap)
    while heap:
        at, p = heapq.heappop(heap)
        for step in steps:
            q = p + step
            if not done[q]:
                done[q], label[q] = True, label[p]
                up = height[q]
                level[q] = up = at if at > up else up
                heapq.heappush(heap, (up, q))
    inner = lambda v, t: np.array(v, t).reshape(framed.shape)[1:-1, 1:-1]
    return inner(level, "f8"), inner(label, "i8")


def passes(level: np.ndarray, label: np.ndarray) -> list[tuple[int, int, float]]:
    """A minimum spanning forest over labels, whose edges are the lowest passes between neighbouring cells."""
    found = []
    for a, b in ((0, 1), (1, 0), (1, 1), (1, -1)):
        rows, cols = level.shape
        p = (slice(0, rows - a), slice(max(0, -b), cols - max(0, b)))
        q = (slice(a, rows), slice(max(0, b), cols + min(0, b)))
        x, y = label[p].ravel(), label[q].ravel()
        ok = (x >= 0) & (y >= 0) & (x != y)
        found.append(np.column_stack([np.minimum(x, y)[ok], np.maximum(x, y)[ok], np.maximum(level[p].ravel(), level[q].ravel())[ok]]))
    every = np.concatenate(found)
    root: dict[int, int] = {}

    def top(v: int) -> int:
        while root.get(v, v) != v:
            root[v] = root.get(root[v], root[v])
            v = root[v]
        return v

    out = []
    for x, y, at in every[np.argsort(every[:, 2], kind="stable")].tolist():
        p, q = top(int(x)), top(int(y))
        if p != q:
            root[p] = q
            out.append((int(x), int(y), at))
    return out


def _spread(levels: pd.DataFrame, graph: pd.DataFrame) -> pd.DataFrame:
    """Levels of a block's labels after they spread over its passes; rows for those that fell or are new."""
    near: dict[int, list[tuple[int, float]]] = {}
    for a, b, at in zip(graph["a"], graph["b"], graph["pass"], strict=True):
        near.setdefault(a, []).append((b, at))
        near.setdefault(b, []).append((a, at))
    best = dict(zip(levels["label"], levels["level"], strict=True))
    before = dict(best)
    heap = [(v, k) for k, v in best.items()]
    heapq.heapify(heap)
    while heap:
        at, u = heapq.heappop(heap)
        if at > best[u]:
            continue
        for v, over in near.get(u, ()):
            if max(at, over) < best.get(v, np.inf):
                best[v] = max(at, over)
                heapq.heappush(heap, (best[v], v))
    moved = [(k, v) for k, v in best.items() if v < before.get(k, np.inf)]
    block = levels if len(levels) else graph
    out = pd.DataFrame(moved, columns=["label", "level"])
    out["bi"], out["bj"] = (block[c].iat[0] if len(block) else 0 for c in ("bi", "bj"))
    return out[["bi", "bj", "label", "level"]]


def fill_depressions(dem: DataFrame, tile: int = TILE) -> DataFrame:
    """dem (row, col, value) with its pits filled. Rows without a value are left out; cells that no way leads out of
    keep their height; the raster's rim is that of the smallest rectangle around all cells."""
    cells = written(dem.where(F.col("value").isNotNull() & ~F.isnan("value")).select(F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), F.col("value").cast("double").alias("z")))
    box = cells.agg(F.min("row").alias("r0"), F.max("row").alias("r1"), F.min("col").alias("c0"), F.max("col").alias("c1")).first()
    if box.r0 is None:
        return cells.select(F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"), F.col("z").alias("value"))
    wide = box.c1 - box.c0 + 1
    place = lambda r, c: (r - box.r0) * wide + c - box.c0

    side = max(1, BLOCK // tile)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        row, col, heights = pdf["row"].to_numpy(), pdf["col"].to_numpy(), pdf["z"].to_numpy()
        ti, tj = (row - box.r0) // tile, (col - box.c0) // tile
        order = np.lexsort((tj, ti))
        cuts = np.flatnonzero(np.diff(ti[order]) | np.diff(tj[order])) + 1
        out_level, out_label, links = heights.copy(), np.full(len(pdf), -1, "i8"), []
        for own in np.split(order, cuts):
            r, c = box.r0 + int(ti[own[0]]) * tile, box.c0 + int(tj[own[0]]) * tile
            z = np.full((min(tile, box.r1 - r + 1), min(tile, box.c1 - c + 1)), np.nan)
            i, j = row[own] - r, col[own] - c
            z[i, j] = heights[own]
            level, label = flood(z)
            name = lambda at: place(r + at // z.shape[1], c + at % z.shape[1])  # noqa: B023, E731
            held = label[i, j]
            out_level[own], out_label[own] = level[i, j], np.where(held >= 0, name(held), -1)
            links += [(name(a), name(b), at) for a, b, at in passes(level, label)]
        out = pd.DataFrame({"row": row, "col": col, "z": heights, "w": out_level, "label": pd.array(out_label, "Int64")})
        out = pd.concat([out, pd.DataFrame(links, columns=["a", "b", "pass"])])
        out["bi"], out["bj"] = int(pdf["bi"].iat[0]), int(pdf["bj"].iat[0])
        return out[["bi", "bj", "row", "col", "z", "w", "label", "a", "b", "pass"]]

    blocks = {"bi": F.floor((F.col("row") - box.r0) / (tile * side)), "bj": F.floor((F.col("col") - box.c0) / (tile * side))}
    flooded = written(cells.withColumns(blocks).groupBy("bi", "bj").applyInPandas(run, "bi long, bj long, row long, col long, z double, w double, label long, a long, b long, pass double"))
    inside = flooded.where("a is null")
    part = {"ti": F.floor((F.col("row") - box.r0) / tile), "tj": F.floor((F.col("col") - box.c0) / tile)}
    # Cells of the tiles' rims are their own labels; neighbours in other tiles are passes between tiles; those within
    # a block belong to its graph.
    rim = written(inside.where(F.col("label") == place(F.col("row"), F.col("col"))).withColumns(part).select("bi", "bj", "ti", "tj", "row", "col", "z", "label"))
    moves = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in AROUND]))
    there = rim.select("label", "z", "ti", "tj", "bi", "bj", moves.alias("m"), "row", "col").select("label", F.col("z").alias("own"), F.col("bi").alias("k"), F.col("bj").alias("l"), F.col("ti").alias("i"), F.col("tj").alias("j"), (F.col("row") + F.col("m.a")).alias("row"), (F.col("col") + F.col("m.b")).alias("col"))
    other = rim.select("row", "col", "ti", "tj", "bi", "bj", F.col("label").alias("to"), "z")
    every = written(there.join(other, ["row", "col"]).where("ti <> i or tj <> j").select("label", "bi", "bj", "k", "l", "to", F.greatest("own", "z").alias("over")))
    links = every.where("bi <> k or bj <> l").select("label", "bi", "bj", "to", "over")
    graph = flooded.where("a is not null").select("bi", "bj", "a", "b", "pass")
    graph = graph.unionByName(every.where("bi = k and bj = l and label < to").select("bi", "bj", F.col("label").alias("a"), F.col("to").alias("b"), F.col("over").alias("pass")))
    out_ = (F.col("row").isin(box.r0, box.r1)) | (F.col("col").isin(box.c0, box.c1))
    levels = written(rim.where(out_).select("bi", "bj", "label", F.col("z").alias("level")))
    fallen = levels
    for _ in range(ROUNDS):
        blocks = written(fallen.select("bi", "bj").distinct())
        own = levels.join(blocks, ["bi", "bj"], "left_semi").groupBy("bi", "bj")
        spread = own.cogroup(graph.join(blocks, ["bi", "bj"], "left_semi").groupBy("bi", "bj")).applyInPandas(_spread, "bi long, bj long, label long, level double")
        # What fell before this round, and within the blocks in it, goes on to the blocks around.
        spread = written(spread.unionByName(fallen).groupBy("bi", "bj", "label").agg(F.min("level").alias("level")))
        crossed = spread.select("label", "level").join(links, "label").groupBy("bi", "bj", F.col("to").alias("label")).agg(F.min(F.greatest("level", "over")).alias("level"))
        known = written(levels.unionByName(spread).groupBy("bi", "bj", "label").agg(F.min("level").alias("level")))
        held = known.select("label", F.col("level").alias("held"))
        fallen = written(crossed.join(held, "label", "left").where("held is null or level < held").drop("held"))
        levels = known
        if not fallen.limit(1).count():
            break
        levels = written(levels.unionByName(fallen).groupBy("bi", "bj", "label").agg(F.min("level").alias("level")))
    else:
        raise RuntimeError(f"levels still fall after {ROUNDS} rounds")
    found = inside.join(levels.select("label", "level"), "label", "left")
    return found.select(F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"), F.when(F.col("level").isNull(), F.col("z")).otherwise(F.greatest("w", "level")).alias("value"))
