"""Morphological tessellation: the part of the plan that lies nearer to one building than to any other.

Seeds are points along the shrunken outlines of buildings, rounded to a grid. Each seed's Voronoi cell is the mask cut
by the bisectors to its neighbours. Seeds look for neighbours in their tile and the eight around it; a cell is whole
once every seed within twice its radius was seen, and the few cells of which that is not sure meet exactly the seeds
that could still cut them. The cells of a building's seeds together are its cell; their inner borders go.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from urbanloom.functions.scratch import written
from urbanloom.operators.overlay import POINTS, hulls

#: Seeds of a tile, about, at even density; neighbours that are tried at once.
TILE_SEEDS, BATCH = 400, 24
#: Segments of a quarter circle where the mask is a widened hull.
ARC = 8
BORDER = -1


def shrunk(ring: np.ndarray, by: float) -> np.ndarray:
    """An outline with every side moved inwards; the outline itself where that leaves nothing."""
    area = lambda p: float((p[:, 0] * np.roll(p[:, 1], -1) - np.roll(p[:, 0], -1) * p[:, 1]).sum()) / 2
    ring = ring[np.hypot(*(ring - np.roll(ring, 1, axis=0)).T) > 1e-9]
    if by <= 0 or len(ring) < 3 or not area(ring):
        return ring
    p = ring if area(ring) > 0 else ring[::-1]
    side = np.roll(p, -1, axis=0) - p
    size = np.hypot(side[:, 0], side[:, 1])
    normal = np.column_stack([-side[:, 1], side[:, 0]]) / size[:, None]  # inwards
    before = np.roll(normal, 1, axis=0)
    turn = 1 + (normal * before).sum(axis=1)
    out = p + by * (normal + before) / np.maximum(turn, 1e-6)[:, None]
    # A side that turned around is shorter than the shrinking: nothing whole is left.
    kept = ((np.roll(out, -1, axis=0) - out) * side).sum(axis=1) > 0
    return out if kept.all() and area(out) > 0 else ring


def seeds(buildings: DataFrame, shrink: float = 0.4, densify: float = 2.0) -> DataFrame:
    """x, y, key (the building's id): points at most `densify` apart along shrunken outlines (id, ext), rounded to a
    quarter of that; a point of several buildings belongs to the smallest id. Rings of fewer than three points have none."""
    grid = max(densify / 4, 1e-3)

    def run(batches):
        for batch in batches:
            out = []
            for key, ext in zip(batch["id"], batch["ext"], strict=True):
                ring = shrunk(np.array([(p["x"], p["y"]) for p in ext], "f8"), shrink)
                after = np.roll(ring, -1, axis=0)
                for a, b in zip(ring, after, strict=True):
                    n = max(1, math.ceil(math.hypot(*(b - a)) / densify - 1e-9))
                    at = a + (b - a) * (np.arange(n) / n)[:, None]
                    out.append(pd.DataFrame({"x": np.round(at[:, 0] / grid) * grid, "y": np.round(at[:, 1] / grid) * grid, "key": key}))
            yield pd.concat(out) if out else pd.DataFrame({"x": [], "y": [], "key": []})

    points = buildings.where(F.size("ext") >= 3).select(F.col("id").cast("long").alias("id"), "ext").mapInPandas(run, "x double, y double, key long")
    return points.groupBy("x", "y").agg(F.min("key").alias("key"))


def widened(ring: np.ndarray, by: float) -> np.ndarray:
    """A convex ring and all within `by` of it, corners as arcs."""
    out = []
    n = len(ring)
    for i in range(n):
        a, b, c = ring[i - 1], ring[i], ring[(i + 1) % n]
        first = math.atan2(b[1] - a[1], b[0] - a[0]) - math.pi / 2
        last = math.atan2(c[1] - b[1], c[0] - b[0]) - math.pi / 2
        turn = (last - first) % (2 * math.pi)
        steps = max(1, math.ceil(turn / (math.pi / 2 / ARC) - 1e-9))
        out += [(b[0] + by * math.cos(first + turn * k / steps), b[1] + by * math.sin(first + turn * k / steps)) for k in range(steps + 1)]
    return np.array(out)


def cut_cell(ring: np.ndarray, label: np.ndarray, at: np.ndarray, others: np.ndarray, names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A convex ring around `at`, whose sides have labels, cut by the bisectors to other points (nearest first)."""
    for k in range(len(others)):
        d = others[k] - at
        value = ring @ d - (others[k] + at) @ d / 2
        out = value > 1e-12
        if not out.any():
            continue
        if out.all():
            return ring[:0], label[:0]
        points, sides = [], []
        n = len(ring)
        for i in range(n):
            j = (i + 1) % n
            if not out[i]:
                points.append(ring[i])
                sides.append(label[i])
                if out[j]:
                    points.append(ring[i] + (ring[j] - ring[i]) * (value[i] / (value[i] - value[j])))
                    sides.append(names[k])
            elif not out[j]:
                points.append(ring[i] + (ring[j] - ring[i]) * (value[i] / (value[i] - value[j])))
                sides.append(label[i])
        ring, label = np.array(points), np.array(sides)
    return ring, label


def _radius(ring: np.ndarray, at: np.ndarray) -> float:
    return float(np.hypot(*(ring - at).T).max()) if len(ring) else 0.0


CELLS = f"x double, y double, key long, ring {POINTS}, sides array<long>, radius double, whole boolean"


def _row(at: np.ndarray, key: int, ring: np.ndarray, label: np.ndarray, whole: bool) -> tuple:
    return (at[0], at[1], key, [{"x": a, "y": b} for a, b in ring.tolist()], label.tolist(), _radius(ring, at), whole)


def cells(points: DataFrame, mask: np.ndarray, tile: float | None = None) -> DataFrame:
    """The Voronoi cell of each seed (x, y, key) within a convex mask: x, y, key, ring, sides (the key of the seed
    beyond each side, BORDER on the mask). Seeds outside the mask have what of their cell is in it, if anything."""
    points = written(points.select("x", "y", "key"))
    n = points.count()
    low, high = mask.min(axis=0), mask.max(axis=0)
    span = float(max(high - low))
    tile = tile or span / max(1.0, (n / TILE_SEEDS) ** 0.5)
    at = lambda c, o: F.floor((F.col(c) - float(o)) / tile).cast("long")
    own = points.withColumns({"i": at("x", low[0]), "j": at("y", low[1])})
    moves = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1)]))
    spread = own.select("x", "y", "key", moves.alias("m"), "i", "j")
    spread = spread.select("x", "y", "key", (F.col("i") + F.col("m.a")).alias("i"), (F.col("j") + F.col("m.b")).alias("j"), ((F.col("m.a") == 0) & (F.col("m.b") == 0)).alias("own"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        xy, key = pdf[["x", "y"]].to_numpy("f8"), pdf["key"].to_numpy("i8")
        i, j = pdf["i"].iat[0], pdf["j"].iat[0]
        corner = np.array([low[0] + i * tile, low[1] + j * tile])
        out = []
        for k in np.flatnonzero(pdf["own"].to_numpy()):
            far = np.hypot(*(xy - xy[k]).T)
            far[k] = np.inf
            order = np.argsort(far, kind="stable")[:-1]
            ring, label = mask, np.full(len(mask), BORDER)
            for start in range(0, len(order), BATCH):
                near = order[start : start + BATCH]
                if far[near[0]] > 2 * _radius(ring, xy[k]):
                    break
                ring, label = cut_cell(ring, label, xy[k], xy[near], key[near])
            # Everything within this distance of the seed was among the candidates.
            seen = tile + float(min((xy[k] - corner).min(), (corner + tile - xy[k]).min()))
            out.append(_row(xy[k], key[k], ring, label, 2 * _radius(ring, xy[k]) <= seen))
        return pd.DataFrame(out, columns=["x", "y", "key", "ring", "sides", "radius", "whole"])

    first = written(spread.groupBy("i", "j").applyInPandas(run, CELLS))
    open_ = first.where("not whole")
    # Seeds that could still cut an open cell: within twice its radius, and nearer to one of its corners.
    reach = lambda c, o: F.sequence(F.floor((F.col(c) - 2 * F.col("radius") - float(o)) / tile).cast("long"), F.floor((F.col(c) + 2 * F.col("radius") - float(o)) / tile).cast("long"))
    asked = open_.withColumn("i", F.explode(reach("x", low[0]))).withColumn("j", F.explode(reach("y", low[1])))
    other = own.select("i", "j", F.col("x").alias("ox"), F.col("y").alias("oy"), F.col("key").alias("o_key"))
    corners = F.exists("ring", lambda p: F.hypot(p["x"] - F.col("ox"), p["y"] - F.col("oy")) < F.hypot(p["x"] - F.col("x"), p["y"] - F.col("y")))
    met = asked.join(other, ["i", "j"]).where(((F.col("ox") != F.col("x")) | (F.col("oy") != F.col("y"))) & corners)

    def finish(pdf: pd.DataFrame) -> pd.DataFrame:
        r = pdf.iloc[0]
        at, ring = np.array([r["x"], r["y"]]), np.array([(p["x"], p["y"]) for p in r["ring"]], "f8")
        xy = pdf[["ox", "oy"]].to_numpy("f8")
        order = np.argsort(np.hypot(*(xy - at).T), kind="stable")
        ring, label = cut_cell(ring, np.array(r["sides"], "i8"), at, xy[order], pdf["o_key"].to_numpy("i8")[order])
        return pd.DataFrame([_row(at, r["key"], ring, label, True)], columns=["x", "y", "key", "ring", "sides", "radius", "whole"])

    closed = written(met.groupBy("x", "y").applyInPandas(finish, CELLS))
    same = open_.join(closed.select("x", "y"), ["x", "y"], "left_anti").select(*closed.columns)
    return first.where("whole").unionByName(closed).unionByName(same).drop("radius", "whole")


def tessellation(buildings: DataFrame, shrink: float = 0.4, densify: float = 2.0, limit: float = 100.0, study: list[tuple[float, float]] | None = None, tile: float | None = None) -> tuple[DataFrame, DataFrame]:
    """(cells, borders): id, cell_m2 and n_seeds of every building with a cell; and id, ax, ay, bx, by, other (the
    neighbour's id, BORDER on the mask) of the sides of their cells.

    buildings: id (a long), ext. The mask is the convex ring `study`, or the hull of all seeds widened by `limit`.
    Fewer than three buildings are an error. The corners of the hull come to the driver, nothing else.
    """
    points = written(seeds(buildings, shrink, densify))
    if points.select("key").distinct().limit(3).count() < 3:
        raise ValueError("a tessellation needs at least three buildings")
    if study is None:
        ring = hulls(points.withColumn("one", F.lit(0)), ["one"]).first().ring
        mask = widened(np.array([(p.x, p.y) for p in ring]), limit)
    else:
        mask = np.array(study, "f8")
        if (mask[:, 0] * np.roll(mask[:, 1], -1) - np.roll(mask[:, 0], -1) * mask[:, 1]).sum() < 0:
            mask = mask[::-1]
    found = written(cells(points, mask, tile))
    shut = F.concat("ring", F.slice("ring", 1, 1))
    sides = F.zip_with(F.arrays_zip("ring", "sides"), F.slice(shut, 2, F.size("ring")), lambda s, b: F.struct(s["ring"].alias("a"), b.alias("b"), s["sides"].alias("other")))
    part = F.aggregate(sides, F.lit(0.0), lambda n, s: n + s["a"]["x"] * s["b"]["y"] - s["b"]["x"] * s["a"]["y"]) / 2
    sums = found.where(F.size("ring") >= 3).groupBy(F.col("key").alias("id")).agg(F.sum(part).alias("cell_m2"), F.count(F.lit(1)).alias("n_seeds"))
    borders = found.select(F.col("key").alias("id"), F.explode(sides).alias("s")).where("s.other <> id")
    return sums, borders.select("id", F.col("s.a.x").alias("ax"), F.col("s.a.y").alias("ay"), F.col("s.b.x").alias("bx"), F.col("s.b.y").alias("by"), F.col("s.other").alias("other"))
