"""Walkability of street segments: what lies within a radius of their middles, and their slope, as one score."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from urbanloom.operators.environment import within
from urbanloom.operators.form import walk_score
from urbanloom.operators.network import build_graph, length, street_nodes

CIRCLE = 48


def midpoint(pts: str) -> Column:
    """struct<x, y>: the place half-way along a polyline."""
    p = F.col(pts)
    none = F.lit(None).cast("double")

    def step(acc: Column, i: Column) -> Column:
        a, b = F.element_at(p, i), F.element_at(p, i + 1)
        part = F.hypot(a["x"] - b["x"], a["y"] - b["y"])
        t = F.coalesce(F.try_divide(acc["left"], part), F.lit(0.0))
        hit = acc["x"].isNull() & (acc["left"] <= part)
        go = lambda c: F.when(hit, a[c] + t * (b[c] - a[c])).otherwise(acc[c])
        return F.struct((acc["left"] - part).alias("left"), go("x").alias("x"), go("y").alias("y"))

    start = F.struct((length(pts) / 2).alias("left"), none.alias("x"), none.alias("y"))
    found = F.aggregate(F.sequence(F.lit(1), F.size(p) - 1), start, step)
    return F.struct(*[F.coalesce(found[c], F.element_at(p, -1)[c]).alias(c) for c in "xy"])


def clipped_to_circle(ring: np.ndarray, x: float, y: float, radius: float) -> float:
    """Area of a ring (n x 2, open or closed) inside the regular polygon of CIRCLE corners around a place."""
    pts = ring - (x, y)
    if np.hypot(*pts.T).max() > radius * math.cos(math.pi / CIRCLE):
        turn = 2 * math.pi / CIRCLE
        for k in range(CIRCLE):
            if len(pts) < 3:
                return 0.0
            mid = (k + 0.5) * turn
            out = pts @ (math.cos(mid), math.sin(mid)) - radius * math.cos(turn / 2)
            if (out <= 0).all():
                continue
            nxt, far = np.roll(pts, -1, axis=0), np.roll(out, -1)
            cut = (out > 0) != (far > 0)
            t = np.divide(out, out - far, out=np.zeros_like(out), where=cut)
            both = np.stack([pts, pts + t[:, None] * (nxt - pts)], axis=1).reshape(-1, 2)
            pts = both[np.stack([out <= 0, cut], axis=1).ravel()]
    if len(pts) < 3:
        return 0.0
    px, py = pts.T
    return abs(float(px @ np.roll(py, -1) - py @ np.roll(px, -1))) / 2


def landuse_mix(mids: DataFrame, landuse: DataFrame, radius: float) -> DataFrame:
    """line_id, mix_ent of middles (line_id, x, y): evenness of the areas of categories (landuse: category, ring) in the circle.

    0 for at most one category; middles without any land use are left out. A ring goes to the squares that its bounds,
    widened by the radius, touch.
    """
    sides = {f"{c}{n}": least(F.col(f"ring.{c}")) for c in "xy" for n, least in enumerate((F.array_min, F.array_max))}
    span = lambda a, b: F.explode(F.sequence(F.floor((F.col(a) - radius) / radius), F.floor((F.col(b) + radius) / radius)))
    rings = landuse.where(F.size("ring") >= 3).select(F.col("category").cast("string").alias("category"), "ring").withColumns(sides)
    rings = rings.withColumn("_i", span("x0", "x1")).withColumn("_j", span("y0", "y1"))
    held = mids.withColumns({"_i": F.floor(F.col("x") / radius), "_j": F.floor(F.col("y") / radius)})
    near = held.join(rings, ["_i", "_j"]).where((F.col("x") + radius > F.col("x0")) & (F.col("x") - radius < F.col("x1")) & (F.col("y") + radius > F.col("y0")) & (F.col("y") - radius < F.col("y1")))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            area = [clipped_to_circle(np.array([(p["x"], p["y"]) for p in ring]), x, y, radius) for ring, x, y in zip(rows["ring"], rows["x"], rows["y"], strict=True)]
            yield pd.DataFrame({"line_id": rows["line_id"], "category": rows["category"], "area": area})

    areas = near.select("line_id", "x", "y", "category", "ring").mapInPandas(run, "line_id long, category string, area double")
    each = areas.groupBy("line_id", "category").agg(F.sum("area").alias("a")).where("a > 0")
    sums = each.groupBy("line_id").agg(F.sum("a").alias("t"), F.count(F.lit(1)).alias("k"), F.sum(F.col("a") * F.ln("a")).alias("s"))
    return sums.select("line_id", F.when(F.col("k") > 1, (F.ln("t") - F.col("s") / F.col("t")) / F.ln(F.col("k"))).otherwise(0.0).alias("mix_ent"))


def walkability(lines: DataFrame, radius: float = 400.0, pois: DataFrame | None = None, landuse: DataFrame | None = None, dem: DataFrame | None = None, grid: tuple[float, float, float, float] | None = None, weights: dict[str, float] | None = None) -> DataFrame:
    """line_id, walk_score, the scores of its parts and what they are made from, for lines (line_id, pts).

    int_km2: nodes with three or more street ends within the radius of the middle, a km2; blk_len: mean length of the
    lines whose middles are within it; with pois (x, y) n_pois; with landuse (category, ring) mix_ent; with a dem
    (row, col, z) on a grid (x0, dx, y0, dy) slope_pct between the two ends, 0 where the relief is unknown. Parts that
    are not given are left out of the score.
    """
    held = lines.where(F.size("pts") >= 2).select("line_id", "pts", length("pts").alias("_len"), midpoint("pts").alias("_m"))
    mids = held.select("line_id", "_len", F.col("_m.x").alias("x"), F.col("_m.y").alias("y"))
    nodes, edges = build_graph(lines)
    junctions = street_nodes(nodes, edges).where("degree >= 3").join(nodes, "node_id").select(F.col("x").alias("bx"), F.col("y").alias("by"))

    def counted(points: DataFrame, name: str) -> DataFrame:
        return within(mids, points, radius).groupBy("line_id").agg(F.count(F.lit(1)).alias(name))

    blocks = within(mids.drop("_len"), mids.select(F.col("x").alias("bx"), F.col("y").alias("by"), F.col("_len").alias("_near")), radius).groupBy("line_id").agg(F.avg("_near").alias("blk_len"))
    out = held.join(counted(junctions, "_n"), "line_id", "left").join(blocks, "line_id")
    km2 = math.pi * radius * radius / 1e6
    values = {"int_km2": F.coalesce("_n", F.lit(0)) / km2, "blk_len": F.col("blk_len")}
    if pois is not None:
        out = out.join(counted(pois.select(F.col("x").alias("bx"), F.col("y").alias("by")), "_p"), "line_id", "left")
        values["n_pois"] = F.coalesce("_p", F.lit(0)).cast("int")
    if landuse is not None:
        out = out.join(landuse_mix(mids.drop("_len"), landuse, radius), "line_id", "left")
        values["mix_ent"] = F.coalesce("mix_ent", F.lit(0.0))
    if dem is not None:
        x0, dx, y0, dy = grid
        for n, end in (("_za", F.col("pts")[0]), ("_zb", F.element_at("pts", -1))):
            cell = {"row": F.floor((end["y"] - y0) / dy).cast("int"), "col": F.floor((end["x"] - x0) / dx).cast("int")}
            out = out.withColumns(cell).join(dem.select("row", "col", F.col("z").alias(n)), ["row", "col"], "left").drop("row", "col")
        values["slope_pct"] = F.coalesce(100 * F.try_divide(F.abs(F.col("_zb") - F.col("_za")), "_len"), F.lit(0.0))
    made = out.select("line_id", *[v.alias(k) for k, v in values.items()])
    of = {"intersections": "int_km2", "mix": "mix_ent", "destinations": "n_pois", "blocklength": "blk_len", "slope": "slope_pct"}
    scores = walk_score({part: F.col(c).cast("double") for part, c in of.items() if c in values}, weights)
    return made.withColumns(scores)
