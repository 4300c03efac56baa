"""What fallen buildings leave of the streets: the envelope of their debris, blocked parts, corridors that stay open."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from urbanloom.operators import overlay
from urbanloom.operators.overlay import POINTS
from urbanloom.operators.service_areas import street_buffers

#: A corner is drawn out to its tip while that is at most so many times the spread away; else it is cut.
MITRE = 2.0


def spread_pieces(ring: np.ndarray, by: float) -> list[np.ndarray]:
    """Polygons whose union is a ring widened by `by` with drawn-out corners: the ring, a strip beside each side, and
    what lies between the strips at corners that point outwards."""
    ring = ring[np.hypot(*(ring - np.roll(ring, 1, axis=0)).T) > 1e-9]
    area = float((ring[:, 0] * np.roll(ring[:, 1], -1) - np.roll(ring[:, 0], -1) * ring[:, 1]).sum()) if len(ring) >= 3 else 0.0
    if not area:
        return []
    p = ring if area > 0 else ring[::-1]
    if by <= 0:
        return [p]
    q = np.roll(p, -1, axis=0)
    side = q - p
    out = by * np.column_stack([side[:, 1], -side[:, 0]]) / np.hypot(side[:, 0], side[:, 1])[:, None]
    pieces = [p, *(np.array([a, a + n, b + n, b]) for a, b, n in zip(p, q, out, strict=True))]
    for i in range(len(p)):
        m, n = out[i - 1], out[i]
        if side[i - 1][0] * side[i][1] - side[i - 1][1] * side[i][0] <= 0:
            continue
        tip = (m + n) * (by * by / max(by * by + float(m @ n), 1e-12))
        corner = [p[i], p[i] + m, p[i] + tip, p[i] + n] if np.hypot(*tip) <= MITRE * by else [p[i], p[i] + m, p[i] + n]
        pieces.append(np.array(corner))
    return pieces


def debris_shapes(buildings: DataFrame) -> DataFrame:
    """ring: the pieces of the debris of collapsed buildings (ext, spread_m, collapsed), as of street.debris()."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [piece for ext, by in zip(batch["ext"], batch["spread_m"], strict=True) for piece in spread_pieces(np.array([(p["x"], p["y"]) for p in ext], "f8"), by)]
            yield pd.DataFrame({"ring": [[{"x": x, "y": y} for x, y in p.tolist()] for p in out]})

    fallen = buildings.where(F.col("collapsed") & (F.size("ext") >= 3)).select("ext", F.coalesce(F.col("spread_m").cast("double"), F.lit(0.0)).alias("spread_m"))
    return fallen.mapInPandas(run, f"ring {POINTS}")


def street_strips(roads: DataFrame, width: Column) -> DataFrame:
    """ring: the strips of roads (pts) of a width in metres (street.road_width() gives one), with round ends."""
    return street_buffers(roads.where(F.size("pts") >= 2), width / 2, [])


def blocked_streets(buildings: DataFrame, streets: DataFrame, tile: float | None = None) -> DataFrame:
    """part, y0, y1, l0, r0, l1, r1: trapezoids of street space (rings of simple polygons) that stays open (part 1, the
    corridors), of debris outside streets (2), and of blocked street space (3); parts 2 and 3 are the envelope."""
    shapes = streets.select(F.lit(0).alias("layer"), "ring").unionByName(debris_shapes(buildings).select(F.lit(1).alias("layer"), "ring"))
    return overlay.overlaid(shapes.withColumn("_all", F.lit(0)), ["_all"], tile).drop("_all")


def blockage(parts: DataFrame) -> DataFrame:
    """what, area_m2: envelope, blocked and corridors of blocked_streets(), each present, 0 if empty."""
    sums = parts.groupBy("part").agg(F.sum(overlay.trapezoid_area()).alias("m2"))
    kinds = F.explode(F.when(F.col("part") == overlay.FIRST, F.array(F.lit("corridors"))).when(F.col("part") == overlay.SECOND, F.array(F.lit("envelope"))).otherwise(F.array(F.lit("envelope"), F.lit("blocked"))))
    found = sums.select(kinds.alias("what"), "m2").groupBy("what").agg(F.sum("m2").alias("m2"))
    every = parts.sparkSession.createDataFrame([("envelope",), ("blocked",), ("corridors",)], "what string")
    return every.join(found, "what", "left").select("what", F.coalesce("m2", F.lit(0.0)).alias("area_m2"))
