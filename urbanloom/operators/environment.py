"""Noise and air at receivers, kernel densities and counts within a distance: points meet over square buckets."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from urbanloom.functions.scratch import written

#: Rows of receivers and of sources that meet in one call, about, and receivers of a block of distances.
RECEIVERS, SOURCES, BLOCK = 4_000, 50_000, 128
#: Squares whose counts are broadcast, at most; beyond, rows meet them by sorting.
SQUARES = 200_000


def within(a: DataFrame, b: DataFrame, radius: float) -> DataFrame:
    """Pairs of rows of a (x, y, ...) and b (bx, by, ...) at most `radius` apart, with their distance d.

    Squares with sides of the radius: a row of b goes to the nine squares around it, a row of a stays in its own,
    so each pair meets in exactly one square.
    """
    moves = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    left = a.withColumns({"_i": F.floor(F.col("x") / radius), "_j": F.floor(F.col("y") / radius)})
    right = b.select("*", moves.alias("_m")).withColumns({"_i": F.floor(F.col("bx") / radius) + F.col("_m.i"), "_j": F.floor(F.col("by") / radius) + F.col("_m.j")}).drop("_m")
    return left.join(right, ["_i", "_j"]).drop("_i", "_j").withColumn("d", F.hypot(F.col("x") - F.col("bx"), F.col("y") - F.col("by"))).where(F.col("d") <= radius)


def _blocks(a: pd.DataFrame, b: pd.DataFrame, radius: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows of a, rows of b, their distances as a matrix) in small blocks that hold all pairs at most `radius` apart."""
    x, y, bx, by = a["x"].to_numpy("f8"), a["y"].to_numpy("f8"), b["bx"].to_numpy("f8"), b["by"].to_numpy("f8")
    order, sources = np.lexsort((y, np.floor(x / radius * 4))), np.argsort(bx, kind="stable")
    bx, by = bx[sources], by[sources]
    wide = radius * (1 + 1e-9)
    for start in range(0, order.size, BLOCK):
        own = order[start : start + BLOCK]
        px, py = x[own], y[own]
        lo, hi = np.searchsorted(bx, (px.min() - wide, px.max() + wide))
        near = lo + np.flatnonzero((by[lo:hi] >= py.min() - wide) & (by[lo:hi] <= py.max() + wide))
        if near.size:
            dx, dy = px[:, None] - bx[near], py[:, None] - by[near]
            yield own, sources[near], np.sqrt(dx * dx + dy * dy)


def met_within(a: DataFrame, b: DataFrame, radius: float, kernel: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """The rows of kernel(rows of a (x, y, ...), rows of b (bx, by, ...)) over parts of both, such that each pair at most
    `radius` apart meets in exactly one call; only what the kernel makes of the pairs leaves a task, not the pairs.

    Squares as in within(), larger ones where receivers are few. A crowded square is dealt over several calls, by rows of
    both sides, so a call has about RECEIVERS and SOURCES rows however many lie in one place.
    """
    known = lambda df, p, q: df.where(f"{p} is not null and {q} is not null and not isnan({p}) and not isnan({q})").withColumn("_n", F.monotonically_increasing_id())
    a, b = known(a, "x", "y"), known(b, "bx", "by")
    box = a.agg(F.count(F.lit(1)).alias("n"), (F.max("x") - F.min("x")).alias("w"), (F.max("y") - F.min("y")).alias("h")).first()
    side = max(radius, math.sqrt((box.w or 0.0) * (box.h or 0.0) * RECEIVERS / 2 / max(box.n, 1)))
    moves = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    left = a.withColumns({"_i": F.floor(F.col("x") / side), "_j": F.floor(F.col("y") / side)})
    right = b.select("*", moves.alias("_m")).withColumns({"_i": F.floor(F.col("bx") / side) + F.col("_m.i"), "_j": F.floor(F.col("by") / side) + F.col("_m.j")}).drop("_m")
    return dealt(left, right, kernel, schema)


def dealt(left: DataFrame, right: DataFrame, kernel: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """The rows of kernel(part of left, part of right) over the squares (_i, _j) of both, such that all rows of a square
    meet in exactly one call. A crowded square is dealt over several calls by _n; rows of equal _n stay together."""
    count = lambda df, name, each: df.groupBy("_i", "_j").agg(F.ceil(F.count(F.lit(1)) / each).cast("int").alias(name))
    # Spark overrates the counts and underrates rows: without a hint it would send the rows through the driver.
    parts = written(count(left, "_ka", RECEIVERS).join(count(right, "_kb", SOURCES).hint("merge"), ["_i", "_j"]))
    parts = parts.hint("broadcast" if parts.count() <= SQUARES else "merge")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = lambda n: F.pmod(F.col("_n"), F.col(n)).cast("int")
    left = left.join(parts, ["_i", "_j"]).withColumns({"_p": own("_ka"), "_q": every("_kb")})
    right = right.join(parts, ["_i", "_j"]).withColumns({"_p": every("_ka"), "_q": own("_kb")})
    keys = ["_i", "_j", "_p", "_q"]
    tasks = 4 * left.sparkSession.sparkContext.defaultParallelism
    left, right = (x.drop("_n", "_ka", "_kb").repartition(tasks, *keys) for x in (left, right))
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(kernel, schema)


def summed_within(a: DataFrame, b: DataFrame, radius: float, weight: str, share: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """id and s: for each id of a (id, x, y) with rows of b (bx, by, weight) at most `radius` apart, the sum of their
    weights times share(distances). A null weight counts as 0."""

    def kernel(own: pd.DataFrame, other: pd.DataFrame) -> pd.DataFrame:
        value, total, met = other["w"].to_numpy("f8"), np.zeros(len(own)), np.zeros(len(own), bool)
        for rows, sources, d in _blocks(own, other, radius):
            inside = d <= radius
            met[rows] = inside.any(axis=1)
            total[rows] = np.where(inside, value[sources] * share(d), 0.0).sum(axis=1)
        return pd.DataFrame({"id": own["id"][met], "s": total[met]})

    weighed = b.select("bx", "by", F.coalesce(F.col(weight).cast("double"), F.lit(0.0)).alias("w"))
    found = met_within(a.select("id", "x", "y"), weighed, radius, kernel, f"id {a.schema['id'].dataType.simpleString()}, s double")
    return found.groupBy("id").agg(F.sum("s").alias("s"))


def traffic_level(hourly: Column, heavy_pct: Column) -> Column:
    """Emission level (dB) of a road at 25 m: 37.3 + 10 log10(volume (1 + 0.082 heavy share)); null without traffic."""
    loud = hourly * (1 + 0.082 * F.least(F.greatest(heavy_pct, F.lit(0.0)), F.lit(100.0)))
    return F.when(loud > 0, 37.3 + 10 * F.log10(loud))


def sample_level(level: Column, length: Column) -> Column:
    """Level of a point source that stands for a stretch of road."""
    return level + 10 * F.log10(25 * F.greatest(length, F.lit(1e-6)) / math.pi)


def noise_bands(level: str | Column, edges: tuple[float, ...] = (45, 50, 55, 60, 65, 70, 75)) -> Column:
    """Label of the 5 dB band of a level; no sound is in the lowest."""
    v = F.col(level) if isinstance(level, str) else level
    out = F.when(v < edges[0], f"< {edges[0]:g} dB")
    for lo, hi in zip(edges[:-1], edges[1:], strict=True):
        out = out.when(v < hi, f"{lo:g} - {hi:g} dB")
    return out.otherwise(f">= {edges[-1]:g} dB")


def noise_at(receivers: DataFrame, sources: DataFrame, cutoff: float = 300.0, nearest: float = 1.0) -> DataFrame:
    """Rows of receivers (id, x, y, ...) with db and band: the energy sum of sources (bx, by, level) within the cutoff.

    A level falls by 20 log10 of the distance (at least `nearest`); receivers that hear nothing have -1.
    """
    def share(d: np.ndarray) -> np.ndarray:
        square = np.maximum(d, nearest) ** 2
        return np.divide(1.0, square, out=np.zeros_like(square), where=square > 0)

    power = sources.where("level is not null").withColumn("_power", F.pow(F.lit(10.0), F.col("level") / 10))
    sums = summed_within(receivers, power, cutoff, "_power", share).select("id", (10 * F.log10("s")).alias("db"))
    return receivers.join(sums, "id", "left").select(*receivers.columns, F.coalesce("db", F.lit(-1.0)).alias("db"), noise_bands(F.coalesce("db", F.lit(-1.0))).alias("band"))


def air_at(receivers: DataFrame, sources: DataFrame, wind: float = 2.0, alpha: float = 1.0, d0: float = 5.0, cutoff: float = 300.0) -> DataFrame:
    """Rows of receivers with `index`: the sum of strength / (wind (d + d0) ** alpha) of sources within the cutoff."""
    sums = summed_within(receivers, sources, cutoff, "strength", lambda d: 1 / (wind * (d + d0) ** alpha)).withColumnRenamed("s", "index")
    return receivers.join(sums, "id", "left").select(*receivers.columns, F.coalesce("index", F.lit(0.0)).alias("index"))


def kernel_density(receivers: DataFrame, points: DataFrame, bandwidth: float, kernel: str = "quartic") -> DataFrame:
    """Rows of receivers with density: weights of points (bx, by, weight) by a kernel of their distance over the bandwidth."""
    shapes = {"uniform": np.ones_like, "triangular": lambda d: 1 - d / bandwidth, "quartic": lambda d: (1 - (d / bandwidth) ** 2) ** 2, "epanechnikov": lambda d: 1 - (d / bandwidth) ** 2}
    sums = summed_within(receivers, points, bandwidth, "weight", shapes[kernel]).withColumnRenamed("s", "density")
    return receivers.join(sums, "id", "left").select(*receivers.columns, F.coalesce("density", F.lit(0.0)).alias("density"))


def entropy_mix(receivers: DataFrame, points: DataFrame, radius: float) -> DataFrame:
    """Rows of receivers with mix_ent: evenness of the categories of points (bx, by, category) in the radius, 0 to 1."""

    def kernel(own: pd.DataFrame, other: pd.DataFrame) -> pd.DataFrame:
        code, names = pd.factorize(other["category"], use_na_sentinel=False)
        counts = np.zeros((len(own), len(names)), "i8")
        for rows, sources, d in _blocks(own, other, radius):
            order = np.argsort(code[sources], kind="stable")
            kinds, first = np.unique(code[sources][order], return_index=True)
            counts[rows[:, None], kinds] = np.add.reduceat((d <= radius)[:, order], first, axis=1, dtype="i8")
        at, kind = np.nonzero(counts)
        return pd.DataFrame({"id": own["id"].to_numpy()[at], "category": names.take(kind), "n": counts[at, kind]})

    types = [f"{n} {df.schema[n].dataType.simpleString()}" for df, n in ((receivers, "id"), (points, "category"))]
    met = met_within(receivers.select("id", "x", "y"), points.select("bx", "by", "category"), radius, kernel, ", ".join([*types, "n long"]))
    near = met.groupBy("id", "category").agg(F.sum("n").alias("n"))
    total = near.groupBy("id").agg(F.sum("n").alias("t"), F.count(F.lit(1)).alias("k"), F.sum(F.col("n") * F.ln("n")).alias("s"))
    value = F.when(F.col("k") > 1, (F.ln("t") - F.col("s") / F.col("t")) / F.ln("k")).otherwise(0.0)
    return receivers.join(total.select("id", value.alias("mix_ent")), "id", "left").select(*receivers.columns, F.coalesce("mix_ent", F.lit(0.0)).alias("mix_ent"))


def tobler_kmh(slope: Column) -> Column:
    """Walking speed (km/h) on a slope (rise over run, downhill negative)."""
    return 6 * F.exp(-3.5 * F.abs(slope + 0.05))
