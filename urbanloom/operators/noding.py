"""Preparing streets for a graph: lines are cut where they meet others, doubles and slivers go.

Segments meet in the square cells that they run through (a column of cells at a time, so a long diagonal is dealt
to as many cells as it crosses, not to all of its bounds), so the join is on equal cells.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from urbanloom.functions.ordered import running
from urbanloom.functions.scratch import written

ON_LINE = 1e-9
#: Segments of a cell, about.
CELL_PARTS = 256
#: Pairs of segments that are met at once, about.
PAIRS = 200_000


def segments(lines: DataFrame) -> DataFrame:
    """line_id, pos, ax, ay, bx, by: the straight parts of lines (line_id, pts); parts without length are left out."""
    p = F.col("pts")
    parts = F.transform(F.sequence(F.lit(1), F.size(p) - 1), lambda i: F.struct((i - 1).alias("pos"), F.element_at(p, i).alias("a"), F.element_at(p, i + 1).alias("b")))
    each = lines.where(F.size("pts") >= 2).select("line_id", F.explode(parts).alias("s"))
    return each.select("line_id", "s.pos", *[F.col(f"s.{e}.{c}").alias(f"{e}{c}") for e in "ab" for c in "xy"]).where("ax != bx or ay != by")


def in_cells(parts: DataFrame, cell: float) -> DataFrame:
    """parts, once for each cell (ci, cj) that the segment runs through, cells widened by a millionth."""
    wide = cell * 1e-6
    x0, x1 = F.least("ax", "bx"), F.greatest("ax", "bx")
    columns = F.sequence(F.floor((x0 - wide) / cell), F.floor((x1 + wide) / cell))
    held = parts.select("*", F.explode(columns).alias("ci"))
    slope = (F.col("by") - F.col("ay")) / (F.col("bx") - F.col("ax"))
    at = lambda x: F.when(F.col("ax") == F.col("bx"), F.lit(None)).otherwise(F.col("ay") + (x - F.col("ax")) * slope)
    left, right = at(F.greatest(x0, F.col("ci") * cell - wide)), at(F.least(x1, (F.col("ci") + 1) * cell + wide))
    whole0, whole1 = F.least("ay", "by"), F.greatest("ay", "by")
    # Rounding of a steep slope may leave the segment; its own bounds hold in any case.
    low = F.greatest(F.coalesce(F.least(left, right) - wide, whole0), whole0) - wide
    high = F.least(F.coalesce(F.greatest(left, right) + wide, whole1), whole1) + wide
    rows = F.sequence(F.floor(F.least(low, high) / cell), F.floor(F.greatest(low, high) / cell))
    return held.select("*", F.explode(rows).alias("cj"))


def _meetings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """line_id, pos, t, x, y of the meetings of a cell's segments, in blocks of about PAIRS pairs."""
    cell = pa.Table.from_batches(list(batches))
    ids = cell.column("line_id").combine_chunks()
    _, code = np.unique(ids.to_numpy(zero_copy_only=False), return_inverse=True)
    order = np.argsort(code, kind="stable")
    ids, pos, code = ids.take(pa.array(order)), cell.column("pos").combine_chunks().take(pa.array(order)), code[order]
    ax, ay, bx, by = (cell.column(c).to_numpy()[order] for c in ("ax", "ay", "bx", "by"))
    snap = lambda t: np.where(np.abs(t) <= ON_LINE, 0.0, np.where(np.abs(t - 1) <= ON_LINE, 1.0, t))
    inside = lambda t: (t >= 0) & (t <= 1)
    step = max(1, PAIRS // len(code))
    for k in range(0, len(code), step):
        low = int(np.searchsorted(code, code[k], side="right"))
        p, q = np.nonzero(code[k : k + step, None] < code[None, low:])
        p, q = p + k, q + low
        rx, ry, sx, sy = bx[p] - ax[p], by[p] - ay[p], bx[q] - ax[q], by[q] - ay[q]
        wx, wy = ax[q] - ax[p], ay[q] - ay[p]
        turn = rx * sy - ry * sx
        skew = np.abs(turn) > np.hypot(rx, ry) * np.hypot(sx, sy) * 1e-12
        with np.errstate(all="ignore"):
            t, u = snap((wx * sy - wy * sx) / turn), snap((wx * ry - wy * rx) / turn)
            hit = np.flatnonzero(skew & inside(t) & inside(u))
        t, u, hp, hq = t[hit], u[hit], p[hit], q[hit]
        x, y = (np.select([t == 0, t == 1, u == 0, u == 1], [a[hp], b[hp], a[hq], b[hq]], a[hp] + t * d[hit]) for a, b, d in ((ax, bx, rx), (ay, by, ry)))
        found = [(hp, t, x, y), (hq, u, x, y)]
        flat = np.flatnonzero(~skew)
        for own, other in ((p[flat], q[flat]), (q[flat], p[flat])) if flat.size else ():
            dx, dy = bx[own] - ax[own], by[own] - ay[own]
            for ex, ey in ((ax[other], ay[other]), (bx[other], by[other])):
                ox, oy = ex - ax[own], ey - ay[own]
                with np.errstate(all="ignore"):
                    along, off = snap((ox * dx + oy * dy) / (dx * dx + dy * dy)), np.abs(dx * oy - dy * ox) / (dx * dx + dy * dy)
                    on = np.flatnonzero(inside(along) & (off <= ON_LINE))
                found.append((own[on], along[on], ex[on], ey[on]))
        at, t, x, y = (np.concatenate(c) for c in zip(*found, strict=True))
        rows = pa.array(at)
        yield pa.RecordBatch.from_arrays([ids.take(rows), pos.take(rows), pa.array(t), pa.array(x), pa.array(y)], ["line_id", "pos", "t", "x", "y"])


def crossings(parts: DataFrame, cell: float) -> DataFrame:
    """line_id, pos, t, x, y: where segments meet those of other lines (t: 0 at the start, 1 at the end).

    Of parallel segments that lie on each other, each is met at the ends of the other. Both sides of a meeting
    have the same x and y: an end if it is at one, else the place on the segment of the smaller line_id. A cell's pairs
    are met as arrays and never leave their task.
    """
    # Cells are few bytes and much work: their tasks are not to be merged by size.
    placed = in_cells(parts.where("line_id is not null"), cell).repartition(parts.sparkSession.sparkContext.defaultParallelism * 4, "ci", "cj")
    held = placed.select("ci", "cj", "line_id", "pos", *[F.col(c).cast("double").alias(c) for c in ("ax", "ay", "bx", "by")])
    kinds = [parts.schema[c].dataType.simpleString() for c in ("line_id", "pos")]
    return held.groupBy("ci", "cj").applyInArrow(_meetings, f"line_id {kinds[0]}, pos {kinds[1]}, t double, x double, y double")


def _pieces(key: tuple, stops: pa.Table, min_length: float) -> pa.Table:
    """line_id, piece, nth, pts, length_m of one line from its stops (pos, t, x, y, cut: 0 for its own points)."""
    pos, t, x, y, cut = (stops.column(c).to_numpy() for c in ("pos", "t", "x", "y", "cut"))
    order = np.lexsort((y, x, cut, t, pos))
    pos, t, x, y, cut = (c[order] for c in (pos, t, x, y, cut))
    # Of stops at one place the line's own point counts.
    start = np.flatnonzero(np.concatenate([[True], (pos[1:] != pos[:-1]) | (t[1:] != t[:-1])]))
    ends = np.maximum.reduceat(cut, start) == 1
    ends[[0, -1]] = True
    x, y, at = x[start], y[start], np.flatnonzero(ends)
    length_m = np.add.reduceat(np.hypot(np.diff(x), np.diff(y)), at[:-1])
    kept = np.flatnonzero(~(length_m <= min_length))
    n = at[kept + 1] - at[kept] + 1
    offsets = np.concatenate([[0], np.cumsum(n)])
    points = np.repeat(at[kept] - offsets[:-1], n) + np.arange(offsets[-1])
    pts = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays([pa.array(x[points]), pa.array(y[points])], ["x", "y"]))
    line = pa.array([key[0].as_py()], stops.schema.field("line_id").type).take(pa.array(np.zeros(len(kept), "i8")))
    return pa.table({"line_id": line, "piece": pa.array(kept, pa.int32()), "nth": pa.array(np.arange(len(kept))), "pts": pts, "length_m": length_m[kept]})


def cell_side(parts: DataFrame) -> float:
    """The side of cells that segments share with about CELL_PARTS others, at most twice their mean length."""
    at = parts.agg(F.avg(F.hypot(F.col("bx") - F.col("ax"), F.col("by") - F.col("ay"))).alias("mean"), F.count(F.lit(1)).alias("n"), *[(F.max(F.greatest(f"a{c}", f"b{c}")) - F.min(F.least(f"a{c}", f"b{c}"))).alias(c) for c in "xy"]).first()
    if not at.n:
        return 2.0
    # A segment runs through about 4 / pi * mean / side cells beside its first one.
    long, room = 4 / math.pi * at["mean"], max(at.x, at["mean"]) * max(at.y, at["mean"]) * CELL_PARTS / at.n
    return min(2 * at["mean"], 2 * room / (long + math.sqrt(long * long + 4 * room)))


def prepare_network(lines: DataFrame, min_length: float = 0.05, cell: float | None = None) -> DataFrame:
    """seg_id, line_id, piece, pts, length_m: lines (line_id, pts) cut wherever they meet another line.

    Pieces with the same points, in either direction, are one (that of the smallest line_id and piece), pieces of
    min_length or less go. A line does not cut itself. Numbers follow line_id and piece. cell: side of the cells in which
    segments meet, cell_side() if not given. No lines give no rows. A line's stops are sorted as arrays; only pieces whose
    digests are not unique are compared, and only lines are put in order: a piece counts from its line's first.
    """
    parts = written(segments(lines))
    cuts = crossings(parts, cell or cell_side(parts))
    last = F.col("t") == 1.0
    cuts = cuts.select("line_id", F.when(last, F.col("pos") + 1).otherwise(F.col("pos")).alias("pos"), F.when(last, 0.0).otherwise(F.col("t")).alias("t"), "x", "y", F.lit(1).alias("cut"))
    corners = lines.where(F.size("pts") >= 2).select("line_id", F.posexplode("pts").alias("pos", "p")).select("line_id", "pos", F.lit(0.0).alias("t"), "p.x", "p.y", F.lit(0).alias("cut"))

    def run(key: tuple, stops: pa.Table) -> pa.Table:
        return _pieces(key, stops, min_length)

    kind = lines.schema["line_id"].dataType.simpleString()
    pieces = written(corners.unionByName(cuts).repartition(lines.sparkSession.sparkContext.defaultParallelism * 4, "line_id").groupBy("line_id").applyInArrow(run, f"line_id {kind}, piece int, nth long, pts array<struct<x: double, y: double>>, length_m double"))
    shape = F.least(F.col("pts"), F.reverse("pts"))
    digests = pieces.select("line_id", "piece", "nth", shape.alias("_shape"), F.xxhash64(shape).alias("_d"))
    alike = written(digests.groupBy("_d").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_d"))
    again = written(digests.join(alike, "_d", "left_semi").withColumn("_first", F.min(F.struct("line_id", "piece")).over(W.partitionBy("_shape"))).where(F.struct("line_id", "piece") != F.col("_first")).select("line_id", "piece", "nth"))
    gone = again.groupBy("line_id").agg(F.sort_array(F.collect_list("nth")).alias("_gone"))
    counts = pieces.groupBy("line_id").agg(F.count(F.lit(1)).alias("_n")).join(gone, "line_id", "left").withColumn("_left", F.col("_n") - F.coalesce(F.size("_gone"), F.lit(0)))
    upto = running(counts, ["line_id"], ["_left"], "_lines").select("line_id", "_gone", (F.col("_left_upto") - F.col("_left")).cast("long").alias("_base"))
    held = pieces.join(written(upto), "line_id").where(F.col("_gone").isNull() | ~F.array_contains("_gone", F.col("nth")))
    before = F.coalesce(F.size(F.filter("_gone", lambda g: g < F.col("nth"))), F.lit(0))
    return held.select((F.col("_base") + F.col("nth") - before).alias("seg_id"), "line_id", "piece", "pts", "length_m")
