"""Repeated byte strings by a distributed difference-cover suffix array, and their removal from documents.

A byte goes if a string of `length` bytes that covers it also starts anywhere else. The suffixes that are sorted start
at anchors: of each WINDOW positions in a row that with the smallest hash of its next GRAM bytes (leftmost of equals),
so equal strings have equal anchors. The bytes from anchor to anchor are phrases, the letters of the suffix array:

1. Candidates: only stretches with a long-range anchor whose LONG_GRAM bytes occur twice can hold a repeat (a repeated
   string has the same such anchor in both places). Equal texts are one class, of which one text stands for all.
2. Difference cover: triples of letters at places 1 and 2 modulo 3 are sorted and named by the number of smaller ones;
   the two strings of names of each string recurse. Names cover three times as many letters a level; the recursion
   ends where they cover the longest prefix that is compared in 5.
3. Merge: suffixes at places 0 modulo 3 have keys (letter, rank of the next suffix), which those at 1 have too, and
   (two letters, rank of the one after), which those at 2 have too. Two sorts with running counts add up to ranks. All
   sorts are over distinct keys with counts, so letters or suffixes that many texts share are one row.
4. Ranks order the suffixes; adjacent ones are compared on the phrases that lie within what every string of an anchor
   covers. Runs of equal prefixes are classes; a suffix alone in its class starts no repeat.
5. Exact check within classes, by 128-bit hashes of bytes: anchors with equal bytes all around are repeats at once. At
   the ends of repeated passages blocks of BLOCK strings are judged next (what all of them share must repeat, or none
   does; what any of them covers repeats, then all do), and single strings only in the blocks that hold an end.
"""

from __future__ import annotations

import gc
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common
from . import tokens as tk

LENGTH = 200
WINDOW, GRAM = 96, 8
LONG_GRAM = 64
#: Strings of an anchor that are judged together before single ones are.
BLOCK = 16
#: Shortest strings that have a whole anchor window within what all strings of an anchor cover.
LEAST = 2 * WINDOW + GRAM - 2
#: Bytes of a batch, and of starts in a piece of a long text or stretch: they bound a task's memory.
BATCH, PIECE = 1 << 20, 1 << 20
_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93 | 1)


@cache
def _values(which: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(1100 + which)).integers(1, 2**63, 256, dtype="u8") * np.uint64(2) + np.uint64(1)


def windows(data: np.ndarray, length: int, which: int = 0) -> np.ndarray:
    """A 64-bit hash of the `length` bytes from each place that has so many."""
    base, cur, size, out, held = _BASES[which], _values(which)[data], 1, None, 0
    while True:
        if length & size:
            n = max(0, data.size - held - size + 1)
            out = cur[:n] if out is None else out[:n] * np.uint64(pow(base, size, 2**64)) + cur[held : held + n]
            held += size
        if held == length:
            return tk.mix(out)
        cur = cur[: max(0, cur.size - size)] * np.uint64(pow(base, size, 2**64)) + cur[size:]
        size *= 2


def lowest(values: np.ndarray, width: int) -> np.ndarray:
    """The place of the smallest of the `width` values from each place on (leftmost of equals)."""
    at, low, size = np.arange(values.size, dtype="i4"), values, 1
    for shift in [*(1 << k for k in range(width.bit_length() - 1)), width - (1 << (width.bit_length() - 1))]:
        if not shift:
            continue
        if at.size <= shift:
            return at[:0]
        first = low[:-shift] <= low[shift:]
        at, low = np.where(first, at[:-shift], at[shift:]), np.minimum(low[:-shift], low[shift:])
        size += shift
    return at


@cache
def _powers(which: int, bits: int, sign: int = 1) -> np.ndarray:
    out = np.full(1 << bits, pow(_BASES[which], sign, 2**64), "u8")
    out[0] = 1
    return np.multiply.accumulate(out)


def hashes_at(data: np.ndarray, starts: list[np.ndarray], lengths: list[int], which: int) -> list[np.ndarray]:
    """64-bit hashes of the bytes from some places on, for several lengths: from sums up to each place, as only few
    places are asked for. The same bytes have the same hash wherever they stand and however long data is."""
    bits = max(16, data.size.bit_length())
    power, back = _powers(which, bits), _powers(which, bits, -1)
    total = np.empty(data.size + 1, "u8")
    total[0] = 0
    np.cumsum(_values(which)[data] * power[: data.size], out=total[1:])
    return [tk.mix((total[s + n] - total[s]) * back[s]) if s.size else np.zeros(0, "u8") for s, n in zip(starts, lengths, strict=True)]


def _inside(offsets: np.ndarray, size: int, need: int) -> np.ndarray:
    """Which of `size` places start `need` bytes that end with their text."""
    end = np.repeat(offsets[1:], np.diff(offsets))[:size]
    return np.arange(end.size) + need <= end


def _runs(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of runs of equal values."""
    if not at.size:
        return at, at
    cut = np.flatnonzero(np.diff(at)) + 1
    return np.append(0, cut), np.append(cut, at.size)


def cut_up(bodies: list[bytes], length: int) -> Iterator[tuple[int, int, bytes]]:
    """(text, start, bytes): the texts, long ones in pieces that overlap so that each string lies in just one."""
    for i, body in enumerate(bodies):
        for start in range(0, max(1, len(body) - length + 1), PIECE):
            yield i, start, body[start : start + PIECE + length - 1]


def groups(parts: Iterator[tuple]) -> Iterator[list[tuple]]:
    """The parts, whose last field is bytes, in lists of about BATCH bytes."""
    held, size = [], 0
    for part in parts:
        held.append(part)
        size += len(part[-1])
        if size >= BATCH:
            yield held
            held, size = [], 0
    if held:
        yield held


def _joined(bodies: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.append(0, np.cumsum([len(b) for b in bodies])).astype("i8"), np.frombuffer(b"".join(bodies), "u1")


def long_anchors(docs: DataFrame, length: int) -> DataFrame:
    """digest, doc_id, and the long-range anchors of each text (fp: hash of LONG_GRAM bytes, lo and hi: first and last
    start of a string with that anchor)."""
    width = length - LONG_GRAM + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.small_batches(batches, "body", BATCH):
            text, fp, lo, hi = [], [], [], []
            for group in groups(cut_up(batch.column("body").to_pylist(), length)):
                offsets, data = _joined([g[-1] for g in group])
                values = windows(data, LONG_GRAM)
                at = lowest(values, width)
                p = np.flatnonzero(_inside(offsets, at.size, length))
                owner = np.searchsorted(offsets, p, side="right") - 1
                a, b = _runs(at[p])  # strings of different texts never have one anchor
                shift = np.array([g[1] for g in group], "i8")[owner[a]] - offsets[owner[a]]
                text.append(np.array([g[0] for g in group], "i8")[owner[a]])
                fp.append(values[at[p[a]]].view("i8"))
                lo.append((p[a] + shift).astype("i4"))
                hi.append((p[b - 1] + shift).astype("i4"))
            ends = pa.array(np.searchsorted(np.concatenate(text), np.arange(batch.num_rows + 1)).astype("i4"))
            fp, lo, hi = (pa.ListArray.from_arrays(ends, pa.array(np.concatenate(x))) for x in (fp, lo, hi))
            yield pa.RecordBatch.from_arrays([batch.column("digest"), batch.column("doc_id"), fp, lo, hi], names=["digest", "doc_id", "fp", "lo", "hi"])

    return docs.select("digest", "doc_id", "body").mapInArrow(run, "digest binary, doc_id long, fp array<long>, lo array<int>, hi array<int>")


def stretches(docs: DataFrame, spans: DataFrame, length: int) -> DataFrame:
    """Per piece of a stretch: digest, start, body, names (of its phrases), and for each anchor that has strings in it
    idx (its place among the anchors) and m (phrases within what all strings of an anchor cover)."""
    common_span = length - WINDOW + 1

    def cut(bodies: list[bytes], digests: list[bytes], spans: list) -> Iterator[tuple[bytes, int, bytes]]:
        for body, digest, own in zip(bodies, digests, spans, strict=True):
            own = sorted((x["lo"], x["hi"]) for x in own)
            merged: list[list[int]] = []
            for lo, hi in own:
                if merged and lo <= merged[-1][1] + length:
                    merged[-1][1] = max(merged[-1][1], hi)
                else:
                    merged.append([lo, hi])
            for lo, hi in merged:
                for start in range(lo, hi + 1, PIECE):
                    yield digest, start, body[start : min(start + PIECE, hi + 1) + length - 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.small_batches(batches, "body", BATCH):
            for group in groups(cut(*(batch.column(c).to_pylist() for c in ("body", "digest", "spans")))):
                offsets, data = _joined([g[-1] for g in group])
                anchor, owner, name, member, m = parsed(offsets, data, length, common_span)
                each = np.searchsorted(owner, np.arange(len(group) + 1))
                names, idx, counts = [], [], []
                for x, y in zip(each[:-1], each[1:], strict=True):
                    own = np.flatnonzero(member[x:y])
                    names.append(name[x : y - 1])
                    idx.append(own.astype("i4"))
                    counts.append(m[x:y][own].astype("i4"))
                out = [pa.array([g[0] for g in group], pa.binary()), pa.array([g[1] for g in group], pa.int32()), pa.array([g[2] for g in group], pa.binary())]
                out += [pa.array(names, pa.list_(pa.int64())), pa.array(idx, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays(out, names=["digest", "start", "body", "names", "idx", "m"])

    found = docs.join(spans, (docs["digest"] == spans["_digest"]) & docs["doc_id"].eqNullSafe(spans["rep"])).select("digest", "spans", "body")
    found = found.mapInArrow(run, "digest binary, start int, body binary, names array<long>, idx array<int>, m array<int>")
    return common.store(found.dropDuplicates(["digest", "start"]).withColumn("s", F.monotonically_increasing_id()))


def placed_anchors(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(the anchor of each window by its start; the anchors of all texts; the text of each)."""
    at = lowest(windows(data, GRAM), WINDOW)
    p = np.flatnonzero(_inside(offsets, at.size, WINDOW + GRAM - 1))
    first, _ = _runs(at[p])
    return at, at[p[first]].astype("i8"), np.searchsorted(offsets, p[first], side="right") - 1


def parsed(offsets: np.ndarray, data: np.ndarray, length: int, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each anchor: place, text, name of the phrase from it to the next (none for a text's last: 0), whether strings
    have it as their first anchor, and how many phrases lie within `span` bytes from it, whatever follows."""
    at, anchor, owner = placed_anchors(offsets, data)
    starts = np.unique(at[np.flatnonzero(_inside(offsets, at.size, length))])
    member = np.isin(anchor, starts, assume_unique=True)
    name = np.zeros(anchor.size, "i8")
    if anchor.size:
        bytes_ = data[anchor[0] : anchor[-1]]
        size = np.diff(anchor)
        step = np.arange(bytes_.size) - np.repeat(anchor[:-1] - anchor[0], size)
        power = np.cumprod(np.full(int(size.max(initial=0)) + 1, _BASES[0], "u8"))
        sums = np.add.reduceat(_values(0)[bytes_] * power[step], anchor[:-1] - anchor[0]) if size.size else np.zeros(0, "u8")
        name[:-1] = ((tk.mix(sums + size.astype("u8")) >> np.uint64(1)) | np.uint64(1)).view("i8")
    last = np.minimum(anchor + span - (WINDOW + GRAM - 1), at.size - 1)
    m = np.searchsorted(anchor, at[last]) - np.arange(anchor.size)
    return anchor, owner, name, member, m


def _below(distinct: DataFrame, keys: list[str], counts: list[str]) -> DataFrame:
    """distinct (keys, counts) with x_below for each count x: its sum over smaller keys. Sorted by ranges of the keys."""
    schema = distinct.select(*keys, *counts).schema.add("_part", "integer")
    for c in counts:
        schema = schema.add(f"{c}_below", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = dict.fromkeys(counts, 0)
        for batch in batches:
            out = [batch.column(c) for c in [*keys, *counts, "_part"]]
            for c in counts:
                values = batch.column(c).to_numpy(zero_copy_only=False)
                sums = np.cumsum(values)
                out.append(pa.array(sums - values + held[c]))
                held[c] += int(sums[-1]) if sums.size else 0
            yield pa.RecordBatch.from_arrays(out, names=schema.names)

    ranged = distinct.select(*keys, *counts).repartitionByRange(*keys).sortWithinPartitions(*keys)
    ranged = common.store(ranged.withColumn("_part", F.spark_partition_id()).mapInArrow(run, schema))
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    shifts = ranged.groupBy("_part").agg(*[F.sum(c).alias(f"_{c}") for c in counts])
    shifts = shifts.select("_part", *[F.coalesce(F.sum(f"_{c}").over(before), F.lit(0)).alias(f"_{c}") for c in counts])
    found = ranged.join(F.broadcast(shifts), "_part")
    return found.select(*keys, *[(F.col(f"{c}_below") + F.col(f"_{c}")).alias(f"{c}_below") for c in counts])


def followed(letters: DataFrame) -> DataFrame:
    """letters (s, i, c) with the next two letters of their string, c1 and c2 (0 at its end)."""
    row = W.partitionBy("s").orderBy("i")
    return letters.select("s", "i", "c", *[F.coalesce(F.lead("c", k).over(row), F.lit(0)).alias(f"c{k}") for k in (1, 2)])


def ranks(letters: DataFrame, most: int, cover: int = 1) -> DataFrame:
    """(s, i, r) for letters as followed() gives them (s: string, i: place from 0, c: letter over 0): r is the number
    of smaller suffixes.

    Suffixes count as equal when they agree in their first `most` letters of level 0, of which one letter covers
    `cover`, or more. The end of a string is smaller than any letter.
    """
    row = W.partitionBy("s").orderBy("i")
    wide = common.store(letters)
    place = F.col("i") % 3
    triples = wide.where(place > 0)
    keys = ["c", "c1", "c2"]
    named = _below(triples.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")), keys, ["n"])
    names = triples.select("s", "i", *keys).join(named, keys).select("s", "i", F.col("n_below").alias("r"))
    if 3 * cover < most:
        one = F.col("i") % 3 - 1
        deeper = names.select((2 * F.col("s") + one).alias("s"), F.floor(F.col("i") / 3).cast("int").alias("i"), (F.col("r") + 1).alias("c"))
        deeper = ranks(followed(deeper), most, 3 * cover)
        odd = F.pmod(F.col("s"), F.lit(2))
        names = deeper.select(F.floor(F.col("s") / 2).cast("long").alias("s"), (3 * F.col("i") + 1 + odd).cast("int").alias("i"), "r")
    else:
        names = common.store(names)
    held = wide.join(names, ["s", "i"], "left")
    held = held.select("s", "i", "c", "c1", "r", *[F.coalesce(F.lead("r", k).over(row) + 1, F.lit(0)).alias(f"r{k}") for k in (1, 2)])
    held = common.store(held)
    own = F.coalesce("r", F.lit(0))

    def merged(at: int, keys: list[str]) -> DataFrame:
        """What the suffixes at places 0 and `at` modulo 3 add to one another's ranks."""
        rows = held.where((place == 0) | (place == at))
        zero = F.sum(F.when(place == 0, 1).otherwise(0)).alias("z")
        both = _below(rows.groupBy(*keys).agg(zero, F.count(F.lit(1)).alias("n")), keys, ["z", "n"])
        # Suffixes at 0 meet one another here once, at 1.
        of_zero = F.col("n_below") if at == 1 else F.col("n_below") - F.col("z_below")
        return rows.join(both, keys).select("s", "i", F.when(place == 0, of_zero).otherwise(own + F.col("z_below")).alias("r"))

    both = merged(1, ["c", "r1"]).unionByName(merged(2, ["c", "c1", "r2"]))
    out = common.store(both.groupBy("s", "i").agg(F.sum("r").alias("r")))
    for x in (wide, held):
        common.drop_stored(x)
    return out


def classes(members: DataFrame) -> DataFrame:
    """(m, r, class) of the suffixes whose prefix is not alone, from members (m, r, prefix: an array of m names).

    Suffixes of one m are put in the order of their ranks; adjacent ones with equal prefixes are one class.
    """
    folded = members.groupBy("m", "r").agg(F.count(F.lit(1)).alias("n"), F.first("prefix").alias("prefix"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, first, at, part = None, None, -1, None
        for batch in batches:
            out = []
            part = batch.column("_part")[0].as_py()
            for prefix in batch.column("prefix").to_pylist():
                if prefix != last:
                    at, last = at + 1, prefix
                    first = prefix if first is None else first
                out.append(at)
            yield pa.RecordBatch.from_arrays([batch.column("m"), batch.column("r"), batch.column("n"), batch.column("_part"), pa.array(out, pa.int64()), pa.nulls(len(out), pa.list_(pa.int64())), pa.nulls(len(out), pa.list_(pa.int64()))], names=names)
        if part is not None:
            none = [pa.nulls(1, t) for t in (pa.int32(), pa.int64(), pa.int64())]
            yield pa.RecordBatch.from_arrays([*none, pa.array([part], pa.int32()), pa.array([at + 1], pa.int64()), pa.array([first], pa.list_(pa.int64())), pa.array([last], pa.list_(pa.int64()))], names=names)

    names = ["m", "r", "n", "_part", "at", "first", "last"]
    ranged = folded.repartitionByRange("m", "r").sortWithinPartitions("m", "r").withColumn("_part", F.spark_partition_id())
    found = common.store(ranged.mapInArrow(run, "m int, r long, n long, _part int, at long, first array<long>, last array<long>"))
    # A row for each task of the sort: how many runs it has, and the prefixes of its first and last.
    shift, last, shifts = 0, None, []
    for part in found.where("first is not null").orderBy("_part").collect():
        shift -= part["last"] is not None and part["first"] == last
        shifts.append((part["_part"], shift))
        shift, last = shift + part["at"], part["last"]
    table = members.sparkSession.createDataFrame(shifts, "_part int, _shift long")
    placed = found.where("first is null").join(F.broadcast(table), "_part").select("m", "r", "n", (F.col("at") + F.col("_shift")).alias("class"))
    placed = common.store(placed)
    shared = placed.groupBy("class").agg(F.sum("n").alias("k")).where("k > 1").select("class")
    return common.store(placed.join(shared, "class").select("m", "r", "class"))


def _listed(column: pa.Array, names: list[str]) -> tuple[np.ndarray, list[np.ndarray]]:
    """(row of each entry, its fields) of a column of lists of structs; a null number is -1."""
    flat = column.flatten()
    rows = np.repeat(np.arange(len(column)), column.value_lengths().to_numpy(zero_copy_only=False))
    return rows, [flat.field(flat.type.get_field_index(n)).fill_null(-1).to_numpy(zero_copy_only=False).astype("i8") for n in names]


def _places(offsets: np.ndarray, data: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchors; the first of each text in them; starts of strings; the anchor of each as a place among the anchors)."""
    at, anchor, owner = placed_anchors(offsets, data)
    p = np.flatnonzero(_inside(offsets, at.size, length))
    return anchor, np.searchsorted(owner, np.arange(offsets.size - 1)), p, np.searchsorted(anchor, at[p])


def _keys(batches: Iterator[pa.RecordBatch], length: int, size: int) -> Iterator[pa.RecordBatch]:
    """For stretches with anchors (own: idx, b, class; b: the block of BLOCK strings, -1 for all): a row for each block of
    `size` strings of them that holds a string. The block's number counts from the anchor back; c1, c2: hash of the
    bytes that all its strings share; f1, f2: of those that any covers, null where the stretch ends before them."""
    for batch in common.small_batches(batches, "body", BATCH):
        for first, group in _row_groups(batch.column("body").to_pylist()):
            offsets, data = _joined(group)
            rows, (idx, block, cls) = _listed(batch.column("own").slice(first, len(group)), ["idx", "b", "class"])
            anchor, base, p, of = _places(offsets, data, length)
            place = base[rows] + idx
            # Strings and the anchors that ask for them meet by anchor; an anchor may ask for several blocks.
            lo, hi = np.searchsorted(of, place), np.searchsorted(of, place, side="right")
            each = np.repeat(np.arange(place.size), hi - lo)
            start = p[np.arange(each.size) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo) + np.repeat(lo, hi - lo)]
            back = anchor[place[each]] - start
            ok = (block[each] < 0) | (back // BLOCK == block[each])
            each, number = each[ok], back[ok] // size
            keep = np.flatnonzero(np.append(True, (np.diff(each) != 0) | (np.diff(number) != 0))) if each.size else each
            each, number = each[keep], number[keep]
            at, row = anchor[place[each]], rows[each]
            wide = length + size - 1
            begin = at - number * size - (size - 1)
            fits = (begin >= offsets[row]) & (begin + wide <= offsets[row + 1])
            out = [batch.column("s").slice(first, len(group)).take(pa.array(row)), pa.array(idx[each].astype("i4")), pa.array(number.astype("i4")), pa.array(cls[each])]
            whole = np.flatnonzero(fits)
            starts, lengths = [begin[whole]], [wide]
            if length >= size:
                starts, lengths = [at - number * size, *starts], [length - size + 1, *lengths]
            else:
                out += [pa.nulls(row.size, pa.int64())] * 2
            found = [hashes_at(data, starts, lengths, which) for which in (0, 1)]
            if length >= size:
                out += [pa.array(f[0].view("i8")) for f in found]
            for f in found:
                value = np.zeros(row.size, "i8")
                value[whole] = f[-1].view("i8")
                out.append(pa.array(value, mask=~fits))
            yield pa.RecordBatch.from_arrays(out, names=["s", "idx", "b", "class", "c1", "c2", "f1", "f2"])


def _row_groups(bodies: list[bytes]) -> Iterator[tuple[int, list[bytes]]]:
    """(first row, bodies) of rows in a row with about BATCH bytes."""
    for group in groups(zip(range(len(bodies)), bodies, strict=True)):
        yield group[0][0], [g[-1] for g in group]


def repeats(held: DataFrame, placed: DataFrame, length: int) -> DataFrame:
    """(s, idx, b, o) of strings that repeat: all of an anchor's (b and o null), a block's, or the one that starts o
    bytes before the anchor. held: stretches; placed: (s, idx, class) of anchors in classes."""
    schema = "s long, idx int, b int, class long, c1 long, c2 long, f1 long, f2 long"
    none = F.lit(None).cast("int")

    def keyed(anchors: DataFrame, size: int) -> DataFrame:
        own = anchors.groupBy("s").agg(F.collect_list(F.struct("idx", "b", "class")).alias("own"))
        rows = held.select("s", "body").join(own, "s").select("s", "body", "own")
        return common.store(rows.mapInArrow(lambda batches: _keys(batches, length, size), schema))

    def judged(rows: DataFrame, core: bool) -> tuple[DataFrame, DataFrame]:
        """(blocks whose strings all repeat; of those that are left, and of one of each kind of sure ones beside them,
        what the next level needs)."""
        full, shared = ["class", "b", "f1", "f2"], ["class", "b", *(["c1", "c2"] if core else [])]
        folded = common.store(rows.where("f1 is not null").groupBy(*full).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("s", "idx", *shared[2:])).alias("one")).where("n > 1"))
        sure = common.store(rows.join(folded, full, "left_semi").select("s", "idx", "b"))
        rest = rows.join(sure, ["s", "idx", "b"], "left_anti")
        ones = folded.select("class", "b", "one.*")
        some = rest.select("s", "idx", *shared).unionByName(ones.select("s", "idx", *shared)) if core else None
        if core:
            # What a block's strings share must occur twice; sure blocks count, once for each kind.
            alive = some.groupBy(*shared).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*shared)
            rest = common.store(rest.join(alive, shared, "left_semi").select("s", "idx", *shared))
        wanted = rest.select(*shared).distinct()
        open_ = rest.select("s", "idx", "b", "class").unionByName(ones.join(wanted, shared, "left_semi").select("s", "idx", "b", "class"))
        return sure, common.store(open_)

    whole = keyed(placed.withColumn("b", none), WINDOW)
    sure, open_ = judged(whole, False)
    common.drop_stored(whole)
    blocks = keyed(open_.withColumn("b", none), BLOCK)
    part, open_ = judged(blocks, True)
    common.drop_stored(blocks)
    strings = keyed(open_, 1)
    key = ["class", "c1", "c2"]
    twice = strings.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    single = strings.join(twice, key, "left_semi").select("s", "idx", none.alias("b"), F.col("b").alias("o"))
    every = sure.select("s", "idx", none.alias("b"), none.alias("o")).unionByName(part.select("s", "idx", "b", none.alias("o"))).unionByName(single)
    return common.store(every)


def removed(held: DataFrame, found: DataFrame, length: int) -> DataFrame:
    """digest and cuts (from, to) of the bytes that repeated strings cover."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.small_batches(batches, "body", BATCH):
            for at, group in _row_groups(batch.column("body").to_pylist()):
                offsets, data = _joined(group)
                rows, (idx, block, back) = _listed(batch.column("found").slice(at, len(group)), ["idx", "b", "o"])
                anchor, base, p, of = _places(offsets, data, length)
                place = base[rows] + idx
                # Codes of (anchor, what of it): -1 all, else a block, or a single string beyond all blocks.
                blocks = WINDOW // BLOCK + 1
                code = lambda a, k: a * (blocks + WINDOW + 1) + k + 1
                asked = np.unique(code(place, np.where(back >= 0, blocks + back, block)))
                before = anchor[of] - p
                hit = np.zeros(p.size, bool)
                for k in (np.full(p.size, -1), before // BLOCK, blocks + before):
                    hit |= np.isin(code(of, k), asked)
                go = np.zeros(data.size + 1, "i8")
                np.add.at(go, p[hit], 1)
                np.add.at(go, p[hit] + length, -1)
                gone = np.cumsum(go)[:-1] > 0
                border = np.zeros(data.size, bool)
                border[offsets[:-1][offsets[:-1] < data.size]] = True
                first = np.flatnonzero(gone & (border | ~np.append(False, gone[:-1])))
                last = np.flatnonzero(gone & np.append(border[1:] | ~gone[1:], True)) + 1
                own = np.searchsorted(offsets, first, side="right") - 1
                shift = batch.column("start").to_numpy(zero_copy_only=False)[at + own] - offsets[own]
                yield pa.RecordBatch.from_arrays([batch.column("digest").take(pa.array(at + own)), pa.array((first + shift).astype("i4")), pa.array((last + shift).astype("i4"))], names=["digest", "lo", "hi"])

    own = found.groupBy("s").agg(F.collect_list(F.struct("idx", "b", "o")).alias("found"))
    rows = held.select("s", "digest", "start", "body").join(own, "s").select("digest", "start", "body", "found")
    cuts = rows.mapInArrow(run, "digest binary, lo int, hi int")
    return common.store(cuts.groupBy("digest").agg(F.collect_list(F.struct("lo", "hi")).alias("cuts")))


def _release(df: DataFrame) -> None:
    """Lets Spark delete the shuffle files of stages that nothing reads any more."""
    gc.collect()
    df.sparkSession._jvm.System.gc()


def without_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (binary: the bytes that stay) for every row of docs.

    docs has doc_id (whole numbers, may be null or repeat) and text; other columns are not read, whatever their names.
    Texts count as UTF-8 bytes, null as empty. Strings are judged on the input, never across texts; a text shorter
    than `length` keeps all. Of equal texts with `length` bytes or more nothing stays. length is at least LEAST.
    """
    if length < LEAST:
        raise ValueError(f"strings of fewer than {LEAST} bytes may have no anchor of their own")
    body = common.text_bytes()
    rows = common.bound_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), body.alias("body"), F.unhex(F.md5(body)).alias("digest")))
    long = rows.where(F.length("body") >= length)
    each = common.store(long_anchors(long, length))
    texts = common.store(each.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("rep"), F.min(F.struct("fp", "lo", "hi")).alias("a")).select("digest", "n", "rep", "a.*"))
    common.drop_stored(each)
    places = texts.select("digest", F.explode(F.arrays_zip("fp", "lo", "hi")).alias("x")).select("digest", "x.*")
    twice = common.store(places.groupBy("fp").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("fp"))
    spans = places.join(twice, "fp", "left_semi").groupBy("digest").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))
    spans = common.store(spans.join(texts.select("digest", "rep"), "digest").withColumnRenamed("digest", "_digest"))
    copies = common.store(texts.where("n > 1").select("digest", F.lit(True).alias("all")))
    for x in (texts, twice):
        common.drop_stored(x)
    _release(rows)
    held = stretches(long, spans, length)
    common.drop_stored(spans)
    _release(rows)
    anchors = held.select("s", "names", F.explode(F.arrays_zip("idx", "m")).alias("x"))
    anchors = anchors.select("s", F.col("x.idx").alias("i"), F.col("x.m").alias("m"), F.slice("names", F.col("x.idx") + 1, F.col("x.m")).alias("prefix"))
    most = held.agg(F.max(F.array_max("m"))).first()[0] or 0
    following = F.transform("names", lambda c, i: F.struct(i.alias("i"), c.alias("c"), *[F.coalesce(F.get("names", i + k), F.lit(0)).alias(f"c{k}") for k in (1, 2)]))
    letters = held.select("s", F.explode(following).alias("x")).select("s", "x.*")
    order = ranks(letters, most)
    _release(rows)
    members = common.store(anchors.join(order, ["s", "i"]))
    shared = classes(members)
    placed = common.store(members.select("s", F.col("i").alias("idx"), "m", "r").join(shared, ["m", "r"]).select("s", "idx", "class"))
    for x in (order, members, shared):
        common.drop_stored(x)
    _release(rows)
    cuts = removed(held, repeats(held, placed, length), length)
    _release(rows)
    gone = copies.join(cuts, "digest", "full").select(F.col("digest").alias("_digest"), F.coalesce("all", F.lit(False)).alias("all"), "cuts")
    gone = common.store(gone.withColumn("cuts", F.when(~F.col("all"), F.col("cuts"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.small_batches(batches, "body"):
            out = []
            for body, whole, cuts in zip(*(batch.column(c).to_pylist() for c in ("body", "all", "cuts")), strict=True):
                spans = merged([(0, len(body))] if whole else [(c["lo"], c["hi"]) for c in cuts or []])
                kept, at = [], 0
                for lo, hi in spans:
                    kept.append(body[at:lo])
                    at = hi
                kept.append(body[at:])
                out.append((len(body), sum(hi - lo for lo, hi in spans), len(spans), b"".join(kept)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array([o[k] for o in out], pa.int64()) for k in range(3)), pa.array([o[3] for o in out], pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    both = rows.join(gone, rows["digest"] == gone["_digest"], "left").select("doc_id", "body", "all", "cuts")
    return both.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans in order, those that meet or overlap made one."""
    out: list[tuple[int, int]] = []
    for lo, hi in sorted(spans):
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], hi))
        else:
            out.append((lo, hi))
    return out


def op11_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the bytes that repeated strings of 200 bytes cover: counts and digest of what stays."""
    found = without_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
