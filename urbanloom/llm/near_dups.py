"""Near-duplicates by b-bit MinHash: bands of minima propose, packed low bits estimate, whole sets confirm.

Documents with equal shingle sets are one class. A class has PERMUTATIONS minima; ROWS of them make a band, and
classes that share a band are candidates: a pair of similarity s is missed with chance (1 - s^ROWS)^BANDS, which
is 1e-7 at 0.8. Of each minimum the two lowest bits are kept (after higher ones are folded into them, as minima of
large sets are small), in two bit planes; from the bits that agree follows the similarity, corrected for chance agreement, and a pair whose estimate is lower than the threshold by SLACK (six
standard deviations) is dropped. All others are confirmed on their whole sets.

Buckets are not paired out at first. Each class is held against the smallest class of its buckets; confirmed links
make components. Only buckets whose classes are then in several components are searched further, in blocks and on
sketches alone, for pairs over component borders, and of these what is needed to join components is confirmed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from . import tokens as tk
from .components import components

ROWS, BANDS = 5, 40
PERMUTATIONS = ROWS * BANDS
WORDS = -(-PERMUTATIONS // 64)
SLACK = 0.2
PERCENT = 80
#: Classes of one search block, and texts and shingles of one confirming block: they bound a task's memory.
SKETCH_BLOCK, TEXT_BLOCK, SHINGLE_BLOCK = 1024, 256, 1 << 20
#: Up to so many rows (about 60 bytes each) are broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 200_000
BATCH = 1 << 20

_RANDOM = np.random.Generator(np.random.PCG64(77))
_A = (_RANDOM.integers(0, 2**31, PERMUTATIONS, dtype="u4") << np.uint32(1)) | np.uint32(1)
_B = _RANDOM.integers(0, 2**32, PERMUTATIONS, dtype="u4")


def shingle_sets(column: pa.Array, n: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text of a binary column.

    A shingle is n words in a row, A-Z in lower case; a text of fewer words has them all as its one shingle,
    a text without words none.
    """
    hashes, _, doc = tk.tokens(*tk.flat(column), tk.word_classes(), tk.lower_table())
    grams, gram_doc = tk.grams(hashes, doc, n)
    each = np.arange(len(column) + 1)
    a, w = np.searchsorted(gram_doc, each), np.searchsorted(doc, each)
    out = []
    for i in range(len(column)):
        if a[i + 1] > a[i]:
            out.append(np.unique(grams[a[i] : a[i + 1]]))
        elif w[i + 1] > w[i]:
            whole = tk.grams(hashes[w[i] : w[i + 1]], np.zeros(w[i + 1] - w[i], "i8"), int(w[i + 1] - w[i]))[0]
            out.append(tk.mix(whole + np.uint64(w[i + 1] - w[i])))
        else:
            out.append(grams[:0])
    return out


def signatures(sets: list[np.ndarray]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """(class ids, bands, sketches) of sets that are not empty."""
    flat = np.concatenate(sets)
    starts = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    low = np.add.reduceat(tk.mix(flat), starts)
    high = np.bitwise_xor.reduceat(tk.mix(flat + np.uint64(0x5851F42D4C957F2D)), starts)
    ids = [a.tobytes() + b.tobytes() for a, b in zip(high.astype(">u8"), low.astype(">u8"), strict=True)]
    x = (flat >> np.uint64(32)).astype("u4") ^ flat.astype("u4")
    minima = np.empty((len(sets), PERMUTATIONS), "u4")
    for k in range(PERMUTATIONS):
        minima[:, k] = np.minimum.reduceat(x * _A[k] + _B[k], starts)
    bands = np.zeros((len(sets), BANDS), "u8") + np.arange(BANDS, dtype="u8")
    for r in range(ROWS):
        bands = tk.mix(bands * np.uint64(0x2545F4914F6CDD1D) + minima[:, r::ROWS])
    folded = minima ^ (minima >> np.uint32(7)) ^ (minima >> np.uint32(15))
    planes = []
    for bit in (0, 1):
        bits = np.zeros((len(sets), WORDS * 64), "u1")
        bits[:, :PERMUTATIONS] = folded >> np.uint32(bit) & np.uint32(1)
        planes.append(np.packbits(bits, axis=1, bitorder="little").view("<i8"))
    return ids, bands.view("i8"), np.concatenate(planes, axis=1)


def estimate(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Similarity of sketches: agreeing codes, less the quarter that agrees by chance."""
    mixed = (x[..., :WORDS] ^ y[..., :WORDS]) | (x[..., WORDS:] ^ y[..., WORDS:])
    differ = np.bitwise_count(mixed.astype("u8")).sum(axis=-1, dtype="i8")  # of signed numbers it counts the absolute value's bits
    return (1 - differ / PERMUTATIONS - 0.25) / 0.75


def _estimate_column(x: Column, y: Column) -> Column:
    """The same as estimate(), for array columns."""
    parts = [F.bit_count((x[i].bitwiseXOR(y[i])).bitwiseOR(x[WORDS + i].bitwiseXOR(y[WORDS + i]))) for i in range(WORDS)]
    differ = parts[0]
    for p in parts[1:]:
        differ = differ + p
    return (F.lit(0.75) - differ / F.lit(float(PERMUTATIONS))) / F.lit(0.75)


def sketched(docs: DataFrame, n: int) -> DataFrame:
    """Per row of docs: doc_id, text_hash, n_shingles, cid (its class; null without words), bands, sketch."""
    schema = "doc_id long, text_hash long, n_shingles long, cid binary, bands array<long>, sketch array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.small_batches(batches, "body", BATCH):
            sets = shingle_sets(batch.column("body"), n)
            filled = [i for i, s in enumerate(sets) if len(s)]
            cid, bands, sketch = [None] * len(sets), [None] * len(sets), [None] * len(sets)
            if filled:
                ids, b, k = signatures([sets[i] for i in filled])
                for i, c, x, y in zip(filled, ids, b.tolist(), k.tolist(), strict=True):
                    cid[i], bands[i], sketch[i] = c, x, y
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_hash"), pa.array([len(s) for s in sets], pa.int64()), pa.array(cid, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(sketch, pa.list_(pa.int64()))],
                names=["doc_id", "text_hash", "n_shingles", "cid", "bands", "sketch"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), common.text_bytes().alias("body"))
    return common.bound_batches(rows).mapInArrow(run, schema)


def linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether 100 * intersection >= percent * union, for sorted sets."""
    small, large = (x, y) if len(x) <= len(y) else (y, x)
    if 100 * len(small) < percent * len(large):
        return False
    both = int(np.isin(small, large, assume_unique=True).sum())
    return 100 * both >= percent * (len(x) + len(y) - both)


def confirm(comps: list, sets: list[np.ndarray], sketches: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Confirmed links that join the components of a block's members: a forest, so at most one link a member.

    Pairs within a component, or joined through earlier links, need no look.
    """
    n = len(sets)
    names = {c: i for i, c in enumerate(dict.fromkeys(comps))}
    label = np.array([names[c] for c in comps])
    sizes = np.array([len(s) for s in sets])
    links = []
    for i in range(n):
        est = estimate(sketches[i], sketches[i + 1 :])
        close = (est >= percent / 100 - SLACK) & (100 * np.minimum(sizes[i], sizes[i + 1 :]) >= percent * np.maximum(sizes[i], sizes[i + 1 :]))
        for j in np.flatnonzero(close) + i + 1:
            if label[i] != label[j] and linked(sets[i], sets[j], percent):
                links.append((i, int(j)))
                label[label == label[j]] = label[i]
    return links


def _confirm_units(units: DataFrame, bodies: DataFrame, n: int, percent: int) -> DataFrame:
    """Links (a, b) found within units (unit, cid, comp, sketch), whose texts are bodies (cid, body)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates("cid").sort_values("cid")
        column = pa.array(pdf["body"].tolist(), pa.binary())
        sketches = np.array(pdf["sketch"].tolist(), "i8").reshape(len(pdf), 2 * WORDS)
        found = confirm(pdf["comp"].tolist(), shingle_sets(column, n), sketches, percent)
        cid = pdf["cid"].tolist()
        return pd.DataFrame({"a": [cid[i] for i, _ in found], "b": [cid[j] for _, j in found]})

    return units.join(bodies, "cid").groupBy("unit").applyInPandas(run, "a binary, b binary")


def _bodies(docs: DataFrame, classes: DataFrame, cids: DataFrame, parts: int) -> DataFrame:
    """(cid, body) of the classes named in cids, each from one of its rows."""
    wanted = classes.join(cids, "cid", "left_semi").select("cid", F.col("rep.doc_id").alias("_d"), F.col("rep.text_hash").alias("_t"))
    wanted = common.store(wanted, parts=parts, wide=True)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), common.text_bytes().alias("body"))
    side = F.broadcast(wanted) if wanted.count() <= BROADCAST_ROWS else wanted
    return common.store(rows.join(side, rows["doc_id"].eqNullSafe(side["_d"]) & (rows["text_hash"] == side["_t"])).select("cid", "body"))


def _parts_of(n: Column, shingles: Column, size: int) -> Column:
    """Into how many blocks n members with so many shingles go: about `size` members and SHINGLE_BLOCK shingles each."""
    return F.greatest(F.ceil(n / size), F.ceil(shingles / SHINGLE_BLOCK), F.lit(1)).cast("int")


def _blocks(members: DataFrame, key: str, size: int) -> DataFrame:
    """members (key, cid, comp, n_shingles, ...) with a number of each `unit` that they are in, so that any two of a
    key and of different components meet; units that share a number only do more work.

    A key with few members is one unit. In others the members of its largest component are dealt into blocks, and
    so are all others: each block of the first meets each of the others, and the others meet each other. So rows
    repeat with the number of members outside the largest component, not with the square of the group.
    """
    by = members.groupBy(key, "comp").agg(F.count(F.lit(1)).alias("c"), F.sum("n_shingles").alias("s"))
    by = by.groupBy(key).agg(F.max(F.struct("c", "s", "comp")).alias("top"), F.sum("c").alias("c"), F.sum("s").alias("s"))
    rest_c, rest_s = F.col("c") - F.col("top.c"), F.col("s") - F.col("top.s")
    by = by.select(key, F.col("top.comp").alias("_top"), (_parts_of(F.col("c"), F.col("s"), size) == 1).alias("_one"), _parts_of(F.col("top.c"), F.col("top.s"), size).alias("_a"), _parts_of(rest_c, rest_s, size).alias("_b"))
    dealt = members.join(common.store(by), key).withColumn("_in", F.col("comp") == F.col("_top"))
    dealt = dealt.withColumn("_block", F.pmod(F.xxhash64("cid"), F.when(F.col("_in"), F.col("_a")).otherwise(F.col("_b"))).cast("int"))
    own = F.col("_block")
    with_rest = F.transform(F.sequence(F.lit(0), F.col("_b") - 1), lambda j: F.xxhash64(key, F.lit("x"), own, j))
    with_top = F.transform(F.sequence(F.lit(0), F.col("_a") - 1), lambda i: F.xxhash64(key, F.lit("x"), i, own))
    others = F.filter(F.sequence(F.lit(0), F.col("_b") - 1), lambda j: j != own)
    with_others = F.transform(others, lambda j: F.xxhash64(key, F.lit("y"), F.least(own, j), F.greatest(own, j)))
    units = F.when(F.col("_one"), F.array(F.xxhash64(key))).when(F.col("_in"), with_rest).otherwise(F.concat(with_top, with_others))
    return dealt.withColumn("unit", F.explode(units)).drop("_top", "_one", "_a", "_b", "_in", "_block")


def classes_of(rows: DataFrame) -> DataFrame:
    """One row for each class: cid, n_shingles, first_id (smallest doc_id), rep (a row of it), bands, sketch."""
    held = rows.where("cid is not null")
    return held.groupBy("cid").agg(F.min("doc_id").alias("first_id"), F.min(F.struct("doc_id", "text_hash")).alias("rep"), F.first("n_shingles").alias("n_shingles"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"))


def links(docs: DataFrame, classes: DataFrame, n: int, percent: int) -> DataFrame:
    """(node, comp) of all classes that are linked with another."""
    parts = common.parts_for(classes.count())
    banded = classes.select("cid", F.explode("bands").alias("band"))
    shared = banded.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.min("cid").alias("hub")).where("n > 1")
    # Written once; sorted out of all buckets are those of a single class, most of them.
    members = common.store(banded.join(shared, "band").select("band", "n", "hub", "cid"), parts=parts)
    near = percent / 100 - SLACK
    sketch = classes.select("cid", "sketch", "n_shingles")
    stars = members.where("cid <> hub").select("hub", "cid").distinct()
    stars = stars.join(sketch, "cid").join(sketch.select(F.col("cid").alias("hub"), F.col("sketch").alias("hub_sketch"), F.col("n_shingles").alias("hub_shingles")), "hub")
    stars = common.store(stars.where(_estimate_column(F.col("sketch"), F.col("hub_sketch")) >= near), parts=parts, wide=True)
    # One hub for each class, the smallest that is close enough: a class is confirmed in one unit.
    own = stars.groupBy("cid").agg(F.min(F.struct("hub", "sketch", "n_shingles", "hub_sketch")).alias("s")).select("cid", "s.*")
    hubs = own.groupBy("hub").agg(_parts_of(F.count(F.lit(1)), F.sum("n_shingles"), TEXT_BLOCK).alias("of"), F.first("hub_sketch").alias("sketch"))
    hubs = common.store(hubs, parts=parts)
    first = own.select("hub", "cid", "sketch").join(hubs.select("hub", "of"), "hub")
    first = first.select(F.xxhash64("hub", F.pmod(F.xxhash64("cid"), F.col("of")).cast("int")).alias("unit"), "cid", "sketch")
    with_hub = hubs.select("hub", "sketch", F.explode(F.sequence(F.lit(0), F.col("of") - 1)).alias("i"))
    with_hub = with_hub.select(F.xxhash64("hub", "i").alias("unit"), F.col("hub").alias("cid"), "sketch")
    units = common.store(first.unionByName(with_hub).withColumn("comp", F.col("cid")), parts=parts)
    bodies = _bodies(docs, classes, units.select("cid").distinct(), parts)
    found = common.store(_confirm_units(units, bodies, n, percent), parts=parts, wide=True)
    labels = components(found)
    # Close pairs of other hubs, and buckets of three or more, whose classes are still apart.
    comp = labels.select(F.col("node").alias("cid"), F.col("comp"))
    pairs = stars.join(comp, "cid", "left").withColumn("comp", F.coalesce("comp", "cid"))
    pairs = pairs.join(comp.select(F.col("cid").alias("hub"), F.col("comp").alias("hub_comp")), "hub", "left").withColumn("hub_comp", F.coalesce("hub_comp", "hub"))
    pairs = common.store(pairs.where("comp <> hub_comp"), parts=parts)
    members = members.where("n > 2").join(comp, "cid", "left").withColumn("comp", F.coalesce("comp", "cid"))
    open_ = members.groupBy("band").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x <> y").select("band")
    apart = common.store(members.join(open_, "band").join(sketch, "cid").select("band", "cid", "comp", "sketch", F.lit(0).alias("n_shingles"), F.col("n_shingles").alias("held")), parts=parts, wide=True)

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        """Pairs of components that close sketches join: a forest over the block's components."""
        pdf = pdf.sort_values("cid")
        sketches = np.array(pdf["sketch"].tolist(), "i8").reshape(len(pdf), 2 * WORDS)
        label, names = pd.factorize(pdf["comp"])
        start, out = label.copy(), []
        for i in range(len(pdf)):
            apart_ = np.flatnonzero(label[i + 1 :] != label[i]) + i + 1
            if apart_.size:
                for j in apart_[estimate(sketches[i], sketches[apart_]) >= near]:
                    if label[i] != label[j]:
                        out.append((names[start[i]], names[start[j]]))
                        label[label == label[j]] = label[i]
        return pd.DataFrame({"a": [x for x, _ in out], "b": [y for _, y in out]}, columns=["a", "b"])

    proposed = _blocks(apart, "band", SKETCH_BLOCK).select("unit", "cid", "comp", "sketch").groupBy("unit").applyInPandas(search, "a binary, b binary")
    proposed = common.store(proposed.unionByName(pairs.select(F.col("comp").alias("a"), F.col("hub_comp").alias("b"))).distinct(), parts=parts, wide=True)
    if not proposed.limit(1).count():
        return labels
    clusters = components(proposed).select(F.col("node").alias("comp"), F.col("comp").alias("cluster"))
    again = apart.select("cid", "comp", "sketch", F.col("held").alias("n_shingles"))
    again = again.unionByName(pairs.select("cid", "comp", "sketch", "n_shingles"))
    again = again.unionByName(pairs.select(F.col("hub").alias("cid"), F.col("hub_comp").alias("comp"), F.col("hub_sketch").alias("sketch"), F.col("hub_shingles").alias("n_shingles")))
    again = again.dropDuplicates(["cid"]).join(clusters, "comp")
    units = common.store(_blocks(again, "cluster", TEXT_BLOCK).select("unit", "cid", "comp", "sketch"), parts=parts)
    more = common.store(_confirm_units(units, _bodies(docs, classes, units.select("cid").distinct(), parts), n, percent), parts=parts, wide=True)
    return components(found.unionByName(more))


def near_duplicates(docs: DataFrame, n: int = 5, percent: int = PERCENT) -> DataFrame:
    """A row for each row of docs: doc_id, text_hash, n_shingles, comp (its component; null without words),
    component_id, kept.

    docs needs doc_id and text. Rows are linked when their sets of n-word shingles have 100 * intersection >=
    percent * union; component_id is the smallest doc_id that is reached over links (rows without words, and
    null texts, reach themselves alone). kept: doc_id = component_id, or no row of the component has an id.
    Equal rows have equal results.
    """
    rows = common.store(sketched(docs, n))
    classes = common.store(classes_of(rows))
    labels = links(docs, classes, n, percent)
    placed = classes.select("cid", "first_id").join(labels.withColumnRenamed("node", "cid"), "cid", "left").withColumn("comp", F.coalesce("comp", "cid"))
    lowest = placed.groupBy("comp").agg(F.min("first_id").alias("component_id"))
    placed = common.store(placed.select("cid", "comp").join(lowest, "comp").select("cid", "comp", "component_id"), parts=common.parts_for(classes.count()))
    full = rows.where("cid is not null").select("doc_id", "text_hash", "n_shingles", "cid").join(placed, "cid").drop("cid")
    empty = rows.where("cid is null").select("doc_id", "text_hash", "n_shingles", F.lit(None).cast("binary").alias("comp"), F.col("doc_id").alias("component_id"))
    every = full.unionByName(empty)
    return every.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()))


def one_of_each(docs: DataFrame, n: int = 5, percent: int = PERCENT) -> DataFrame:
    """docs with one row of each component: that with the smallest doc_id (null last), then text_hash.

    Rows without words stay, all of them. All columns and their order stay.
    """
    placed, (text, doc_id) = common.by_place(docs, "text", "doc_id")
    found = common.store(near_duplicates(placed.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), n, percent).select("doc_id", "text_hash", "comp").where("comp is not null"))
    key = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    best = common.store(found.groupBy("comp").agg(F.min(key).alias("best")))
    judged = found.select("comp", key.alias("key")).join(best, "comp")
    # Keys that go, and keys of which several equal rows would stay.
    gone = judged.where("key <> best").select("key.doc_id", "key.text_hash").distinct()
    again = judged.where("key = best").groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key.doc_id", "key.text_hash")
    gone, again = common.store(gone), common.store(again)
    rows = placed.select(*placed.columns, F.col(doc_id).cast("long").alias("_d"), F.xxhash64(text).alias("_t"))

    def match(side: DataFrame, how: str) -> DataFrame:
        side = side.select(F.col("doc_id").alias("_sd"), F.col("text_hash").alias("_st"))
        side = F.broadcast(side) if side.count() <= BROADCAST_ROWS else side
        return rows.join(side, F.col("_d").eqNullSafe(F.col("_sd")) & (F.col("_t") == F.col("_st")), how)

    rows = match(gone, "left_anti")
    if again.limit(1).count():
        rows = match(again, "left_anti").unionByName(match(again, "left_semi").dropDuplicates(["_d", "_t"]))
    return rows.drop("_d", "_t").toDF(*docs.columns)


def op5_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's component over links of 2-word shingle sets at 80 %."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return near_duplicates(docs, n=2).select("doc_id", "n_shingles", "component_id", "kept")
