"""Mixing sources to target weights: pivotal dependent rounding of copy counts, in DataFrame functions only.

Every document of a source should be taken `target / source size` times. The whole part of that is taken as it
is; the fractions are rounded in pairs. Two documents with fractions p, q and sizes s, t exchange words: either
the first gains what the second loses, or the reverse, with the chances that keep both expectations, until one
fraction is 0 or 1. The words of the pair stay the same, so what a source takes differs from its target by less
than its last document. Pairs are folded in blocks of a source; what is left of each block goes to the
next level of a reduction tree, until one document of each source is left.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common

#: Weights of the sources in code point order, repeating; most copies of a word.
WEIGHTS = (1, 2, 3)
MOST = 3
#: Items of a block on average; the reduction tree's fan-in.
FAN = 64
#: Equal rows that one task writes out or numbers, about.
RUN = 4096
WORD = r"[^\x20\x09-\x0D]+"
KEY = ["source", "doc_id", "size", "text_hash"]
ITEM = "struct<h: bigint, source: string, doc_id: bigint, size: bigint, text_hash: bigint, p: double>"
DONE = "array<struct<source: string, doc_id: bigint, size: bigint, text_hash: bigint, up: int>>"


def sizes(docs: DataFrame) -> DataFrame:
    """KEY of each document: its size is its number of words (null text: 0)."""
    count = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    return docs.select(F.col("source").cast("string").alias("source"), F.col("doc_id").cast("long").alias("doc_id"), count.alias("size"), F.xxhash64("text").alias("text_hash"))


def targets(items: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """Per source (null is one): source_size, n items, target in words, rate = target / source_size.

    Sources share the sum of all sizes by weight; a target stops at `most` times its source's size, and the
    excess goes to the others by weight. In the order of cap / weight the stopped sources come first, so running
    sums give the level at which the others share. One row for each source.
    """
    by = items.groupBy("source").agg(F.sum(F.col("size") * F.col("m")).alias("source_size"), F.count(F.lit(1)).alias("n"))
    place = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    by = by.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), F.pmod(place, F.lit(len(weights))) + 1).cast("double"))
    by = by.withColumn("cap", F.col("source_size") * F.lit(float(most))).withColumn("full_at", F.col("cap") / F.col("w"))
    order = W.orderBy("full_at", F.col("source").asc_nulls_last())
    total = F.sum("source_size").over(W.partitionBy())
    spent = F.coalesce(F.sum("cap").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    sharing = F.sum("w").over(order.rowsBetween(0, W.unboundedFollowing))
    by = by.withColumn("level", (total - spent) / sharing)
    level = F.coalesce(F.max(F.when(F.col("level") <= F.col("full_at"), F.col("level"))).over(W.partitionBy()), F.lit(0.0))
    by = by.withColumn("target", F.least("cap", F.col("w") * level))
    rate = F.coalesce(F.try_divide("target", "source_size"), F.lit(0.0))
    return by.select("source", "source_size", "n", "target", rate.alias("rate"))


def _uniform(*parts: Column) -> Column:
    """A number in [0, 1) that depends on the parts alone."""
    return F.pmod(F.xxhash64(*parts), F.lit(1 << 52)) / F.lit(float(1 << 52))


def _fold(items: Column, seed: int) -> Column:
    """Folds an array of ITEM: struct<r: the item whose fraction is left, out: what has become integral>."""

    def item(x: Column, p: Column) -> Column:
        return F.struct(*[x[c].alias(c) for c in ("h", *KEY)], p.alias("p"))

    def done(x: Column, up: int) -> Column:
        return F.array(F.struct(*[x[c].alias(c) for c in KEY], F.lit(up).alias("up")))

    def step(acc: Column, x: Column) -> Column:
        a = acc["r"]
        a_up, a_down = (1 - a["p"]) * a["size"], a["p"] * a["size"]
        x_up, x_down = (1 - x["p"]) * x["size"], x["p"] * x["size"]
        to_a, to_x = F.least(a_up, x_down), F.least(a_down, x_up)
        gains = _uniform(F.lit(seed), a["h"], x["h"], a["p"]) * (to_a + to_x) < to_x

        def result(r: Column, out: Column) -> Column:
            return F.struct(r.alias("r"), F.concat(acc["out"], out).alias("out"))

        a_wins = F.when(a_up <= x_down, result(item(x, x["p"] - to_a / x["size"]), done(a, 1))).otherwise(result(item(a, a["p"] + to_a / a["size"]), done(x, 0)))
        x_wins = F.when(x_up <= a_down, result(item(a, a["p"] - to_x / a["size"]), done(x, 1))).otherwise(result(item(x, x["p"] + to_x / x["size"]), done(a, 0)))
        first = F.struct(x.alias("r"), acc["out"].alias("out"))
        return F.when(a.isNull(), first).when(gains, a_wins).otherwise(x_wins)

    start = F.struct(F.lit(None).cast(ITEM).alias("r"), F.array().cast(DONE).alias("out"))
    return F.aggregate(F.sort_array(items), start, step)


def copies(items: DataFrame, seed: int = 3) -> DataFrame:
    """Per distinct KEY of items (KEY, m rows): source_size, target, whole (copies of each row), extra (rows with one more).

    Equal rows count as one item of m rows: the whole part of m fractions is given at once, one fraction is left.
    """
    by_source = common.store(targets(items))
    levels, blocks = 1, (by_source.agg(F.max("n")).first()[0] or 1) // FAN + 1
    while blocks > 1:
        levels, blocks = levels + 1, -(-blocks // FAN)
    whole = F.floor("rate")
    share = (F.col("rate") - whole) * F.col("m")
    held = items.join(by_source, items["source"].eqNullSafe(by_source["source"])).drop(by_source["source"])
    # A rate that misses a whole number by rounding alone counts as that number.
    held = held.withColumn("rate", F.when(F.abs(F.col("rate") - F.round("rate")) < 1e-12, F.round("rate")).otherwise(F.col("rate")))
    held = held.withColumns({"whole": whole, "given": F.floor(share), "p": share - F.floor(share)})
    held = common.store(held.withColumn("p", F.when(F.col("size") > 0, F.col("p")).otherwise(F.lit(0.0))))
    key = F.xxhash64(F.lit(seed), "doc_id", "size", "text_hash")
    block = F.pmod(key, F.floor(F.col("n") / FAN) + 1)
    left = held.where("p > 0").select("source", block.alias("block"), F.struct(key.alias("h"), *KEY, "p").alias("item"))
    decided = []
    for _ in range(levels):
        folded = left.groupBy("source", "block").agg(_fold(F.collect_list("item"), seed).alias("f"))
        folded = common.store(folded.select("source", "block", "f.r", "f.out"))
        decided.append(folded.select(F.explode("out").alias("d")).select("d.*"))
        left = folded.where("r is not null").select("source", F.floor(F.col("block") / FAN).alias("block"), F.col("r").alias("item"))
    last = left.select(*[F.col(f"item.{c}").alias(c) for c in KEY], (_uniform(F.lit(seed), F.col("item.h")) < F.col("item.p")).cast("int").alias("up"))
    decided.append(last)
    ups = decided[0]
    for more in decided[1:]:
        ups = ups.unionByName(more)
    ups = ups.where("up = 1")
    match = [held[c].eqNullSafe(ups[c]) for c in KEY]
    joined = held.join(ups, match[0] & match[1] & match[2] & match[3], "left")
    extra = F.col("given") + F.coalesce(ups["up"], F.lit(0))
    return joined.select(*[held[c] for c in KEY], "m", "source_size", "target", "whole", extra.alias("extra"))


def mix(docs: DataFrame, seed: int = 3) -> DataFrame:
    """A row for each row of docs: doc_id, source, size, source_size, target, copies, taken (= size * copies).

    docs needs doc_id, source and text. Null sources are one source, null texts have size 0 and nothing to take;
    equal rows share their copies evenly. The choice depends on the rows' values alone: reruns agree.
    """
    rows = common.store(sizes(docs))
    found = common.store(copies(rows.groupBy(*KEY).agg(F.count(F.lit(1)).alias("m")), seed))
    # Many equal rows are dealt to tasks in runs of RUN, so no task writes out a large group alone.
    runs = found.withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("m") - 1) / RUN))))
    runs = runs.where(f"m <= {RUN}").unionByName(runs.where(f"m > {RUN}").repartition(F.xxhash64(*KEY, "run")))
    last = F.least("m", (F.col("run") + 1) * RUN) - 1
    each = runs.withColumn("k", F.explode(F.sequence((F.col("run") * RUN).cast("long"), last.cast("long"))))
    n = F.col("whole") + (F.col("k") < F.col("extra")).cast("long")
    return each.select("doc_id", "source", "size", "source_size", "target", n.alias("copies"), (n * F.col("size")).alias("taken"))


def take(docs: DataFrame, seed: int = 3) -> DataFrame:
    """The mix itself: each row of docs with all its columns, as many times as it is taken (perhaps never).

    A row without words is never taken: it has nothing to give to a target. Further columns may have any names.
    """
    rows, (text, source, doc_id) = common.by_place(docs, "text", "source", "doc_id")
    keyed = rows.select(*rows.columns, *[F.col(c).alias(k) for c, k in zip((source, doc_id, text), ("source", "doc_id", "text"), strict=True)])
    count = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    keyed = keyed.select(*rows.columns, F.col("source").cast("string").alias("source"), F.col("doc_id").cast("long").alias("doc_id"), count.alias("size"), F.xxhash64("text").alias("text_hash"))
    items = common.store(keyed.groupBy(*KEY).agg(F.count(F.lit(1)).alias("m")))
    # Stored: the join below stands alone, so that Spark can split a key that many rows share.
    found = common.store(copies(items, seed).where("size > 0 and (whole > 0 or extra > 0)").select(*[F.col(c).alias("_" + c) for c in KEY], "m", "whole", "extra"))
    match = [keyed[c].eqNullSafe(found["_" + c]) for c in KEY]
    single = keyed.join(found, match[0] & match[1] & match[2] & match[3]).drop(*["_" + c for c in KEY])
    # Equal rows get numbers, in runs as above; rows that are alone need none.
    alone = single.where("m = 1").withColumn("k", F.lit(0).cast("long"))
    many = single.where("m > 1").withColumn("rid", F.monotonically_increasing_id())
    if not found.where("m > 1").limit(1).count():
        every = alone
    else:
        many = common.store(many)
        places = common.gapless_rank(many.select(*KEY, "rid"), KEY, ["rid"], "k", max(1, -(-many.count() // RUN))).select("rid", "k")
        every = alone.unionByName(many.join(places, "rid").drop("rid"))
    n = (F.col("whole") + (F.col("k") < F.col("extra")).cast("long")).cast("int")
    repeated = every.withColumn("n", n).where("n > 0").withColumn("i", F.explode(F.sequence(F.lit(1), F.col("n"))))
    return repeated.select(*rows.columns).toDF(*docs.columns)


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all documents, with the weights and the limit of this module."""
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
