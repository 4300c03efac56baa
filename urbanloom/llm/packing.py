"""Best-fit packing under conflicts: documents go to the fullest bin that has room and no conflict.

A bin holds sequences of at most CAPACITY words. It carries two bitmaps: the sources that have reached their
number of documents in it, and the duplicate clusters that it has. Open bins are kept in the order of their
residuals; from the smallest residual that fits, the search goes on to the next larger one until a bin is
compatible. Documents longer than a bin fill whole bins of their own, and their rest is packed like a document.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

CAPACITY = 2048
#: Documents of one source in a bin, at most.
SOURCE_LIMIT = 3
#: Pieces that one task packs at once, about: bounds its memory, and the search for a compatible bin.
BLOCK_ROWS = 4096
#: Rows that one task numbers, about.
RANK_ROWS = 20_000
WORD = r"[^\x20\x09-\x0D]+"


def best_fit(sizes: np.ndarray, sources: np.ndarray, clusters: np.ndarray, capacity: int = CAPACITY, source_limit: int = SOURCE_LIMIT) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each piece, taken in the given order; sizes are 1 to capacity, sources and clusters 0, 1, ..."""
    order: list[tuple[int, int]] = []  # (residual, bin), ascending
    full: list[int] = []  # bitmaps by bin: sources at their limit
    seen: list[int] = []  # clusters
    counts: list[dict[int, int]] = []
    bins, offsets = np.zeros(len(sizes), "i8"), np.zeros(len(sizes), "i8")
    for i, (size, source, cluster) in enumerate(zip(sizes.tolist(), sources.tolist(), clusters.tolist(), strict=True)):
        s, c = 1 << source, 1 << cluster
        at = bisect_left(order, (size, -1))
        while at < len(order) and (full[order[at][1]] & s or seen[order[at][1]] & c):
            at += 1
        if at < len(order):
            residual, b = order.pop(at)
        else:
            residual, b = capacity, len(full)
            full.append(0)
            seen.append(0)
            counts.append({})
        bins[i], offsets[i] = b, capacity - residual
        seen[b] |= c
        counts[b][source] = counts[b].get(source, 0) + 1
        if counts[b][source] >= source_limit:
            full[b] |= s
        if residual > size:
            insort(order, (residual - size, b))
    return bins, offsets


def pack(docs: DataFrame, keep: list[str], capacity: int = CAPACITY, source_limit: int = SOURCE_LIMIT, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """A row for each piece of a row of docs: `keep`, size (words), piece (0, 1, ...), pieces, words (of the piece),
    bin, offset (words before it in the bin).

    docs needs doc_id, text and source. Size: runs without blanks in the text (null: 0); a row without words has
    one piece of 0 words, and no bin or offset. Cluster: texts that are equal when blanks are folded and A-Z
    lower-cased; one bin has no two documents of a cluster, and no more than source_limit of a source (null is
    one source); pieces that fill a whole bin conflict with nothing. Rows are dealt into blocks by a hash, each
    packed in descending order of words (ties: rank), so no task sees more than about block_rows pieces. Ranks
    follow from the rows' values: other files or partitions of the same rows give the same bins (rows that are
    equal in doc_id, text, source and `keep` may change places). `bin` is unique over all blocks, not gapless;
    it is below 0 for whole bins. keep may have any columns; a name of the result's stands twice then.
    """
    rows, (text, source, doc_id, *kept) = common.by_place(docs, "text", "source", "doc_id", *keep)
    body = F.coalesce(F.col(text), F.lit(""))
    folded = F.trim(F.regexp_replace(F.translate(body, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), r"[\x20\x09-\x0D]+", " "))
    words = F.regexp_count(body, F.lit(WORD)).cast("long")
    hashable = [c for c in kept if "map<" not in rows.schema[c].dataType.simpleString()]
    rows = rows.select(
        *[F.col(c).alias(f"k{i}") for i, c in enumerate(kept)],
        F.xxhash64(F.col(doc_id).cast("long"), text, source, *hashable).alias("_h"),
        F.col(doc_id).cast("long").alias("_id"),
        words.alias("size"),
        F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit("")).alias("_source"),
        F.xxhash64(folded).alias("_cluster"),
        F.monotonically_increasing_id().alias("_place"),
    )
    rows = common.store(rows)
    n = rows.count()
    rows = common.store(common.gapless_rank(rows, [], ["_h", "_id", "_place"], "_rid", max(1, -(-n // RANK_ROWS))).drop("_place"))
    count = F.greatest(F.ceil(F.col("size") / capacity), F.lit(1))
    each = rows.withColumn("pieces", count.cast("int")).withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
    each = each.withColumn("words", F.least(F.lit(capacity).cast("long"), F.col("size") - F.col("piece") * capacity))
    # Pieces that fill a bin, and rows without words, need no search.
    partial = each.where((F.col("words") > 0) & (F.col("words") < capacity))
    blocks = max(1, -(-n // block_rows))
    dealt = partial.withColumn("block", F.pmod(F.xxhash64("_h", "_rid", "_cluster"), F.lit(blocks)).cast("int"))
    names = ["_rid", "piece", "bin", "offset"]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["words", "_rid"], ascending=[False, True], kind="stable")
        found, offset = best_fit(pdf["words"].to_numpy(), pd.factorize(pdf["_source"])[0], pd.factorize(pdf["_cluster"])[0], capacity, source_limit)
        return pdf.assign(bin=(pdf["block"].to_numpy("i8") << 32) + found, offset=offset)[names]

    packed = dealt.select("block", "_rid", "words", "piece", "_source", "_cluster").groupBy("block").applyInPandas(run, "_rid long, piece int, bin long, offset long")
    # Whole bins, below 0, are numbered by rank: apart from the blocks' bins, and gapless.
    fills = each.where(F.col("words") == capacity).select("_rid", "piece")
    full = common.gapless_rank(fills, [], ["_rid", "piece"], "_n", max(1, -(-n // RANK_ROWS)))
    packed = packed.unionByName(full.select("_rid", "piece", (-F.col("_n") - 1).alias("bin"), F.lit(0).cast("long").alias("offset")))
    placed = each.join(packed, ["_rid", "piece"], "left").select(*[f"k{i}" for i in range(len(kept))], "size", "piece", "pieces", "words", "bin", "offset")
    return placed.toDF(*keep, "size", "piece", "pieces", "words", "bin", "offset")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' pieces with their bins."""
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), ["doc_id", "source"])
