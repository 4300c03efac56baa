"""Importance resampling towards a target: hashed word n-grams counted by DuckDB in each task, weighed and drawn by Spark.

A task hands its texts to a DuckDB of its own (one thread, bounded memory), whose SQL unnests the words, forms pairs
over a window and buckets every distinct feature by a registered zlib CRC. The bucket counts of each document, and
their sums over each batch, are spilled to Parquet in the shared folder; texts are read once. Spark merges the sums
of documents and target into the gain of each bucket (a fixed number of them), weighs the spilled counts with it and
ranks perturbed weights (the Gumbel trick: the highest are a sample without replacement) by ranges of the score.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import duckdb
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType

from urbanloom.functions.ordered import numbered

from . import common

#: Buckets of the features' hashes; the table of gains has so many rows, whatever the input.
BUCKETS = 10_000
#: A document needs so many words to be drawn; so many per cent of those that have them are drawn.
LEAST_WORDS, PERCENT = 20, 25
SEED = 7
#: Bytes of text in one DuckDB call, and of one piece of a longer text; memory of a task's DuckDB.
CALL, PIECE, DUCK_MEMORY = 4 << 20, 1 << 20, "512MB"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

_FOLD = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_IS_WORD = np.array([b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 for b in range(256)])

COUNTS = f"""
WITH t AS (SELECT r, p, lead, regexp_extract_all(body, '{WORD}') AS ws FROM pieces),
u AS (SELECT r, p, lead, unnest(ws) AS w, generate_subscripts(ws, 1) AS pos FROM t),
g AS MATERIALIZED (SELECT r, lead, pos, w, lead(w) OVER (PARTITION BY p ORDER BY pos) AS w2 FROM u),
f AS (SELECT r, w AS feature FROM g WHERE pos > lead UNION ALL SELECT r, w || ' ' || w2 FROM g WHERE w2 IS NOT NULL),
h AS MATERIALIZED (SELECT r, feature, count(*) AS n FROM f GROUP BY r, feature),
c AS (SELECT feature, zlib_crc(feature) % {{buckets}} AS bucket FROM (SELECT DISTINCT feature FROM h))
SELECT r, CAST(bucket AS INTEGER) AS bucket, CAST(sum(n) AS BIGINT) AS n FROM h JOIN c USING (feature) GROUP BY r, bucket ORDER BY r, bucket
"""
WORDS = f"SELECT r, CAST(sum(len(regexp_extract_all(body, '{WORD}')) - lead) AS BIGINT) AS n FROM pieces GROUP BY r ORDER BY r"


def zlib_crc(values: pa.Array) -> pa.Array:
    """zlib's unsigned CRC-32 of the UTF-8 bytes of each string."""
    if isinstance(values, pa.ChunkedArray):
        values = values.combine_chunks()
    values = values.cast(pa.large_binary())
    ends = np.frombuffer(values.buffers()[1], "i8")[values.offset : values.offset + len(values) + 1].tolist()
    held = memoryview(values.buffers()[2] or b"")
    return pa.array([zlib.crc32(held[a:b]) for a, b in zip(ends, ends[1:], strict=False)], pa.int64())


def _duck() -> duckdb.DuckDBPyConnection:
    con = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": DUCK_MEMORY, "temp_directory": ""})
    con.create_function("zlib_crc", zlib_crc, ["VARCHAR"], "BIGINT", type="arrow")
    return con


def pieces(body: bytes, size: int = PIECE) -> Iterator[tuple[int, bytes]]:
    """(1 if the piece starts with a word that was counted before, else 0; the piece) for a folded text.

    A piece ends behind a whole word; the next starts with that word, so that the pair over the border is formed.
    """
    word, start = b"", 0
    while True:
        end = start + size
        if end < len(body):
            inside = _IS_WORD[np.frombuffer(body, "u1", offset=end)]
            end += int(np.argmin(inside)) if not inside.all() else inside.size
        piece = body[start:end]
        yield (1, word + b" " + piece) if word else (0, piece)
        if end >= len(body):
            return
        kind = _IS_WORD[np.frombuffer(piece, "u1")]
        at = np.flatnonzero(kind)
        if at.size:
            gaps = np.flatnonzero(~kind[: at[-1]])
            word = piece[int(gaps[-1]) + 1 if gaps.size else 0 : int(at[-1]) + 1]
        start = end


def bucket_counts(docs: DataFrame, keep: list[str], buckets: int = BUCKETS, text: str = "text") -> DataFrame:
    """Spilled counts: for each row of docs its columns `keep`, n_words, bucket and count (arrays, by bucket), n_row (a
    number of its own) and total = false; beside them, for each call of DuckDB a row with total = true and the sums of its rows.

    Words are runs of letters, digits and characters beyond ASCII, A-Z in lower case; features are words and pairs of
    words in a row, joined by a blank. A null or empty text has none.
    """
    rows, (text, *kept) = common.by_place(docs, text, *keep)
    counts_sql = COUNTS.format(buckets=buckets)
    schema = common.fields(rows, kept).add("n_words", "long").add("bucket", ArrayType(IntegerType())).add("count", ArrayType(LongType())).add("total", "boolean")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        con = _duck()
        for batch in common.small_batches(batches, "body", CALL):
            n = batch.num_rows
            cut = [(r, lead, piece) for r, body in enumerate(batch.column("body").to_pylist()) for lead, piece in pieces(body.translate(_FOLD))]
            table = pa.table({"r": pa.array([x[0] for x in cut], pa.int32()), "p": pa.array(range(len(cut)), pa.int32()), "lead": pa.array([x[1] for x in cut], pa.int32()), "body": pa.array([x[2] for x in cut], pa.binary()).cast(pa.string())})
            con.register("pieces", table)
            found = con.sql(counts_sql).to_arrow_table()
            words = con.sql(WORDS).to_arrow_table()["n"].combine_chunks()
            con.unregister("pieces")
            bucket, count = found["bucket"].to_numpy(), found["n"].to_numpy()
            ends = np.searchsorted(found["r"].to_numpy(), np.arange(n + 1)).astype("i4")
            lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x)) for x in (bucket.astype("i4"), count.astype("i8"))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), words, *lists, pa.array(np.zeros(n, bool))], names=schema.names)
            sums = np.bincount(bucket, count, buckets).astype("i8")
            held = np.flatnonzero(sums)
            whole = [pa.array([held.tolist()], pa.list_(pa.int32())), pa.array([sums[held].tolist()], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*(pa.nulls(1, batch.schema.field(c).type) for c in kept), pa.array([None], pa.int64()), *whole, pa.array([True])], names=schema.names)
        con.close()

    texts = common.bound_batches(rows.select(*kept, common.text_bytes(text).alias("body")))
    spilled = texts.mapInArrow(run, schema).withColumn("n_row", F.monotonically_increasing_id())
    return common.store(spilled).toDF(*keep, "n_words", "bucket", "count", "total", "n_row")


def gains(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """For each bucket floor(1000 * ln of its smoothed share in target over that in docs), from their spilled counts."""

    def merged(spilled: DataFrame, name: str) -> DataFrame:
        each = spilled.where("total").select(F.explode(F.arrays_zip("bucket", "count")).alias("x"))
        return each.groupBy(F.col("x.bucket").alias("bucket")).agg(F.sum("x.count").alias(name))

    both = docs.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    both = both.join(merged(docs, "s"), "bucket", "left").join(merged(target, "t"), "bucket", "left").fillna(0)
    both = common.store(both, parts=1)
    whole = both.agg(F.sum("s").alias("all_s"), F.sum("t").alias("all_t"))
    up, down = (F.col("t") + 1.0) * (F.col("all_s") + float(buckets)), (F.col("s") + 1.0) * (F.col("all_t") + float(buckets))
    rows = both.crossJoin(F.broadcast(whole)).select("bucket", F.floor(1000 * F.log(up / down)).alias("gain")).collect()
    out = np.zeros(buckets, "i8")
    for r in rows:
        out[r.bucket] = r.gain
    return out


def weighed(spilled: DataFrame, gain: np.ndarray, keep: list[str]) -> DataFrame:
    """The columns keep, n_row, n_words, n_features and weight: the floored mean of a row's gains (no features: 0)."""
    rows = spilled.where("not total").select(*keep, "n_row", "n_words", "bucket", "count").toDF(*[f"c{i}" for i in range(len(keep))], "n_row", "n_words", "bucket", "count")
    kept = rows.columns[: len(keep) + 2]
    schema = common.fields(rows, kept).add("n_features", "long").add("weight", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bucket, count = batch.column("bucket"), batch.column("count")
            ends = np.append(0, np.cumsum(bucket.value_lengths().to_numpy(zero_copy_only=False)))
            counts = count.flatten().to_numpy()
            sums = np.append(0, np.cumsum(counts * gain[bucket.flatten().to_numpy()]))
            n = np.diff(np.append(0, np.cumsum(counts))[ends])
            weight = np.diff(sums[ends]) // np.maximum(n, 1)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(n), pa.array(weight)], names=schema.names)

    return common.bound_batches(rows).mapInArrow(run, schema).toDF(*keep, "n_row", "n_words", "n_features", "weight")


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, n_words, n_features, weight, score, rank for every row of docs; rank is null for rows that are not drawn.

    docs has doc_id and text, target has text; other columns are not read, whatever their names. score is the weight
    plus Gumbel noise that follows from seed and doc_id alone, so reruns draw the same. Of the N rows with least_words
    words or more, floor(percent * N / 100) with the highest scores are drawn; ties go to the smaller doc_id (null
    last, with the noise of an empty id), then to any of the equal rows. Null and empty texts have weight 0 and no rank;
    an empty target leaves every bucket its smoothed share; empty docs give no rows.
    """
    spilled = bucket_counts(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), ["doc_id"], buckets)
    aimed = bucket_counts(target.select("text"), [], buckets)
    rows = weighed(spilled, gains(spilled, aimed, buckets), ["doc_id"])
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    rows = common.store(rows.withColumn("score", F.col("weight") + noise))
    fit = rows.where(F.col("n_words") >= least_words)
    draw = percent * fit.count() // 100
    fit = fit.select((-F.col("score")).alias("falling"), F.col("doc_id").isNull().alias("none"), "doc_id", "n_row", "n_words", "n_features", "weight", "score")
    ranked = numbered(fit, ["falling", "none", "doc_id", "n_row"], "at").withColumn("rank", F.when(F.col("at") < draw, F.col("at") + 1))
    columns = ["doc_id", "n_words", "n_features", "weight", "score", "rank"]
    rest = rows.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long"))
    return ranked.select(*columns).unionByName(rest.select(*columns))


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's weight towards the benchmark texts, its score and its rank in the draw."""
    docs, target = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return resample(docs, target).select("doc_id", "n_features", "weight", "score", "rank")
