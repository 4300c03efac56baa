"""What the training-data operators share: shared scratch tables, ranks without a global sort, text batches."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

#: Bytes of text that a Python worker handles at once, to bound its memory.
BATCH_BYTES = 4 << 20


#: Rows and bytes of an Arrow batch where texts go to Python: some thousand long texts at once would fill a worker.
BATCH_ROWS, BATCH_HELD = 1000, 16 << 20


def bound_batches(df: DataFrame) -> DataFrame:
    """df, in a session that sends at most BATCH_ROWS rows and about BATCH_HELD bytes at once to Python workers.

    Smaller limits of the session stay; larger ones are lowered for the session, as Spark has none for one query.
    """
    conf = df.sparkSession.conf
    for name, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_HELD)):
        held = re.match(r"\d+", conf.get(name, str(most + 1)))
        if held and not 0 < int(held[0]) <= most:
            conf.set(name, str(most))
    return df


def scratch_dir(spark: SparkSession) -> str:
    """A new folder's path under the cluster's shared checkpoint folder (spark.checkpoint.dir).

    Where that setting is absent, a local temporary folder serves in a single process (as in tests); on a
    cluster, whose executors would not share such a folder, it is an error.
    """
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not base:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if held.isEmpty():
            if not re.match(r"local(\[|$)", spark.sparkContext.master):
                raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
            spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="urbanloom-"))
            held = spark.sparkContext._jsc.sc().getCheckpointDir()
        base = held.get()
    return f"{base.rstrip('/')}/urbanloom-{uuid.uuid4().hex}"


def store(df: DataFrame, codec: str = "zstd", parts: int | None = None, wide: bool = False) -> DataFrame:
    """df written once to the shared folder and read from there: cuts lineage, survives lost executors.

    With `parts`, into so many files at most: a narrow table in hundreds of files costs more in opening and
    closing them than in rows. The number should follow from a count of rows. With `wide`, df is worked out in
    as many tasks as it has, and only its rows are dealt into the files; without, in `parts` tasks.
    """
    spark = df.sparkSession
    if parts is not None:
        df = df.repartition(parts) if wide else df.coalesce(parts)
    path = scratch_dir(spark)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def parts_for(rows: int, each: int = 25_000) -> int:
    """Files for a narrow table of about so many rows; at least four, to keep tasks side by side."""
    return max(4, -(-rows // each))


def drop_stored(df: DataFrame) -> None:
    """Deletes the files behind a DataFrame that store() returned, once nothing reads them any more."""
    spark = df.sparkSession
    for name in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def text_bytes(text: Column | str = "text") -> Column:
    """UTF-8 bytes of a text; null counts as empty."""
    col = F.col(text) if isinstance(text, str) else text
    return F.coalesce(col, F.lit("")).cast("binary")


def by_place(df: DataFrame, *needed: str) -> tuple[DataFrame, list[str]]:
    """df with its columns named c0, c1, ... by place, and the new names of `needed`.

    So no name of a caller's column, whatever it is, meets a name that an operator makes; toDF(*old names) undoes it.
    """
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))]), [f"c{df.columns.index(c)}" for c in needed]


def fields(df: DataFrame, keep: list[str]) -> StructType:
    """The columns `keep` of df, in that order, as a schema (all may be null)."""
    return StructType([StructField(c, df.schema[c].dataType) for c in keep])


def small_batches(batches: Iterator[pa.RecordBatch], column: str, limit: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices Arrow batches so that `column` (binary) holds about `limit` bytes in each."""
    for batch in batches:
        start, held = 0, 0
        for i, n in enumerate(pc.binary_length(batch.column(column)).to_pylist()):
            held += n or 0
            if held >= limit:
                yield batch.slice(start, i + 1 - start)
                start, held = i + 1, 0
        if start < batch.num_rows:
            yield batch.slice(start)


def gapless_rank(df: DataFrame, keys: list[str], order: list[str], out: str, salts: int) -> DataFrame:
    """Adds `out`: 0, 1, 2, ... within each combination of `keys`, without one task per key.

    Rows are dealt into `salts` sub-groups of each key by a hash of `order`; each sub-group is numbered by
    a window and shifted by the row counts of the sub-groups before it. The counts table has at most
    (number of keys) x `salts` rows. `order` must tell rows of a key apart for a reproducible rank.
    """
    from pyspark.sql import Window as W

    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*order), F.lit(salts)).cast("int"))
    counts = salted.groupBy(*keys, "_salt").agg(F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy(*keys).orderBy("_salt").rowsBetween(W.unboundedPreceding, -1)
    shifts = counts.withColumn("_shift", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inner = W.partitionBy(*keys, "_salt").orderBy(*order)
    ranked = salted.withColumn("_pos", F.row_number().over(inner) - 1)
    match = [ranked[k].eqNullSafe(shifts[k]) for k in [*keys, "_salt"]]
    cond = match[0]
    for m in match[1:]:
        cond = cond & m
    return ranked.join(shifts, cond).select(
        *[ranked[c] for c in df.columns], (F.col("_pos") + F.col("_shift")).cast("long").alias(out)
    )


def ordered_rank(df: DataFrame, keys: list[str], order: list[str], out: str) -> DataFrame:
    """Adds `out`: 0, 1, 2, ... within each combination of `keys`, in the order of `order`, without one task per key.

    Rows are dealt by ranges of keys and order and counted within each range; a table with a row for each key in each
    range shifts them. Columns that tell rows of a key apart must be in `order`, also so that ranges can split a key.
    """
    from pyspark.sql import Window as W

    at = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    ranged = df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
    ranged = store(ranged.select("*", F.spark_partition_id().alias("_part"), at.alias("_at")))
    starts = ranged.groupBy(*keys, "_part").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy(*keys).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    starts = starts.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_part").alias("_p"), (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift"))
    match = F.col("_part") == F.col("_p")
    for i, k in enumerate(keys):
        match &= F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return ranged.join(starts, match).select(*df.columns, (F.col("_at") + F.col("_shift")).cast("long").alias(out))
