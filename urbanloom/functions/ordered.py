"""Running sums in the order of a value, without one task for all rows.

Equal values are folded first, so a value that many rows share is one row. The folded rows are dealt into value
ranges by approximate percentiles (a row of at most RANGES bounds, which is broadcast); each range is summed by a
window of its own and shifted by the sums of the ranges below it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from urbanloom.functions.scratch import written

RANGES = 64


def value_curve(df: DataFrame, by: list[str], value: str, weight: str, order: str | None = None) -> DataFrame:
    """One row per `by` and distinct value x, with sums over what lies below it.

    Columns: by, x, w (weight of the value), n, w_first and w_last (weights of its first and last row by
    `order`; without an order the smallest and the largest), w_below, s_below (weight, and weight times the value
    clipped at 0, of smaller values), w_all, s_all (of all values).
    """
    x, w = F.col(value).cast("double"), F.col(weight).cast("double")
    first, last = (F.min_by(w, F.col(order)), F.max_by(w, F.col(order))) if order else (F.min(w), F.max(w))
    folded = df.groupBy(*by, x.alias("x")).agg(F.sum(w).alias("w"), F.count(F.lit(1)).alias("n"), first.alias("w_first"), last.alias("w_last"))
    folded = folded.withColumn("s", F.col("w") * F.greatest("x", F.lit(0.0)))
    steps = F.array(*[F.lit(i / RANGES) for i in range(1, RANGES)])
    bounds = df.agg(F.percentile_approx(x, steps, F.lit(1000)).alias("_bounds"))
    ranged = folded.crossJoin(F.broadcast(bounds)).withColumn("_range", F.size(F.filter("_bounds", lambda b: b < F.col("x")))).drop("_bounds")
    inner = W.partitionBy(*by, "_range").orderBy("x").rowsBetween(W.unboundedPreceding, -1)
    sums = ranged.groupBy(*by, "_range").agg(F.sum("w").alias("_rw"), F.sum("s").alias("_rs"))
    outer = W.partitionBy(*by).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy(*by)
    sums = sums.select(
        *by, "_range",
        F.coalesce(F.sum("_rw").over(outer), F.lit(0.0)).alias("_bw"), F.coalesce(F.sum("_rs").over(outer), F.lit(0.0)).alias("_bs"),
        F.sum("_rw").over(whole).alias("w_all"), F.sum("_rs").over(whole).alias("s_all"),
    )
    own = ranged.withColumns({"_w": F.coalesce(F.sum("w").over(inner), F.lit(0.0)), "_s": F.coalesce(F.sum("s").over(inner), F.lit(0.0))})
    return own.join(sums, [*by, "_range"]).select(
        *by, "x", "w", "n", "w_first", "w_last",
        (F.col("_w") + F.col("_bw")).alias("w_below"), (F.col("_s") + F.col("_bs")).alias("s_below"), "w_all", "s_all",
    )


def quantile(q: float) -> Column:
    """Aggregate over the rows of a value_curve: the value at cumulative weight q, from the centres of the rows' weights,
    linear between them and constant beyond the first and the last."""
    first = (F.col("w_below") + F.col("w_first") / 2) / F.col("w_all")
    last = (F.col("w_below") + F.col("w") - F.col("w_last") / 2) / F.col("w_all")
    inside = F.max(F.when((first <= q) & (last >= q), F.col("x")))
    low_at, high_at = F.max(F.when(last <= q, last)), F.min(F.when(first >= q, first))
    low, high = F.max(F.when(last <= q, F.col("x"))), F.min(F.when(first >= q, F.col("x")))
    between = low + (high - low) * F.try_divide(F.lit(q) - low_at, high_at - low_at)
    return F.coalesce(inside, between, low, high, F.lit(0.0))


def gini() -> Column:
    """Aggregate over the rows of a value_curve: weighted Gini coefficient, values below 0 count as 0."""
    x = F.greatest("x", F.lit(0.0))
    top = F.sum(F.col("w") * (x * F.col("w_below") - F.col("s_below")))
    return F.coalesce(F.try_divide(top, F.max("w_all") * F.max("s_all")), F.lit(0.0))


def numbered(df: DataFrame, order: list[str], out: str) -> DataFrame:
    """df with `out`: 0, 1, 2, ... in the order of columns that tell its rows apart, without one task for all rows.

    Rows are dealt by ranges of the order and counted within each range; a table with a row for each range shifts them.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    ranged = written(ranged.select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("_at")))
    counts = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    below = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    counts = counts.select("_part", F.coalesce(F.sum("_n").over(below), F.lit(0)).alias("_below"))
    return ranged.join(F.broadcast(counts), "_part").withColumn(out, F.col("_at") + F.col("_below")).drop("_part", "_at", "_below")


def running(df: DataFrame, order: list[str], sums: list[str], count: str) -> DataFrame:
    """df with <c>_upto for each column of `sums` (its sum over the rows up to this one, in the order) and `count` (their
    number), without one task for all rows.

    Rows are dealt by ranges of the order and summed within each range; a table with a row for each range shifts them.
    Rows that the order does not tell apart come in any order, all in one range.
    """
    ranged = written(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    upto = W.partitionBy("_part").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    own = ranged.withColumns({**{f"_s{i}": F.sum(c).over(upto) for i, c in enumerate(sums)}, "_n": F.count(F.lit(1)).over(upto)})
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    totals = ranged.groupBy("_part").agg(*[F.sum(c).alias(f"_t{i}") for i, c in enumerate(sums)], F.count(F.lit(1)).alias("_m"))
    totals = totals.select("_part", *[F.coalesce(F.sum(f"_t{i}").over(before), F.lit(0.0)).alias(f"_b{i}") for i in range(len(sums))], F.coalesce(F.sum("_m").over(before), F.lit(0)).alias("_bn"))
    out = own.join(F.broadcast(totals), "_part")
    return out.select(*df.columns, *[(F.col(f"_s{i}") + F.col(f"_b{i}")).alias(f"{c}_upto") for i, c in enumerate(sums)], (F.col("_n") + F.col("_bn")).alias(count))
