"""Distributional equity: unit ranks, inequality measures by group, curves and cross-tabulation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from urbanloom.functions.ordered import gini, quantile, running, value_curve
from urbanloom.functions.scratch import written


def _units(df: DataFrame, value: str, pop: str | None, group: str | None) -> DataFrame:
    """Rows with a number for a value: _x, _w (missing, non-finite and negative weights: 0; all 0: 1 each), _g."""
    number = lambda c: F.col(c).try_cast("double")
    x = number(value)
    kept = df.withColumn("_x", x).where(F.col("_x").isNotNull() & ~F.isnan("_x") & (F.abs("_x") < float("inf")))
    w = number(pop) if pop else F.lit(1.0)
    kept = kept.withColumn("_w", F.when((w > 0) & (w < float("inf")), w).otherwise(0.0))
    if pop:
        some = kept.agg((F.sum("_w") > 0).alias("_some"))
        kept = kept.crossJoin(F.broadcast(some)).withColumn("_w", F.when(F.col("_some"), F.col("_w")).otherwise(1.0)).drop("_some")
    return kept.withColumn("_g", F.col(group).cast("string") if group else F.lit(None).cast("string"))


def percentile_rank(units: DataFrame) -> DataFrame:
    """units with `_rank`: weight below and half the weight of equal values, over all weight."""
    curve = value_curve(units, [], "_x", "_w")
    rank = F.coalesce(F.try_divide(F.col("w_below") + F.col("w") / 2, F.col("w_all")), F.lit(0.0))
    return units.join(curve.select(F.col("x").alias("_x"), rank.alias("_rank")), "_x")


def _worse(value: Column, poverty: float, higher_is_better: bool) -> Column:
    return value < poverty if higher_is_better else value > poverty


def access_equity_units(df: DataFrame, value: str, pop: str | None = None, group: str | None = None, higher_is_better: bool = True, poverty: float | None = None) -> DataFrame:
    """Rows of df and eq_value, pct_rank (0 to 100), dev_mean (from the weighted mean), poverty (1, 0; -1 without a line)."""
    units = _units(df, value, pop, group)
    mean = units.agg(F.coalesce(F.try_divide(F.sum(F.col("_w") * F.col("_x")), F.sum("_w")), F.lit(0.0)).alias("_mean"))
    ranked = percentile_rank(units).crossJoin(F.broadcast(mean))
    flag = F.lit(-1) if poverty is None else _worse(F.col("_x"), poverty, higher_is_better).cast("int")
    return ranked.select(*df.columns, F.col("_x").alias("eq_value"), (100 * F.col("_rank")).alias("pct_rank"), (F.col("_x") - F.col("_mean")).alias("dev_mean"), flag.alias("poverty"))


def access_equity(df: DataFrame, value: str, pop: str | None = None, group: str | None = None, higher_is_better: bool = True, poverty: float | None = None) -> DataFrame:
    """Scope `ALL` and every group: population, mean, median, gini, theil and its parts, cv, p90_p10, pov_share.

    Every row counts in its group and in ALL, so one aggregation over scopes gives all summaries.
    """
    units = _units(df, value, pop, group)
    scopes = F.array(F.lit("ALL"), F.coalesce("_g", F.lit(""))) if group else F.array(F.lit("ALL"))
    each = units.select(F.explode(scopes).alias("scope"), "_x", "_w", "_g")
    curve = value_curve(each, ["scope"], "_x", "_w")
    poor = F.sum(F.when(_worse(F.col("x"), poverty, higher_is_better), F.col("w")).otherwise(0.0)) if poverty is not None else F.lit(0.0)
    total = F.sum("w")
    ratio = F.greatest("x", F.lit(0.0)) / F.nullif(F.col("s_all") / F.col("w_all"), F.lit(0.0))
    stats = curve.groupBy("scope").agg(
        total.alias("population"),
        F.coalesce(F.try_divide(F.sum(F.col("w") * F.col("x")), total), F.lit(0.0)).alias("mean"),
        quantile(0.5).alias("median"),
        gini().alias("gini"),
        F.coalesce(F.try_divide(F.sum(F.when(ratio > 0, F.col("w") * ratio * F.ln(ratio))), total), F.lit(0.0)).alias("theil"),
        F.sum(F.col("w") * F.col("x") * F.col("x")).alias("_xx"),
        quantile(0.9).alias("_p90"),
        quantile(0.1).alias("_p10"),
        F.coalesce(F.try_divide(poor, total), F.lit(0.0)).alias("pov_share"),
        F.max("s_all").alias("_s"),
    )
    spread = F.sqrt(F.greatest(F.try_divide(F.col("_xx"), F.col("population")) - F.col("mean") ** 2, F.lit(0.0)))
    stats = stats.withColumns({"cv": F.coalesce(F.try_divide(spread, F.abs("mean")), F.lit(0.0)), "p90_p10": F.when(F.col("_p10") > 0, F.col("_p90") / F.col("_p10")).otherwise(0.0)})
    # Between and within parts come from the groups' rows; they are ALL's. The summary has a row for each group.
    own, every = F.col("scope") == "ALL", W.partitionBy()
    all_s, all_w = (F.max(F.when(own, F.col(c))).over(every) for c in ("_s", "population"))
    stats = stats.withColumns({"_all_s": all_s, "_all_w": all_w})
    counts = ~own & (F.col("population") > 0) & (F.col("_all_s") > 0) & (F.col("_all_w") > 0)
    share = F.col("_s") / F.nullif("_all_s", F.lit(0.0))
    level = F.try_divide(F.try_divide("_s", "population"), F.try_divide("_all_s", "_all_w"))
    between = F.sum(F.when(counts & (level > 0), share * F.ln(level))).over(every)
    within = F.sum(F.when(counts, share * F.col("theil"))).over(every)
    part = lambda c: F.when(own, F.coalesce(c, F.lit(0.0))).otherwise(0.0)
    return stats.select("scope", "population", "mean", "median", "gini", "theil", part(between).alias("theil_btw"), part(within).alias("theil_wth"), "cv", "p90_p10", "pov_share")


def inequality_curve(df: DataFrame, value: str, pop: str | None = None, rank: str | None = None, order: str | None = None) -> DataFrame:
    """Lorenz curve (by value) or concentration curve (by rank, ties by `order`): point 0.., pop_share, value_share,
    equality, gap. A point for each unit and the origin; units are numbered and summed by ranges of the order."""
    units = _units(df, value, pop, None).withColumn("_v", F.greatest("_x", F.lit(0.0)))
    keys = {"_k0": F.col(rank).try_cast("double") if rank else F.col("_v"), "_k1": F.col(order) if order else F.col("_w"), "_k2": F.lit(0.0) if order else F.col("_v")}
    held = units.select(*[c.alias(k) for k, c in keys.items()], F.col("_w").alias("w"), (F.col("_w") * F.col("_v")).alias("m"))
    summed = written(running(held, list(keys), ["w", "m"], "n"))
    whole = summed.agg(F.sum("w").alias("_all_w"), F.sum("m").alias("_all_m"))
    share = lambda c: F.coalesce(F.try_divide(F.col(f"{c}_upto"), F.col(f"_all_{c}")), F.lit(0.0))
    points = summed.crossJoin(F.broadcast(whole)).select(F.col("n").cast("int").alias("point"), share("w").alias("pop_share"), share("m").alias("value_share"))
    origin = df.sparkSession.range(1).select(F.lit(0).alias("point"), F.lit(0.0).alias("pop_share"), F.lit(0.0).alias("value_share"))
    return origin.unionByName(points).select("*", F.col("pop_share").alias("equality"), (F.col("pop_share") - F.col("value_share")).alias("gap"))


def inequality_measures(df: DataFrame, value: str, pop: str | None = None, rank: str | None = None, epsilon: float = 1.0, order: str | None = None) -> DataFrame:
    """metric, value: gini, atkinson at 0.5, 1, 2 (and epsilon), and the concentration index where a rank is given."""
    units = _units(df, value, pop, None)
    v, w = F.greatest("_x", F.lit(0.0)), F.col("_w")
    total, mean = F.sum(w), F.try_divide(F.sum(w * v), F.sum(w))
    zero = F.max(((v <= 0) & (w > 0)).cast("int")) == 1
    levels = list(dict.fromkeys([0.5, 1.0, 2.0, float(epsilon)]))
    found = []
    for e in levels:
        if abs(e - 1) < 1e-12:
            level = F.exp(F.try_divide(F.sum(F.when(v > 0, w * F.ln(v))), total))
        else:
            level = F.pow(F.try_divide(F.sum(F.when((v > 0) | F.lit(e < 1), w * F.pow(v, F.lit(1 - e)))), total), F.lit(1 / (1 - e)))
        value_ = F.when(F.coalesce(mean, F.lit(0.0)) <= 0, 0.0)
        if e >= 1:
            value_ = value_.when(zero, 1.0)
        found.append(value_.otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), 1 - level / mean))).alias(f"atkinson_{e:g}"))
    wide = units.agg(*found)
    wide = wide.crossJoin(F.broadcast(value_curve(units, [], "_x", "_w").agg(gini().alias("gini"))))
    names = ["gini", *[f"atkinson_{e:g}" for e in levels]]
    if rank:
        curve = inequality_curve(df, value, pop, rank, order)
        back = W.orderBy("point")
        area = (F.col("pop_share") - F.lag("pop_share").over(back)) * (F.col("value_share") + F.lag("value_share").over(back))
        wide = wide.crossJoin(F.broadcast(curve.select(area.alias("_a")).agg((1 - F.sum("_a")).alias("concentration"))))
        names.append("concentration")
    pairs = ", ".join(f"'{n}', `{n}`" for n in names)
    return wide.selectExpr(f"stack({len(names)}, {pairs}) as (metric, value)")


def class_edges(df: DataFrame, value: str, pop: str | None, classes: int, breaks: list[float] | None) -> DataFrame:
    """One row: `edges`, the inner bounds of the value classes (given breaks, or weighted quantiles)."""
    if breaks is not None:
        return df.sparkSession.range(1).select(F.array(*[F.lit(float(b)) for b in sorted(breaks)]).alias("edges"))
    if classes < 2:
        raise ValueError("at least two classes are needed")
    curve = value_curve(_units(df, value, pop, None), [], "_x", "_w")
    return curve.agg(F.array(*[quantile(k / classes) for k in range(1, classes)]).alias("edges"))


def equity_crosstab(df: DataFrame, value: str, group: str, pop: str | None = None, classes: int = 5, breaks: list[float] | None = None, group_b: str | None = None) -> DataFrame:
    """Group x class cells: grp, class (0..), pop, class_share, rep_ratio, and the group's dissimilarity.

    A unit is in the class of the first edge that is not below it. With a second group the label is `A | B`.
    Every group has a row for each class, empty ones too.
    """
    units = _units(df, value, pop, group)
    if group_b:
        units = units.withColumn("_g", F.concat_ws(" | ", "_g", F.col(group_b).cast("string")))
    edges = class_edges(df, value, pop, classes, breaks)
    units = units.crossJoin(F.broadcast(edges)).withColumn("class", F.size(F.filter("edges", lambda e: e < F.col("_x"))))
    cells = units.groupBy(F.col("_g").alias("grp"), "class").agg(F.sum("_w").alias("pop"))
    n = len(breaks) + 1 if breaks is not None else classes
    every = cells.select("grp").distinct().withColumn("class", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    cells = every.join(cells, ["grp", "class"], "left").withColumn("pop", F.coalesce("pop", F.lit(0.0)))
    by_class, by_group, whole = W.partitionBy("class"), W.partitionBy("grp"), W.partitionBy()
    cells = cells.withColumns({"_c": F.sum("pop").over(by_class), "_g": F.sum("pop").over(by_group), "_t": F.sum("pop").over(whole)})
    class_share = F.try_divide(F.col("pop"), F.col("_c"))
    own, rest = F.try_divide(F.col("pop"), F.col("_g")), F.try_divide(F.col("_c") - F.col("pop"), F.col("_t") - F.col("_g"))
    cells = cells.withColumn("_d", F.abs(own - rest))
    return cells.select("grp", "class", "pop", F.coalesce(class_share, F.lit(0.0)).alias("class_share"), F.try_divide(class_share, F.try_divide(F.col("_g"), F.col("_t"))).alias("rep_ratio"), F.coalesce(0.5 * F.sum("_d").over(by_group), F.lit(0.0)).alias("dissimilarity"))
