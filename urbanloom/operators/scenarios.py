"""Scenario comparison: metric tables (scenario, metric, value) compared, ranked and stored as snapshots."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from urbanloom.sources.files import write_text

#: Known metrics, their labels, and whether more is better (1), worse (-1) or neither (0).
METRICS = {
    "plan_performance_index": ("Plan Performance Index", 1),
    "access_mean": ("Accessibility score (mean)", 1),
    "access_median": ("Accessibility score (median)", 1),
    "access_share_full": ("Share reaching every category (%)", 1),
    "access_share_low": ("Share scoring below 50 (%)", -1),
    "origins": ("Scored origins", 0),
    "standards_compliance_pct": ("Standards compliance (%)", 1),
    "standards_deficits": ("Categories in deficit", -1),
    "standards_categories": ("Categories with a standard", 0),
    "covered_share": ("Population covered (%)", 1),
    "covered_pop": ("Covered population", 1),
    "total_pop": ("Total population", 0),
    "facilities": ("Facilities", 0),
    "facilities_overloaded": ("Overloaded facilities", -1),
    "facilities_unused": ("Unused facilities", -1),
    "mean_utilization": ("Mean facility utilization", 0),
    "walk_score_mean": ("Walkability score (mean)", 1),
    "walk_low_share": ("Streets below 50 walk score (pct)", -1),
    "green_coverage_worst": ("Green coverage, weakest class (pct)", 1),
    "access_gini": ("Access inequality (Gini)", -1),
    "density_mean": ("Density mean (/ha)", 0),
    "density_max": ("Density max (/ha)", 0),
    "density_cells": ("Occupied density cells", 0),
}


def registry(spark: SparkSession) -> DataFrame:
    """metric, label, direction, place of the known metrics."""
    return spark.createDataFrame([(k, v[0], v[1], i) for i, (k, v) in enumerate(METRICS.items())], "metric string, label string, direction int, place int")


def named(df: DataFrame) -> DataFrame:
    """Rows of metrics with label, direction and place; labels of unknown metrics follow from their names."""
    known = F.broadcast(registry(df.sparkSession))
    title = F.initcap(F.replace("metric", F.lit("_"), F.lit(" ")))
    return df.join(known, "metric", "left").withColumns({"label": F.coalesce("label", title), "direction": F.coalesce("direction", F.lit(0)), "place": F.coalesce("place", F.lit(len(METRICS)))})


def compare(metrics: DataFrame, a: str, b: str) -> DataFrame:
    """metric, label, a, b, delta, delta_pct, direction, better ('A', 'B', 'tie', 'n/a') of two scenarios' metrics."""
    side = lambda name, c: metrics.where(F.col("scenario") == name).groupBy("metric").agg(F.first("value").alias(c))
    rows = named(side(a, "a").join(side(b, "b"), "metric", "full"))
    delta = F.col("b") - F.col("a")
    better = F.when(delta.isNull() | (F.col("direction") == 0), "n/a").when(delta == 0, "tie").when(delta * F.col("direction") > 0, "B").otherwise("A")
    return rows.select("metric", "label", "a", "b", delta.alias("delta"), F.try_divide(100 * delta, F.abs("a")).alias("delta_pct"), "direction", better.alias("better"))


def _scored(metrics: DataFrame, weights: dict[str, float] | None) -> DataFrame:
    """Rows of metrics with their oriented share of the range (norm), and why a metric is skipped (else null)."""
    names = metrics.agg(F.countDistinct("scenario").alias("_all"))
    per = W.partitionBy("metric")
    rows = named(metrics).crossJoin(F.broadcast(names)).withColumns({"_n": F.count(F.lit(1)).over(per), "_lo": F.min("value").over(per), "_hi": F.max("value").over(per)})
    skipped = F.when(F.col("direction") == 0, "neutral").when(F.col("_n") < F.col("_all"), "not-shared").when(F.col("_lo") == F.col("_hi"), "constant")
    span = F.nullif(F.col("_hi") - F.col("_lo"), F.lit(0.0))
    norm = F.when(F.col("direction") == 1, (F.col("value") - F.col("_lo")) / span).otherwise((F.col("_hi") - F.col("value")) / span)
    weight = F.lit(1.0)
    for k, v in (weights or {}).items():
        weight = F.when(F.col("metric") == k, F.lit(float(v))).otherwise(weight)
    return rows.withColumns({"skipped": skipped, "norm": F.when(skipped.isNull(), norm), "weight": weight})


def rank(metrics: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """rank, scenario, score (0 to 100), wins, n_metrics: weighted mean of the metrics' shares of their ranges.

    Metrics that are neutral, missing somewhere or constant are skipped. A win is a metric on which one scenario
    alone is at the best end. Equal scores share a rank.
    """
    rows = _scored(metrics, weights)
    best = W.partitionBy("metric")
    used = rows.where("skipped is null").withColumn("_best", F.sum((F.col("norm") == 1).cast("int")).over(best))
    sums = used.groupBy("scenario").agg((100 * F.try_divide(F.sum(F.col("weight") * F.col("norm")), F.sum("weight"))).alias("score"), F.sum(((F.col("norm") == 1) & (F.col("_best") == 1)).cast("int")).cast("int").alias("wins"), F.count(F.lit(1)).cast("int").alias("n_metrics"))
    every = metrics.select("scenario").distinct().join(sums, "scenario", "left").select("scenario", F.coalesce("score", F.lit(0.0)).alias("score"), F.coalesce("wins", F.lit(0)).alias("wins"), F.coalesce("n_metrics", F.lit(0)).alias("n_metrics"))
    return every.select(F.rank().over(W.orderBy(F.col("score").desc())).alias("rank"), "scenario", "score", "wins", "n_metrics")


def rank_detail(metrics: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """metric, label, direction, weight, scenario, value, norm of the metrics that count."""
    return _scored(metrics, weights).where("skipped is null").select("metric", "label", "direction", "weight", "scenario", "value", "norm")


def skipped_metrics(metrics: DataFrame) -> DataFrame:
    """metric, reason of those that do not count."""
    return _scored(metrics, None).where("skipped is not null").groupBy("metric").agg(F.first("skipped").alias("reason"))


#: Metrics of a snapshot, at most.
SNAPSHOT_METRICS = 100_000


def write_snapshot(metrics: DataFrame, name: str, path: str, generated: str) -> None:
    """One scenario's metrics as a JSON file (kind, version, name, generated, metrics); rows without a number are left out.

    A snapshot is one small file: more than SNAPSHOT_METRICS metrics are an error.
    """
    rows = metrics.where("value is not null and not isnan(value)").select("metric", F.col("value").cast("double")).limit(SNAPSHOT_METRICS + 1).collect()
    if len(rows) > SNAPSHOT_METRICS:
        raise ValueError(f"more than {SNAPSHOT_METRICS} metrics")
    held = {r.metric: r.value for r in rows}
    snapshot = {"kind": "scenario-snapshot", "version": 1, "name": name or "Scenario", "generated": generated, "metrics": held}
    write_text(metrics.sparkSession, path, json.dumps(snapshot, indent=2, sort_keys=True))


def read_snapshots(spark: SparkSession, path: str) -> DataFrame:
    """scenario, metric, value of the JSON snapshots of a file, folder or pattern; names of a repeated path count once."""
    kind = "name string, generated string, metrics map<string, string>"
    rows = spark.read.schema(kind).option("multiLine", True).json(path).where("metrics is not null")
    return rows.select(F.coalesce("name", F.lit("Scenario")).alias("scenario"), F.explode("metrics").alias("metric", "value")).withColumn("value", F.col("value").try_cast("double")).where("value is not null and not isnan(value)")
