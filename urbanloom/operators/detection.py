"""Result tables known by their columns: which operator made a table, and a scenario's metrics from a folder of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from urbanloom.operators import audit, scenarios

#: The columns (in small letters) by which the result tables of each kind are known.
SIGNATURES = {
    "access": ("score", "n_reach"),
    "balance": ("balance_m2", "m2_capita"),
    "facilities": ("utilization", "assigned"),
    "demand": ("covered", "net_cost"),
    "density": ("dens_ha", "value"),
}


def detect(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """kind -> the first table, by name, that has all columns of the kind's signature in any case; one table may serve
    several kinds, and kinds without a table are absent."""
    found: dict[str, DataFrame] = {}
    for name in sorted(tables):
        columns = {c.lower() for c in tables[name].columns}
        for kind, signature in SIGNATURES.items():
            if columns.issuperset(signature):
                found.setdefault(kind, tables[name])
    return found


def tables_of(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """name -> table for each Parquet file or folder (name.parquet) right in a folder of any file system."""
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    names = [s.getPath().getName() for s in at.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(at)]
    return {n.removesuffix(".parquet"): spark.read.parquet(f"{folder.rstrip('/')}/{n}") for n in sorted(names) if n.endswith(".parquet")}


def _named(df: DataFrame, **kinds: str) -> DataFrame:
    """The columns of df that are asked for, in any case, under the names asked for; absent ones are null."""
    held = {c.lower(): c for c in df.columns}
    return df.select(*[(F.col(f"`{held[c]}`") if c in held else F.lit(None)).cast(kind).alias(c) for c, kind in kinds.items()])


def _demand(df: DataFrame) -> DataFrame:
    """covered and pop: the first numeric column whose name starts with pop, or 1 for each row if there is none."""
    pops = [f.name for f in df.schema.fields if f.name.lower().startswith("pop") and isinstance(f.dataType, NumericType)]
    covered = next(c for c in df.columns if c.lower() == "covered")
    return df.select(F.coalesce(F.col(f"`{covered}`").cast("int"), F.lit(0)).alias("covered"), (F.col(f"`{pops[0]}`").cast("double") if pops else F.lit(1.0)).alias("pop"))


def metrics_of(found: dict[str, DataFrame]) -> DataFrame:
    """metric_key, metric, value of what was detected, with the index of the plan; without any table an error.

    Demand counts together with facilities only; scores and densities that are no numbers are left out.
    """
    parts = []
    if "access" in found:
        parts.append(audit.access_metrics(_named(found["access"], score="double")))
    if "balance" in found:
        parts.append(audit.balance_metrics(_named(found["balance"], status="string").fillna("")))
    if "facilities" in found:
        facilities = _named(found["facilities"], utilization="double", status="string").fillna({"status": "", "utilization": 0.0})
        nobody = facilities.select(F.lit(0).alias("covered"), F.lit(0.0).alias("pop")).limit(0)
        parts.append(audit.adequacy_metrics(facilities, _demand(found["demand"]) if "demand" in found else nobody))
    if "density" in found:
        parts.append(audit.density_metrics(_named(found["density"], dens_ha="double")))
    if not parts:
        raise ValueError("no table has the columns of a result")
    return audit.labelled(audit.with_index(parts))


def snapshot_folder(spark: SparkSession, folder: str, name: str, path: str, generated: str) -> DataFrame:
    """The metrics of a folder's result tables, which are written as a scenario's snapshot too."""
    metrics = metrics_of(detect(tables_of(spark, folder)))
    scenarios.write_snapshot(metrics.select(F.col("metric_key").alias("metric"), "value"), name, path, generated)
    return metrics
