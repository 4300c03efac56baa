"""Parquet tables of a data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The table `name` of a folder that holds one Parquet file or directory per table."""
    return spark.read.parquet(f"{folder}/{name}.parquet")
