"""Intermediate tables in the cluster's shared checkpoint folder: they cut lineage and outlive executors."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame


def written(df: DataFrame) -> DataFrame:
    """df written once below spark.checkpoint.dir and read again.

    Where that is unset, a local temporary folder serves in a single process; on a cluster it is an error.
    """
    spark = df.sparkSession
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("urbanloom.scratch", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="urbanloom-")
        spark.conf.set("urbanloom.scratch", base)
    path = f"{base.rstrip('/')}/urbanloom-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
