"""Session settings that every entry point shares."""

from __future__ import annotations

import functools
import tempfile
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Settings that the results depend on (time zone) or that any cluster size profits from.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(app: str = "urbanloom", master: str | None = None, **extra: str) -> SparkSession:
    """A session with SETTINGS; `extra` wins over them (dots written as double underscores)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    for key, value in extra.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


@functools.cache
def _package(application: str) -> str:
    """A zip of this package, made once for each Spark application."""
    root = Path(__file__).resolve().parent
    path = Path(tempfile.mkdtemp(prefix="urbanloom-")) / "urbanloom.zip"
    with zipfile.ZipFile(path, "w") as out:
        for source in sorted(root.rglob("*.py")):
            out.write(source, source.relative_to(root.parent))
    return str(path)


def shipped(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """The query, which first ships the package to the session's workers."""

    @functools.wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        context = spark.sparkContext
        if context.applicationId not in _SHIPPED:
            _SHIPPED.add(context.applicationId)
            context.addPyFile(_package(context.applicationId))
        return query(spark, sf_dir)

    return run


_SHIPPED: set[str] = set()
