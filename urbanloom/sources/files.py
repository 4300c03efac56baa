"""Small text files on any file system that the session reaches."""

from __future__ import annotations

from pyspark.sql import SparkSession


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Writes one small file (UTF-8) in place of what is there; a path without a scheme is on the default file system."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at, True)
    try:
        out.write(bytearray(text, "utf-8"))
    finally:
        out.close()
