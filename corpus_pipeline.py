"""From documents to packed training sequences: quality, near-duplicates, pseudonyms, mixing, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before it kept. All but the last
return the columns of documents. Stages keep null texts and ids as their operators state.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from urbanloom.llm import common, mixing, near_dups, packing, pseudonyms, quality


def good_only(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, trained on labels, does not reject."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def distinct_only(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five-word shingles, similarity of 0.8 or more."""
    return near_dups.one_of_each(docs)


def pseudonymous(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal numbers, dates and secrets replaced by keyed pseudonyms of their format.

    The key is the session's setting urbanloom.pseudonyms.key; without it, that of the registered query.
    """
    return pseudonyms.pseudonymise(docs, spark.conf.get("urbanloom.pseudonyms.key", pseudonyms.KEY))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it."""
    return mixing.take(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their bins."""
    return packing.pack(docs, ["doc_id", "source"])


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", good_only),
    ("near_dups", distinct_only),
    ("pseudonyms", pseudonymous),
    ("mixing", mixed),
    ("packing", packed),
]

#: SQL can express neither the classifier nor dependent rounding: tests compare with plain versions.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir, each stage's rows written and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = common.store(docs)
    return docs
