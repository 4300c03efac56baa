"""Columns of callers keep their names and values, whatever these are; results don't depend on files or partitions."""

import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from urbanloom.llm import licenses, media, mixing, near_dups, packing, pseudonyms, quality, sharding, topk

ODD = ["_size", "size", "_doc_id", "_source", "_text_hash", "_body", "body", "_score", "score", "p", "done", "_pseudonymised", "_d", "_t", "c0", "c3", "a.b", "a`b", "_rid", "_h", "block", "bin", "k", "m", "n", "rid", "found", "items", "_html", "_n", "cid", "comp"]
TEXTS = [f"text number {i} of many words, written at 192.168.0.{i} by someone" for i in range(6)] + [None, "", "same text here five words", "same text here five words"]


def docs(spark):
    """Each odd column holds its own name and the row's number."""
    rows = [(i if i != 5 else None, t, f"s{i % 2}" if i != 4 else None, *[f"{c} {i}" for c in ODD]) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, ", ".join(["doc_id long", "text string", "source string", *[f"`{c.replace('`', '``')}` string" for c in ODD]]))


def whole(rows, columns=("doc_id", "text", "source")):
    """The odd values of each row are its own, in their places."""
    rows = [tuple(r) for r in rows]
    n = len(columns)
    numbers = [r[n].split()[-1] for r in rows]
    assert all(r[n : n + len(ODD)] == tuple(f"{c} {i}" for c in ODD) for r, i in zip(rows, numbers, strict=True))
    return sorted(map(int, numbers))


LABELS = "doc_id long, quality int"


@pytest.mark.parametrize("stage", ["quality", "near_dups", "pseudonyms", "mixing"])
def test_stages_keep_odd_columns(spark, stage):
    df = docs(spark)
    done = {
        "quality": lambda: quality.keep_good(df, spark.createDataFrame([], LABELS)),
        "near_dups": lambda: near_dups.one_of_each(df),
        "pseudonyms": lambda: pseudonyms.pseudonymise(df, "k"),
        "mixing": lambda: mixing.take(df),
    }[stage]()
    assert done.columns == df.columns
    numbers = whole(done.collect())
    if stage in ("quality", "pseudonyms"):
        assert numbers == list(range(len(TEXTS)))
    if stage == "near_dups":
        assert numbers == list(range(len(TEXTS) - 1))
    if stage == "mixing":
        found = mixing.mix(df).collect()
        assert len(numbers) == sum(r.copies for r in found if r["size"])


def test_operators_with_odd_columns(spark):
    df = docs(spark)
    keep = ["doc_id", *ODD]
    n = len(TEXTS)
    assert whole(licenses.scan(df, keep).collect(), ["doc_id"]) == list(range(n))
    assert whole(packing.pack(df, keep).collect(), ["doc_id"]) == list(range(n))
    assert whole(media.parse(df, keep, "text").collect(), ["doc_id"]) == list(range(n))
    scored = quality.score(df, quality.train(df, spark.createDataFrame([], LABELS)), keep)
    assert whole(scored.collect(), ["doc_id"]) == list(range(n))
    counted = pseudonyms.pseudonymise(df, "k", count="score")
    assert counted.columns == [c for c in df.columns if c != "score"] + ["score"] and {r[-1] for r in counted.collect()} == {0, 1}
    assert sharding.shard(df, 4).count() == n and mixing.mix(df).count() == n
    vectors = spark.createDataFrame([(i, [i, 1], "x", "y") for i in range(5)], "vec_id long, v array<long>, score string, shard string")
    assert topk.top_k(vectors, F.col("vec_id") == 0, 2).count() == 2


def test_pipeline_with_odd_columns(spark, tmp_path):
    names = [c for c in ODD if not re.search(r"[.`]", c)]
    df = docs(spark).select("doc_id", "text", "source", *names)
    df.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], LABELS).write.parquet(f"{tmp_path}/labels.parquet")
    assert {r.doc_id for r in cp.run(spark, str(tmp_path)).collect()} <= {*range(len(TEXTS)), None}


def test_many_partitions_and_long_texts(spark):
    """Whole bins of texts in more than a thousand partitions have numbers of their own."""
    long_ = "w " * 5000
    df = spark.range(1100).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 100 == 0, F.lit(long_)).otherwise(F.concat(F.lit("t "), F.col("id"))).alias("text"), F.lit("a").alias("source"))
    rows = packing.pack(df.repartition(1100), ["doc_id"]).collect()
    fills = [r for r in rows if r.words == packing.CAPACITY]
    assert len(fills) == 22 and len({r.bin for r in fills}) == 22 and all(r.bin < 0 and r.offset == 0 for r in fills)
    again = packing.pack(df.repartition(3), ["doc_id"]).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))


def test_shards_do_not_depend_on_partitions(spark):
    rows = [(i, f"copy {i % 40}" if i < 200 else f"t{i}") for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    a = sorted(map(tuple, sharding.shard(df.repartition(1), 6).collect()), key=str)
    assert a == sorted(map(tuple, sharding.shard(df.repartition(9, "text"), 6).collect()), key=str)


def test_equal_rows_in_runs(spark, monkeypatch):
    monkeypatch.setattr(mixing, "RUN", 7)
    rows = [(1, "a b c", "x")] * 40 + [(i, "d e", "y") for i in range(2, 30)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = mixing.mix(df).collect()
    assert len(found) == 68
    taken = mixing.take(df).collect()
    assert len(taken) == sum(r.copies for r in found)
    assert sum(r.doc_id == 1 for r in taken) == sum(r.copies for r in found if r.doc_id == 1)
    assert max(r.copies for r in found if r.doc_id == 1) - min(r.copies for r in found if r.doc_id == 1) <= 1


def test_search_without_roots(spark):
    rows = [(i, [i * 7 % 11 - 5, i % 5, -i]) for i in range(200)]
    df = spark.createDataFrame(rows, "vec_id long, v array<long>")
    a, b = (sorted(map(tuple, topk.top_k(df, F.col("vec_id") % 9 == 0, 4, shard_rows=20, block_rows=5, root_bytes=size).collect())) for size in (0, 1 << 20))
    assert a == b and len(a) == 23 * 4
