import zlib
from collections import Counter, defaultdict

from urbanloom.llm import sharding as sh


def check(rows, docs, shards):
    body = lambda t: (t or "").encode()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == Counter((d, len(body(t)) + 16, zlib.crc32(body(t))) for d, t in docs)
    held = Counter({s: 0 for s in range(shards)}) + Counter(r.shard for r in rows)
    counts = [held[s] for s in range(shards)]
    assert max(counts) - min(counts) <= 1
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
        assert r.law == "rows" and r.grown_shard is None
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    for s in slots:
        own = sorted((r for r in rows if r.shard == s), key=lambda r: r.slot)
        ids = [-1 if r.doc_id is None else r.doc_id for r in own]
        assert ids == sorted(ids)  # whatever the number of ranges, slots follow doc_id


def cut(rows):
    """Pairs of equal texts in different shards, over all pairs of equal texts."""
    groups = defaultdict(Counter)
    for r in rows:
        groups[r.text_crc32, r.size][r.shard] += 1
    pairs = lambda n: n * (n - 1) // 2
    every = sum(pairs(sum(c.values())) for c in groups.values())
    return 1 - sum(pairs(n) for c in groups.values() for n in c.values()) / max(1, every)


def test_links_stay_together(spark):
    docs = [(i, f"copy {i // 3}" if i < 300 else f"alone {i}") for i in range(1203)] + [(5, None), (None, ""), (7, "z" * 100_000)]
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, shard int")
    rows = sh.shard(df, 10).collect()
    check(rows, docs, 10)
    assert cut(rows) < 0.05


def test_hot_group(spark):
    docs = [(i, "same" if i % 3 == 0 else f"t{i}") for i in range(2000)] + [(1, "same")] * 3
    rows = sh.shard(spark.createDataFrame(docs, "doc_id long, text string"), 8).collect()
    check(rows, docs, 8)
    per = Counter(r.shard for r in rows if r.size == 20)
    assert cut(rows) < 0.86 and len(per) <= 8


def test_few_rows(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a")], "doc_id long, text string")
    check(sh.shard(df).collect(), [(1, "a"), (2, "a")], 40)
    assert sh.shard(df.limit(0)).count() == 0


def test_corpus(spark):
    folder = "/root/testdata/sf0.01"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    rows = sh.op2_sharding(spark, folder).collect()
    check(rows, docs, 40)
    linked = [r for r in rows if r.linked]
    assert len(linked) > 50 and sum(r.apart for r in linked) <= 0.02 * len(linked)
    assert cut(rows) < 0.1


def test_order_over_many_ranges(spark):
    """Numbers by ranges: gapless and in order within keys, null keys and ties included, for any number of partitions."""
    from pyspark.sql import functions as F

    from urbanloom.llm import common

    spark.conf.set("spark.sql.shuffle.partitions", "13")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.range(4000).select(F.when(F.col("id") % 3 > 0, F.col("id") % 3).alias("k"), F.floor(F.col("id") * 7919 % 4001 / 5).alias("v"), "id")
        rows = common.ordered_rank(df, ["k"], ["v", "id"], "n").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    for k in (None, 1, 2):
        own = sorted((r.v, r.id, r.n) for r in rows if r.k == k)
        assert [n for *_, n in own] == list(range(len(own))) and len(own) > 1000
