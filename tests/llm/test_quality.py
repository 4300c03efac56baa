import zlib

import numpy as np
import pyarrow as pa

from urbanloom.llm import quality as q
from urbanloom.llm import tokens as tk


def test_tokens_match_plain_splitting():
    texts = ["Hello, hello  world!!", "", " x ", "Ünï çode\tA1-b2", "a" * 300]
    offsets, data = tk.flat(pa.array([t.encode() for t in texts], pa.binary()))
    hashes, kind, doc = tk.tokens(offsets, data, tk.word_classes(), tk.lower_table())
    plain = [(i, w) for i, t in enumerate(texts) for w in t.encode().lower().split()]
    assert doc.tolist() == [i for i, _ in plain]
    groups = {}
    for h, (_, w) in zip(hashes.tolist(), plain, strict=True):
        groups.setdefault(w, set()).add(h)
    assert all(len(v) == 1 for v in groups.values())
    assert len({next(iter(v)) for v in groups.values()}) == len(groups)


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.1"
    rows = {r.doc_id: r for r in q.op8_quality(spark, folder).collect()}
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert len(rows) == docs.count()
    labels = spark.read.parquet(f"{folder}/labels.parquet").collect()
    for r in rows.values():
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    held = [(rows[x.doc_id].predicted, x.quality) for x in labels if rows[x.doc_id].held_out]
    assert np.mean([p == y for p, y in held]) >= 0.97


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, 0.5), (1, "", 0.1), (None, "good words", 0.2), (2, "x!! " * 9000, None)], "doc_id long, text string, score double")
    none = spark.createDataFrame([], "doc_id long, quality int")
    w = q.train(docs, none)
    assert not w.any()
    assert [r.score for r in q.score(docs, w, ["doc_id"]).collect()] == [0.5] * 4
    some = spark.createDataFrame([(1, 1), (1, 1), (2, None), (None, 1), (3, 7)], "doc_id long, quality int")
    assert q.train(docs, some)[0] > 0
    assert q.score(docs.limit(0), w, ["doc_id"]).count() == 0
