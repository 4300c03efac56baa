import zlib

import numpy as np
import pytest

from urbanloom.llm import token_files as tf


def reference_ids(text):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tf.tokenizer_path(tf.TOKENIZER))
    return [*t.encode(text or "", add_special_tokens=False).ids, tf.END_ID]


@pytest.mark.parametrize("ids", [[], [0], [255], [256], [1, 70000, 3, 2**32 - 1, 255, 256], list(range(0, 60000, 7))])
def test_random_access_and_ranges(ids):
    data = tf.encode_file([5, None], [len(ids), 0], np.array(ids, "<u4"))
    held = tf.TokenFile(data)
    assert held.ids(0, len(ids)).tolist() == ids
    assert held.ids(len(ids) // 3, len(ids) // 2).tolist() == ids[len(ids) // 3 : len(ids) // 2]
    for i in range(0, len(ids), max(1, len(ids) // 50)):
        assert held.id(i) == ids[i]
    assert held.no_id.tolist() == [False, True]


def test_documents_round_trip(spark):
    long = " ".join(f"Wörd{i % 977},x" for i in range(20000))
    rows = [(3, "Hello  world"), (1, None), (2, ""), (7, "Hello world <|endoftext|> It's é ́"), (7, "Hello world <|endoftext|> It's é ́"), (5, long), (None, "ΣΑΣ x")]
    docs = spark.createDataFrame([(d, t, "n") for d, t in rows], "doc_id long, text string, start string")
    found = sorted(tf.token_files(docs).collect(), key=lambda r: r.start)
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    at = 0
    for (doc_id, text), r in zip(order, found, strict=True):
        ids = reference_ids(text)
        assert (r.doc_id, r.start, r.n_tokens) == (doc_id, at, len(ids))
        assert r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        at += len(ids)


def test_pieces_like_the_library():
    encode = tf.WordEncoder(tf.tokenizer_path(tf.TOKENIZER))
    texts = ["it's don't'll 'tis a's. b'", "Word, word. word!!! (word) wörd, WÖRD; naïve... e\u0301te e\u0301", "İstanbul ǅ ΣΣ ς'", "x<|endoftext|>y <|ENDOFTEXT|>", "a1 1a 12,345.6 9' ½ ² ٣٤ x² ªb", "\u00a0a\u00a0b \x1c c\x85d \u2003e", "日本語、テスト。 한국어! \ud7a3\u11a8", "##a ..b. -c- _d_ __ é.é", "\x00 \ufffd \u200b z\u200bz", "ﬁ K Å"]
    for text in texts * 2:
        for t in (text, text.upper(), text.title()):
            ids = np.frombuffer(encode(t.encode()), "<u4").tolist()
            assert [*ids, tf.END_ID] == reference_ids(t), t


def test_empty(spark):
    assert tf.token_files(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_corpus(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = {r.doc_id: reference_ids(r.text) for r in df.collect()}
    got = {r.doc_id: r for r in tf.op10_token_files(spark, "/root/testdata/sf0.001").collect()}
    at = 0
    for d in sorted(want):
        assert (got[d].start, got[d].n_tokens, got[d].ids_crc32) == (at, len(want[d]), zlib.crc32(np.array(want[d], "<u4").tobytes()))
        at += len(want[d])
