import re
from collections import Counter, defaultdict

import pytest

from urbanloom.llm import mixing as mx


def plain_targets(sizes):
    """Shares by weight; stops at three times a source's size, reshared until none is above."""
    names = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    w = {s: i % 3 + 1 for i, s in enumerate(names)}
    total, out, free = sum(sizes.values()), {}, list(names)
    while free:
        rest, weight = total - sum(out.values()), sum(w[s] for s in free)
        over = [s for s in free if rest * w[s] / weight > 3 * sizes[s]]
        if not over:
            out |= {s: rest * w[s] / weight for s in free}
            break
        out |= {s: 3.0 * sizes[s] for s in over}
        free = [s for s in free if s not in over]
    return out


def check(rows, docs):
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = defaultdict(int)
    for d, s, t in docs:
        sizes[s] += size(t)
    want, taken, largest = plain_targets(sizes), Counter(), Counter()
    assert Counter((r.doc_id, r.source, r.size) for r in rows) == Counter((d, s, size(t)) for d, s, t in docs)
    for r in rows:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        assert 0 <= r.taken <= 3 * r.size and r.taken == r.copies * r.size
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r.size)
    for s in sizes:
        assert abs(taken[s] - want[s]) <= largest[s] + 1e-6


def test_edges(spark):
    docs = [(1, "b", "a b c"), (1, "b", "a b c"), (1, "b", "a b c"), (2, None, "x y"), (3, None, None), (4, "ä", ""), (None, "z", "q " * 5000), (None, "z", "r\tq\x0bx"), (5, "a", "one"), (6, "", "w w")]
    df = spark.createDataFrame(docs, "doc_id long, source string, text string").selectExpr("*", "1 as target", "2 as size")
    rows = mx.mix(df).collect()
    check(rows, docs)
    assert sorted(map(str, rows)) == sorted(map(str, mx.mix(df.repartition(3)).collect()))
    kept = Counter((r.doc_id, r.source, r.text) for r in mx.take(df).collect())
    copies = Counter()
    for r in rows:
        copies[r.doc_id, r.source, r.size] += r.copies if r.size else 0
    got = Counter()
    for (d, s, t), n in kept.items():
        got[d, s, len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))] += n
    assert got == +copies
    assert mx.take(df).columns == df.columns
    assert mx.mix(df.limit(0)).count() == 0 and mx.take(df.limit(0)).count() == 0
    assert {r.taken for r in mx.mix(df.where("doc_id in (3, 4)")).collect()} == {0}


def test_corpus(spark):
    folder = "/root/testdata/sf0.01"
    docs = [(r.doc_id, r.source, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    check(mx.op3_mixing(spark, folder).collect(), docs)
