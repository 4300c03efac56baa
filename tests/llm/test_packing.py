import re
from collections import Counter, defaultdict

import numpy as np

from urbanloom.llm import packing as pk


def naive(sizes, sources, clusters, capacity, limit):
    """Looks at every bin: the compatible one with the smallest residual, then the smallest number."""
    bins, out = [], []
    for size, s, c in zip(sizes, sources, clusters, strict=True):
        fit = [(r - 0, i) for i, (r, members) in enumerate(bins) if r >= size and all(m[1] != c for m in members) and sum(m[0] == s for m in members) < limit]
        i = min(fit)[1] if fit else len(bins)
        if not fit:
            bins.append((capacity, []))
        out.append((i, capacity - bins[i][0]))
        bins[i] = (bins[i][0] - size, [*bins[i][1], (s, c)])
    return out


def test_best_fit_like_naive():
    rng = np.random.default_rng(2)
    for limit in (1, 2, 5):
        sizes, sources, clusters = rng.integers(1, 50, 400), rng.integers(0, 4, 400), rng.integers(0, 60, 400)
        b, o = pk.best_fit(sizes, sources, clusters, 64, limit)
        assert list(zip(b.tolist(), o.tolist(), strict=True)) == naive(sizes.tolist(), sources.tolist(), clusters.tolist(), 64, limit)


def check(rows, docs, capacity, limit):
    """docs: (id, source, text) with distinct ids."""
    size = {d: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, _, t in docs}
    info = {d: (s, re.sub(r"[\x20\x09-\x0D]+", " ", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")).strip(" ")) for d, s, t in docs}
    bins, pieces = defaultdict(list), defaultdict(list)
    for r in rows:
        assert r.size == size[r.doc_id] and 0 <= r.words <= capacity
        pieces[r.doc_id].append((r.piece, r.words))
        assert (r.bin is None) == (r.words == 0)
        if r.words:
            bins[r.bin].append(r)
    for d, found in pieces.items():
        found.sort()
        assert [p for p, _ in found] == list(range(len(found))) and sum(w for _, w in found) == size[d]
        assert all(w == capacity for _, w in found[:-1])
    assert set(pieces) == set(size)
    for members in bins.values():
        members.sort(key=lambda r: r.offset)
        at = 0
        for r in members:
            assert r.offset == at
            at += r.words
        assert at <= capacity
        clusters = Counter(info[r.doc_id][1] for r in members)
        assert max(clusters.values()) == 1 and max(Counter(info[r.doc_id][0] for r in members).values()) <= limit
    return sum(r.words for m in bins.values() for r in m) / (capacity * len(bins))


def test_edges(spark):
    docs = [(1, "a", None), (2, None, ""), (3, "a", "w " * 100), (4, "a", "w " * 64), (5, None, "x y"), (6, None, "X\t y "), (7, None, "z"), (8, None, "q"), (9, "b", "r")]
    df = spark.createDataFrame([(*d, 0) for d in docs], "doc_id long, source string, text string, bin int")
    check(pk.pack(df, ["doc_id"], 64, 2).collect(), docs, 64, 2)
    twice = df.unionAll(df.where("doc_id = 3")).selectExpr("cast(null as bigint) as doc_id", "source", "text", "bin")
    assert pk.pack(twice, ["doc_id", "text"], 64, 2).count() == 9 + 1 + 2
    assert pk.pack(df.limit(0), ["doc_id"]).count() == 0


def test_corpus(spark):
    folder = "/root/testdata/sf0.01"
    docs = [(r.doc_id, r.source, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    assert check(pk.op6_packing(spark, folder).collect(), docs, pk.CAPACITY, pk.SOURCE_LIMIT) > 0.93


def test_many_blocks(spark):
    docs = [(i, f"s{i % 3 and i % 40}", ("w%d " % (i % 900)) * (i % 50 + 1)) for i in range(3000)]
    df = spark.createDataFrame(docs, "doc_id long, source string, text string")
    assert check(pk.pack(df, ["doc_id"], 200, 3, block_rows=500).collect(), docs, 200, 3) > 0.8
