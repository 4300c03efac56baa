import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from urbanloom.llm import near_dups as nd
from urbanloom.llm.components import components


def shingles(text, n):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1)))


def brute(docs, n, percent=80):
    """(doc_id, n_shingles, component_id) with union-find over pairs that share a shingle."""
    sets = [shingles(t, n) for _, t in docs]
    up = list(range(len(docs)))

    def find(i):
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    first, where = {}, defaultdict(list)
    for i, s in enumerate(sets):
        if s and s in first:
            up[find(i)] = find(first[s])
        elif s:
            first[s] = i
            for g in s:
                where[g].append(i)
    for i in first.values():
        common = defaultdict(int)
        for g in sets[i]:
            for j in where[g]:
                if j < i:
                    common[j] += 1
        for j, k in common.items():
            if 100 * k >= percent * (len(sets[i]) + len(sets[j]) - k):
                up[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(docs):
        if d is not None:
            low[find(i)] = min(low.get(find(i), d), d)
    return sorted(((d, len(sets[i]), low.get(find(i))) for i, (d, _) in enumerate(docs)), key=str)


def check(spark, docs, n):
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, kept int")
    rows = nd.near_duplicates(df, n).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in rows), key=str) == brute(docs, n)
    for r in rows:
        assert r.kept == (r.component_id is None or r.doc_id == r.component_id)


def family(rng, words, copies, edits):
    """Texts that go from one to the next by a few replaced words: a chain whose ends are far apart."""
    out, text = [], [f"w{rng.randrange(3000)}" for _ in range(words)]
    for _ in range(copies):
        out.append(" ".join(text))
        for _ in range(edits):
            text[rng.randrange(words)] = f"w{rng.randrange(3000)}"
    return out


@pytest.mark.parametrize("n", [2, 5])
def test_chains_and_families(spark, n, monkeypatch):
    monkeypatch.setattr(nd, "SKETCH_BLOCK", 16)
    monkeypatch.setattr(nd, "TEXT_BLOCK", 8)
    rng = random.Random(n)
    texts = [t for k in range(6) for t in family(rng, 60, 25, 1 + k % 3)]
    base = [f"v{rng.randrange(500)}" for _ in range(80)]
    for _ in range(60):  # about the threshold from one another
        t = list(base)
        for _ in range(rng.randrange(2, 7)):
            t[rng.randrange(80)] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(t))
    rng.shuffle(texts)
    check(spark, list(enumerate(texts)), n)


def test_edges(spark):
    docs = [(1, None), (2, ""), (3, " \t\n"), (4, "One"), (5, "one"), (6, "one two"), (7, "ONE\x0btwo"), (None, "one two"), (None, None), (None, "lonely words here"), (8, "É x"), (9, "é x"), (6, "one two"), (6, "other text entirely"), (10, "w " * 60000), (11, "w w"), (12, "a b c d e f"), (13, "a b c d e f g")]
    check(spark, docs, 2)
    check(spark, docs, 5)
    assert nd.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_corpus(spark):
    folder = "/root/testdata/sf0.01"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    rows = nd.op5_near_dups(spark, folder).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in rows), key=str) == brute(docs, 2)


def test_estimate():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 2000, dtype="u8")
    for keep in (2000, 1800, 1200, 0):
        other = np.concatenate([base[:keep], rng.integers(0, 2**63, 2000 - keep, dtype="u8")])
        _, _, k = nd.signatures([np.unique(base), np.unique(other)])
        assert abs(nd.estimate(k[0], k[1]) - keep / (4000 - keep)) < 0.15
    assert nd.shingle_sets(pa.array([b"a b", b"A B c", b"a"], pa.binary()), 2)[0][0] in nd.shingle_sets(pa.array([b"A B c"], pa.binary()), 2)[0]


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 50)] + [(100, 99), (101, 100), (7, 7)] + [(200, 200 + i) for i in range(1, 30)]
    got = {r.node: r.comp for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(51), 0), **dict.fromkeys((99, 100, 101), 99), **dict.fromkeys(range(200, 230), 200)}
