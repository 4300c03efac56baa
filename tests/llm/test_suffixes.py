import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from urbanloom.llm import suffixes as sx


def brute(rows, length):
    bodies = [(d, (t or "").encode()) for d, t in rows]
    count = Counter(b[p : p + length] for _, b in bodies for p in range(len(b) - length + 1))
    out = []
    for d, b in bodies:
        gone = np.zeros(len(b) + 1, bool)
        for p in range(len(b) - length + 1):
            if count[b[p : p + length]] > 1:
                gone[p : p + length] = True
        spans = int((np.diff(np.append(0, gone.astype(int))) == 1).sum())
        kept = bytes(x for x, g in zip(b, gone[:-1], strict=True) if not g)
        out.append((d, len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def found(df, length):
    out = sx.without_repeats(df, length).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256))
    return sorted((tuple(r) for r in out.collect()), key=str)


def text(rng, n, letters="abcdefgh ijk é"):
    return "".join(rng.choice(letters) for _ in range(n))


@pytest.mark.parametrize("piece", [1 << 20, 700])
def test_against_brute_force(spark, monkeypatch, piece):
    monkeypatch.setattr(sx, "PIECE", piece)
    rng = random.Random(3)
    passages = [text(rng, n) for n in (137, 180, 200, 201, 260, 400, 900)]
    rows = []
    for i in range(60):
        parts = [text(rng, rng.randrange(0, 200)) for _ in range(3)]
        for _ in range(rng.randrange(0, 3)):
            p = rng.choice(passages)
            a = rng.randrange(0, 60)
            parts.insert(rng.randrange(3), p[a : len(p) - rng.randrange(0, 60)])
        rows.append((i, "".join(parts)))
    rows += [(100 + i, rows[i][1][:40] + "#" + rows[i][1][41:]) for i in range(10)]  # near copies
    rows += [(200 + i, rows[7][1] + text(rng, 400)) for i in range(4)]
    rows += [(300, "=" * 700), (301, "ab" * 400), (302, "x" * 199), (303, "y" * 200), (304, "z" * 201), (305, text(rng, 2) * 300)]
    assert found(spark.createDataFrame(rows, "doc_id long, text string"), 200) == brute(rows, 200)


def test_hashes_of_places_do_not_depend_on_what_surrounds_them():
    rng = np.random.default_rng(5)
    data = rng.integers(0, 256, 3000, dtype="u1")
    for which in (0, 1):
        whole = sx.hashes_at(data, [np.array([700])], [200], which)[0]
        part = sx.hashes_at(data[650:1000], [np.array([50])], [200], which)[0]
        assert whole == part


def test_whole_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    got = sorted((tuple(r) for r in sx.op11_repeats(spark, "/root/testdata/sf0.001").collect()), key=str)
    assert got == brute(rows, 200) and sum(r[2] > 0 for r in got) > 20


def test_edges(spark):
    rng = random.Random(1)
    a, b = text(rng, 300), text(rng, 250)
    rows = [(1, a), (1, a), (None, b), (None, b), (2, None), (3, ""), (4, a[:199]), (5, a[50:260] + "!"), (None, None), (6, text(rng, 500))]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, n_bytes int, digest string")
    assert found(df, 200) == brute(rows, 200)
    assert found(df.where("doc_id = 6"), 200) == brute(rows[-1:], 200)
    assert found(df.limit(0), 200) == []
    with pytest.raises(ValueError, match="198"):
        sx.without_repeats(df, 190)


@pytest.mark.parametrize("most", [2, 5, 40])
def test_ranks(spark, most):
    rng = random.Random(most)
    strings = [[rng.randrange(1, 4) for _ in range(rng.randrange(0, 40))] for _ in range(30)] + [[1] * 30, [1] * 30, [2, 1] * 15]
    letters = [(s, i, c) for s, x in enumerate(strings) for i, c in enumerate(x)]
    got = {(r.s, r.i): r.r for r in sx.ranks(sx.followed(spark.createDataFrame(letters, "s long, i int, c long")), most).collect()}
    assert len(got) == len(letters)
    prefix = {(s, i): tuple(strings[s][i : i + most]) for s, i, _ in letters}
    for x in prefix:
        for y in prefix:
            if prefix[x] < prefix[y]:
                assert got[x] < got[y]
