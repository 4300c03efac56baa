import numpy as np
import pytest
from pyspark.sql import functions as F

from urbanloom.llm import topk


def brute(rows, k, is_query):
    out = set()
    for qid, q in {i: min(v for j, v in rows if j == i) for i, _ in rows if is_query(i)}.items():
        found = sorted(((-sum(a * b for a, b in zip(q, v, strict=True)), i) for i, v in rows if i != qid and len(v) == len(q)))
        out |= {(qid, n + 1, i, -s) for n, (s, i) in enumerate(found[:k])}
    return out


@pytest.mark.parametrize("spread", [3, 10**6, 2**29])
def test_against_brute_force(spark, spread):
    rng = np.random.default_rng(5)
    rows = [(int(i), rng.integers(-spread, spread, 6).tolist()) for i in rng.permutation(300)]
    rows += [(1000 + i, rows[0][1]) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, v array<long>")
    got = {tuple(r) for r in topk.top_k(df, F.col("vec_id") % 7 == 0, 5, shard_rows=64, block_rows=16).collect()}
    assert got == brute(rows, 5, lambda i: i % 7 == 0)


def test_tree_prunes():
    rng = np.random.default_rng(1)
    points = np.concatenate([rng.integers(0, 5, (500, 4)) + c * 1000 for c in range(4)])
    tree = topk.BallTree(np.arange(2000), points, 16)
    assert len(tree.nodes) > 100
    at, ids, scores = tree.search(np.array([-1]), np.array([[1, 1, 1, 1]]), np.array([topk.NONE]), 3)
    assert scores.tolist() == sorted(points.sum(axis=1).tolist())[::-1][:3] and (ids >= 1500).all()


def test_bad_vectors_and_few_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (20, None), (40, [nan, 1.0]), (60, [None, 1.0]), (1, [0.5, inf]), (2, [0.26, -0.01]), (None, [1.0, 1.0]), (80, []), (3, [1.0]), (100, [0.0, 0.0])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, score int")
    got = sorted(tuple(r) for r in topk.top_k(topk.quantised(df), F.col("vec_id") % 20 == 0).collect())
    assert got == [(0, 1, 2, 64 * 16 - 128), (0, 2, 100, 0), (100, 1, 0, 0), (100, 2, 2, 0)]
    assert topk.top_k(topk.quantised(df.limit(0)), F.col("vec_id") % 20 == 0).count() == 0


def test_repeated_queries(spark):
    rows = [(0, [3, 1]), (0, [3, 1]), (0, [4, 0]), (5, [1, 1]), (5, [1, 1])]
    got = sorted(tuple(r) for r in topk.top_k(spark.createDataFrame(rows, "vec_id long, v array<long>"), F.col("vec_id") == 0, 3).collect())
    assert got == [(0, 1, 5, 4), (0, 2, 5, 4)]
