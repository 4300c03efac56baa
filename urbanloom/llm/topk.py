"""Exact top-k by inner product: a ball tree for each shard of the candidates, searched by branch and bound.

A node's bound for a query q is q.centre + |q| * radius. A query first goes to the shard whose root has the
highest bound, which gives it a k-th score; with that score it goes on, in waves of falling bound, to the shards
whose bound reaches it. In a shard nodes are visited in the order of their bounds and left out when their bound
is below the current k-th score.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common

K = 20
#: Rows of a shard, of a block of queries, and of a leaf, about.
SHARD_ROWS = 8192
BLOCK_ROWS = 4096
LEAF_ROWS = 256
#: Shards of the second wave; bytes of the shards' roots that are broadcast; tasks that search.
WAVE = 3
ROOT_BYTES = 32 << 20
MOST_TASKS = 10_000
SCALE = 64.0
NONE = np.iinfo(np.int64).min


def quantised(vectors: DataFrame, scale: float = SCALE) -> DataFrame:
    """vec_id and v: floor(scale * x) of each component x. Vectors that are null or hold a null or non-finite
    component are left out, and so are null ids."""
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    v = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale))
    return vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & fine).select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))


class BallTree:
    """Points halved along their widest spread until at most LEAF_ROWS are left; a node has a centre and a radius."""

    def __init__(self, ids: np.ndarray, points: np.ndarray, leaf: int = LEAF_ROWS):
        order = np.argsort(ids, kind="stable")
        self.ids, self.points = ids[order], points[order]
        self.real = self.points.astype("f8")
        self.nodes: list[tuple[int, int, int, int]] = []  # start, stop, left, right
        self.order = np.arange(len(ids))
        self._split(0, len(ids), leaf)
        self.ids, self.points, self.real = self.ids[self.order], self.points[self.order], self.real[self.order]
        self.centres = np.array([self.real[a:b].mean(axis=0) for a, b, _, _ in self.nodes])
        self.radii = np.array([np.sqrt(((self.real[a:b] - c) ** 2).sum(axis=1).max()) for (a, b, _, _), c in zip(self.nodes, self.centres, strict=True)])

    def _split(self, start: int, stop: int, leaf: int) -> int:
        at = len(self.nodes)
        self.nodes.append((start, stop, -1, -1))
        if stop - start > leaf:
            own = self.order[start:stop]
            part = self.real[own]
            axis = int(np.argmax(part.max(axis=0) - part.min(axis=0)))
            if part[:, axis].max() > part[:, axis].min():
                middle = (stop - start) // 2
                self.order[start:stop] = own[np.argpartition(part[:, axis], middle, kind="introselect")]
                left = self._split(start, start + middle, leaf)
                right = self._split(start + middle, stop, leaf)
                self.nodes[at] = (start, stop, left, right)
        return at

    def search(self, q_ids: np.ndarray, queries: np.ndarray, floor: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query's place, vec_id, score) of up to k candidates of each query with scores not below its floor."""
        n = len(q_ids)
        real = queries.astype("f8")
        wide = max(float(np.abs(real).max(initial=0)) * float(np.abs(self.real).max(initial=0)) * real.shape[1], 1.0)
        exact = wide < 2**52
        norms = np.sqrt((real**2).sum(axis=1))
        slack = 1e-9 * wide  # rounding never makes a bound too low
        bounds = real @ self.centres.T + norms[:, None] * self.radii[None, :] * (1 + 1e-12) + slack
        scores, found = np.full((n, k), NONE), np.full((n, k), np.iinfo(np.int64).max)
        kth = floor.copy()
        leaves = np.array([i for i, x in enumerate(self.nodes) if x[2] < 0])
        # Branches whose bound is below the k-th score at the start are cut whole, from the root down.
        open_ = np.zeros((n, len(self.nodes)), bool)
        open_[:, 0] = True
        for i, (_, _, left, right) in enumerate(self.nodes):
            if left >= 0:
                go = open_[:, i] & (bounds[:, i] >= kth)
                open_[:, left] = open_[:, right] = go
        order = np.argsort(-np.where(open_[:, leaves], bounds[:, leaves], -np.inf), axis=1, kind="stable")
        live = np.arange(n)
        for step in range(len(leaves)):
            leaf = leaves[order[live, step]]
            on = open_[live, leaf] & (bounds[live, leaf] >= kth[live])
            live, leaf = live[on], leaf[on]  # later leaves have lower bounds: a query that stops here is done
            if not live.size:
                break
            for node in np.unique(leaf):
                rows = live[leaf == node]
                a, b = self.nodes[node][:2]
                if exact:
                    s = np.rint(real[rows] @ self.real[a:b].T).astype("i8")
                else:
                    s = queries[rows] @ self.points[a:b].T
                s[q_ids[rows][:, None] == self.ids[a:b][None, :]] = NONE
                near = s >= kth[rows][:, None]
                s[~near] = NONE
                hit = near.any(axis=1)
                if not hit.any():
                    continue
                rows, s = rows[hit], s[hit]
                every = np.concatenate([scores[rows], s], axis=1)
                ids = np.concatenate([found[rows], np.broadcast_to(np.where(s == NONE, np.iinfo(np.int64).max, self.ids[a:b][None, :]), s.shape)], axis=1)
                best = self._best(every, ids, k)
                scores[rows], found[rows] = np.take_along_axis(every, best, 1), np.take_along_axis(ids, best, 1)
                kth[rows] = np.maximum(kth[rows], scores[rows, -1])
        at = np.nonzero(scores > NONE)
        return at[0], found[at], scores[at]

    @staticmethod
    def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
        order = np.lexsort((ids, np.where(scores == NONE, np.iinfo(np.int64).max, -np.maximum(scores, NONE + 1))), axis=1)
        return order[:, :k]


def _packed(tree: BallTree) -> bytes:
    out = io.BytesIO()
    np.savez(out, ids=tree.ids, points=tree.points, nodes=np.array(tree.nodes, "i8"), centres=tree.centres, radii=tree.radii)
    return out.getvalue()


def _unpacked(blob: bytes) -> BallTree:
    held, tree = np.load(io.BytesIO(blob)), BallTree.__new__(BallTree)
    tree.ids, tree.points, tree.centres, tree.radii = (held[n] for n in ("ids", "points", "centres", "radii"))
    tree.real, tree.nodes = tree.points.astype("f8"), [tuple(x) for x in held["nodes"].tolist()]
    return tree


def _trees(held: DataFrame, shards: int) -> DataFrame:
    """shard, dim, root (centre and radius as doubles), body (the tree): one for each shard and vector length."""

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        points = np.array(pdf["v"].tolist(), "i8").reshape(len(pdf), pdf["dim"].iat[0])
        tree = BallTree(pdf["vec_id"].to_numpy("i8"), points)
        root = np.append(tree.centres[0], tree.radii[0]).astype("<f8").tobytes()
        return pd.DataFrame({"shard": pdf["shard"].iloc[:1], "dim": pdf["dim"].iloc[:1], "root": [root], "body": [_packed(tree)]})

    dealt = held.select(F.pmod(F.xxhash64("vec_id", "v"), F.lit(shards)).cast("int").alias("shard"), F.size("v").alias("dim"), "vec_id", "v")
    return common.store(dealt.groupBy("shard", "dim").applyInPandas(build, "shard int, dim int, root binary, body binary"))


def _visits(queries: DataFrame, roots: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] | None, shards: int, first: int, last: int | None) -> DataFrame:
    """shard, dim, body (query ids, k-th scores and vectors): queries (block, dim, query_id, q, kth) for the shards
    that are first to last in the order of their roots' bounds, without those whose bound is below the k-th score.

    Without roots (dim -> shards, centres, radii) every shard is sent every query, in an order that starts with
    the block's own number.
    """

    def send(pdf: pd.DataFrame) -> pd.DataFrame:
        dim = int(pdf["dim"].iat[0])
        pdf = pdf.sort_values("query_id")
        q = np.array(pdf["q"].tolist(), "i8").reshape(len(pdf), dim)
        ids, kth = pdf["query_id"].to_numpy("i8"), pdf["kth"].to_numpy("i8")
        if roots is None:
            order = np.roll(np.arange(shards), -int(pdf["block"].iat[0]) % shards)
            go = np.broadcast_to(order[first:last], (len(q), len(order[first:last])))
        else:
            names, centres, radii = roots.get(dim, (np.zeros(0, "i8"), np.zeros((0, dim)), np.zeros(0)))
            real = q.astype("f8")
            wide = np.abs(real).sum(axis=1)[:, None] * (np.abs(centres).max(axis=1, initial=0)[None, :] + radii[None, :]) + 1
            bounds = real @ centres.T + np.sqrt((real**2).sum(axis=1))[:, None] * radii[None, :] + 1e-9 * wide
            order = np.argsort(-bounds, axis=1, kind="stable")[:, first:last]
            go = np.where(np.take_along_axis(bounds, order, 1) >= kth[:, None], names[order], -1)
        out = []
        for shard in np.unique(go[go >= 0]):
            own = (go == shard).any(axis=1)
            out.append((int(shard), dim, b"".join([np.int64(own.sum()).tobytes(), ids[own].tobytes(), kth[own].tobytes(), q[own].tobytes()])))
        return pd.DataFrame(out, columns=["shard", "dim", "body"])

    return queries.groupBy("block", "dim").applyInPandas(send, "shard int, dim int, body binary")


def _searched(trees: DataFrame, visits: DataFrame, parts: int, k: int) -> DataFrame:
    """query_id, vec_id, score: what the shards have for the queries sent to them. A task unpacks each tree once and
    reads query blocks one by one behind it, whatever their number."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, tree = None, None
        for batch in batches:
            for row in batch.to_pylist():
                if row["kind"] == 0:
                    at, tree = (row["shard"], row["dim"]), _unpacked(row["body"])
                elif at == (row["shard"], row["dim"]):
                    n = int(np.frombuffer(row["body"], "i8", 1)[0])
                    values = np.frombuffer(row["body"], "i8", offset=8)
                    ids, kth, q = values[:n], values[n : 2 * n], values[2 * n :].reshape(n, row["dim"])
                    place, found, score = tree.search(ids, q, kth, k)
                    yield pa.RecordBatch.from_arrays([pa.array(ids[place], pa.int64()), pa.array(found, pa.int64()), pa.array(score, pa.int64())], names=["query_id", "vec_id", "score"])

    both = trees.select("shard", "dim", F.lit(0).alias("kind"), "body").unionByName(visits.select("shard", "dim", F.lit(1).alias("kind"), "body"))
    return common.bound_batches(both).repartition(parts, "shard", "dim").sortWithinPartitions("shard", "dim", "kind").mapInArrow(search, "query_id long, vec_id long, score long")


def top_k(vectors: DataFrame, is_query, k: int = K, shard_rows: int = SHARD_ROWS, block_rows: int = BLOCK_ROWS, root_bytes: int = ROOT_BYTES) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k highest integer inner products, ties to smaller vec_id.

    vectors has vec_id and v (arrays of longs of one length; other lengths meet their like only). Rows with the
    query's own vec_id are no candidates of it; repeated query ids count once (the smallest vector). Scores
    must fit a long. Other columns are not read; an empty table gives no rows.

    Each shard's tree is built once and stored. Queries go to the shard with the highest bound, then to the next
    few, then to all others, and after each wave only with the k-th score of the waves before, to shards whose
    bound reaches it. The result is exact. The roots (a vector for each shard) are broadcast if they take up to
    root_bytes; beyond, queries go to all shards in two waves, and bounds are tested there.
    """
    held = common.store(vectors.select("vec_id", "v"))
    shards = max(1, -(-held.count() // shard_rows))
    asked = held.where(is_query).groupBy("vec_id").agg(F.min("v").alias("q"))
    asked = common.store(asked.select(F.col("vec_id").alias("query_id"), F.size("q").alias("dim"), "q"))
    blocks = max(1, -(-asked.count() // block_rows))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int"))
    trees = _trees(held, shards)
    roots, waves = None, [(0, 1), (1, None)]
    if (trees.agg(F.sum(F.length("root"))).first()[0] or 0) <= root_bytes:
        roots, waves = {}, [(0, 1), (1, 1 + WAVE), (1 + WAVE, None)]
        for dim, rows in groupby(trees.select("dim", "shard", "root").orderBy("dim", "shard").collect(), lambda r: r.dim):
            rows = list(rows)
            values = np.array([np.frombuffer(r.root, "<f8") for r in rows]).reshape(len(rows), dim + 1)
            roots[dim] = (np.array([r.shard for r in rows]), values[:, :-1], values[:, -1])
    best = W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    found = None
    for first, last in waves:
        if first and first >= shards:
            break
        kth = F.lit(NONE)
        if found is not None:
            top = found.groupBy("query_id").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("kth"))
            sent, kth = asked.join(top, "query_id", "left"), F.coalesce("kth", F.lit(NONE))
        else:
            sent = asked
        visits = _visits(sent.select("block", "dim", "query_id", "q", kth.alias("kth")), roots, shards, first, last)
        more = _searched(trees, visits, max(1, min(4 * shards, MOST_TASKS)), k)
        more = more if found is None else found.unionByName(more)
        found = common.store(more.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).drop("rank"))
    return found.withColumn("rank", F.row_number().over(best)).select("query_id", "rank", "vec_id", "score")


def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best candidates of every query vector."""
    vectors = quantised(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return top_k(vectors, F.col("vec_id") % 20 == 0)


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 64) AS DOUBLE)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 20
"""
