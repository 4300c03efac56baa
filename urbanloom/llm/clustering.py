"""Ball k-means: exact k-means that holds each cluster as a ball and compares only what neighbour balls can win.

A cluster is a centroid and a radius that covers its vectors. Cluster j is a neighbour of i if the distance of their
centroids is at most twice i's radius; others can win no vector of i. A vector of i nearer to its centroid than half
the distance to the nearest neighbour lies in the stable core and stays; the rest lie in annuli, ring t between half
the distances to neighbours t and t + 1, and are compared with the first t neighbours alone. All tests are made on
whole numbers (or with a margin), so the clusters are those of plain k-means.

A round reads the vectors with their clusters from the shared folder and writes them with the next ones, in the same
tasks and without a shuffle; each task adds the sums of its clusters, which Spark adds up. The driver holds k centroids.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

CLUSTERS, ROUNDS, DIMENSIONS, SCALE, SEED = 8, 10, 64, 1024, 3
#: Quantised components may be so large at most: squared distances of 64 of them, times four, fit a long.
LARGEST = 1 << 26
#: Vectors that are worked on at once.
BLOCK = 4096


def quantised(vectors: DataFrame, dimensions: int = DIMENSIONS, scale: int = SCALE) -> DataFrame:
    """vec_id and v, floor(scale * x) of each component, of the vectors with `dimensions` components, none null or
    non-finite. A component beyond LARGEST is an error, as distances would not fit a long."""
    fine = (F.size("embedding") == dimensions) & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    held = vectors.where(F.col("embedding").isNotNull() & fine)
    v = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale))
    small = F.forall("v", lambda x: F.abs(x) <= LARGEST)
    held = held.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))
    return held.select("vec_id", F.when(small, F.col("v")).otherwise(F.raise_error(F.lit(f"a component is beyond {LARGEST} after scaling"))).alias("v"))


def first_centroids(vectors: DataFrame, clusters: int = CLUSTERS, seed: int = SEED) -> np.ndarray:
    """The vectors with the smallest sha256 of '<seed>:<vec_id>' (a null id is written as empty), ties by vector."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit("")))
    rows = vectors.orderBy(F.sha2(name.cast("binary"), 256), "v").limit(clusters).select("v").collect()
    return np.array([r.v for r in rows], "i8").reshape(len(rows), len(rows[0].v) if rows else 0)


def squared(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances of all x and centroids, as longs."""
    top = max(int(np.abs(x).max(initial=0)), int(np.abs(centroids).max(initial=0)))
    if 4 * x.shape[1] * top * top < 1 << 53:  # every step is a whole number that a double holds
        a, c = x.astype("f8"), centroids.astype("f8")
        return ((a * a).sum(axis=1)[:, None] - 2 * (a @ c.T) + (c * c).sum(axis=1)[None, :]).astype("i8")
    return np.stack([((x - c) ** 2).sum(axis=1) for c in centroids], axis=1)


class Balls:
    """The clusters of a round: centroids, their mutual distances, and neighbours in the order of distance."""

    def __init__(self, centroids: np.ndarray, radii: np.ndarray):
        self.centroids, self.between = centroids, squared(centroids, centroids)
        self.neighbours = []
        for i, row in enumerate(self.between):
            order = np.argsort(row, kind="stable")
            near = np.sqrt(row[order].astype("f8")) <= 2 * radii[i] * (1 + 1e-9) + 1e-6
            self.neighbours.append(order[near & (order != i)])

    def assign(self, x: np.ndarray, cluster: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """(nearest cluster, ties to the smaller number; squared distance; distances computed) from the present clusters."""
        out, best, made = cluster.copy(), np.zeros(len(x), "i8"), 0
        for i in np.unique(cluster):
            rows = np.flatnonzero(cluster == i)
            own = squared(x[rows], self.centroids[i : i + 1])[:, 0]
            made += rows.size
            near = self.neighbours[i]
            # Ring of a vector: how many neighbours lie within twice its distance, so that they may be as near.
            ring = np.searchsorted(self.between[i, near], 4 * own, side="right")
            best[rows] = own
            for t, j in enumerate(near):
                outer = np.flatnonzero(ring > t)
                if not outer.size:
                    break
                at = rows[outer]
                d = squared(x[at], self.centroids[j : j + 1])[:, 0]
                made += at.size
                wins = (d < best[at]) | ((d == best[at]) & (j < out[at]))
                best[at[wins]], out[at[wins]] = d[wins], j
        return out, best, made


def _pass(held: DataFrame, balls: Balls) -> DataFrame:
    """held (vec_id, body, cluster) with the next cluster and distance; and for each cluster of a task a row with its
    count, sums and largest distance (stat = true)."""
    k, dims = balls.centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, sums, far, made = np.zeros(k, "i8"), np.zeros((k, dims), "i8"), np.zeros(k, "i8"), 0
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK):
                part = batch.slice(start, BLOCK)
                x = np.frombuffer(b"".join(part.column("body").to_pylist()), "<i4").reshape(-1, dims).astype("i8")
                cluster, dist, work = balls.assign(x, part.column("cluster").to_numpy(zero_copy_only=False).astype("i8"))
                made += work
                for j in np.unique(cluster):
                    own = cluster == j
                    count[j] += own.sum()
                    sums[j] += x[own].sum(axis=0)
                    far[j] = max(far[j], dist[own].max())
                n = len(x)
                yield pa.RecordBatch.from_arrays([part.column("vec_id"), part.column("body"), pa.array(cluster.astype("i4")), pa.array(dist), pa.array(np.zeros(n, bool)), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.list_(pa.int64()))], names=names)
        some = np.flatnonzero(count)
        m = len(some)
        made_by = [made if i == 0 else 0 for i in range(m)]
        yield pa.RecordBatch.from_arrays([pa.nulls(m, pa.int64()), pa.nulls(m, pa.binary()), pa.array(some.astype("i4")), pa.array(far[some]), pa.array(np.ones(m, bool)), pa.array(count[some]), pa.array(made_by, pa.int64()), pa.array(sums[some].tolist(), pa.list_(pa.int64()))], names=names)

    names = ["vec_id", "body", "cluster", "distance", "stat", "n", "made", "sums"]
    schema = "vec_id long, body binary, cluster int, distance long, stat boolean, n long, made long, sums array<long>"
    return common.store(held.select("vec_id", "body", "cluster").mapInArrow(run, schema))


def _means(done: DataFrame, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(next centroids: exact floored means, empty clusters stay; radii that cover the clusters around them)."""
    wide = F.posexplode("sums").alias("at", "x")
    sums = done.where("stat").select("cluster", "n", "distance", wide).groupBy("cluster", "at")
    sums = sums.agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("x"), F.sum("n").alias("n"), F.max("distance").alias("far")).collect()
    after, radii = centroids.copy(), np.zeros(len(centroids))
    for r in sums:
        after[r.cluster, r["at"]] = int(r.x) // r.n
        radii[r.cluster] = float(r.far) ** 0.5
    return after, radii + np.sqrt(((after - centroids).astype("f8") ** 2).sum(axis=1))


def ball_kmeans(vectors: DataFrame, centroids: np.ndarray, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray, list[int]]:
    """(vec_id, cluster, distance of every row; the final centroids; distances computed in each pass).

    vectors has vec_id and v (longs of one length, up to LARGEST); rows may repeat, and each counts; ids may be null.
    `rounds` times every vector goes to its nearest centroid and centroids move to the floored means of their
    vectors; then vectors are assigned once more. Rounds end early once no centroid moves, as later ones change nothing.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column("v").flatten().to_numpy().astype("<i4").reshape(batch.num_rows, -1)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array([v.tobytes() for v in values], pa.binary())], names=["vec_id", "body"])

    held = common.store(vectors.select("vec_id", "v").mapInArrow(pack, "vec_id long, body binary").withColumn("cluster", F.lit(0)))
    radii, made = np.full(len(centroids), np.inf), []
    for at in range(rounds + 1):
        done = _pass(held, Balls(centroids, radii))
        common.drop_stored(held)
        held = done.where("not stat")
        after, radii = _means(done, centroids)
        made.append(done.agg(F.sum("made")).first()[0] or 0)
        if at == rounds or (after == centroids).all():
            break
        centroids = after
    return held.select("vec_id", "cluster", "distance"), centroids, made


def op13_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every 64-component vector's cluster after ten rounds from eight start vectors, with inertias and centroid digest."""
    vectors = common.store(quantised(spark.read.parquet(f"{sf_dir}/embeddings.parquet")))
    start = first_centroids(vectors)
    if not len(start):
        schema = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
        return spark.createDataFrame([], schema)
    placed, centroids, _ = ball_kmeans(vectors, start)
    own = placed.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    own = {r.cluster: r.cluster_inertia for r in own.collect()}
    digests = [(i, own.get(i, 0), sum(own.values()), hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for i, c in enumerate(centroids.tolist())]
    table = spark.createDataFrame(digests, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return placed.join(F.broadcast(table), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _oracle() -> str:
    parts = [
        f"""v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * {SCALE}) AS BIGINT)) AS e
  FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) = {DIMENSIONS} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"x AS MATERIALIZED (SELECT r, unnest(range(1, {DIMENSIONS + 1})) AS p, unnest(e) AS x FROM v)",
        f"f AS (SELECT row_number() OVER (ORDER BY sha256('{SEED}:' || coalesce(CAST(vec_id AS VARCHAR), '')), e) - 1 AS c, e FROM v QUALIFY c < {CLUSTERS})",
        f"c0 AS MATERIALIZED (SELECT c, unnest(range(1, {DIMENSIONS + 1})) AS p, unnest(e) AS m FROM f)",
    ]
    for i in range(ROUNDS + 1):
        parts.append(f"d{i} AS (SELECT r, c, CAST(sum((x - m) * (x - m)) AS BIGINT) AS d FROM x JOIN c{i} USING (p) GROUP BY r, c)")
        parts.append(f"a{i} AS MATERIALIZED (SELECT r, CAST(arg_min(c, d * {CLUSTERS} + c) AS INTEGER) AS c, min(d) AS d FROM d{i} GROUP BY r)")
        if i < ROUNDS:
            parts.append(f"s{i} AS (SELECT c, p, CAST(sum(x) AS HUGEINT) AS s, count(*) AS n FROM x JOIN a{i} USING (r) GROUP BY c, p)")
            parts.append(f"c{i + 1} AS MATERIALIZED (SELECT o.c, o.p, coalesce(CAST((s - ((s % n) + n) % n) // n AS BIGINT), o.m) AS m FROM c{i} o LEFT JOIN s{i} ON o.c = s{i}.c AND o.p = s{i}.p)")
    return f"""WITH {", ".join(parts)},
h AS (SELECT c, sha256(string_agg(CAST(m AS VARCHAR), ',' ORDER BY p)) AS centroid_sha256 FROM c{ROUNDS} GROUP BY c)
SELECT vec_id, a.c AS cluster, a.d AS distance, CAST(sum(a.d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia,
  CAST(sum(a.d) OVER () AS BIGINT) AS inertia, centroid_sha256
FROM a{ROUNDS} a JOIN v USING (r) JOIN h ON a.c = h.c"""


ORACLE = _oracle()
