import duckdb
import numpy as np
import pytest

from urbanloom.llm import clustering as cl


def plain(x, c, rounds):
    x, c = np.array(x, object), np.array(c, object)
    for at in range(rounds + 1):
        d = np.array([[sum((a - b) ** 2 for a, b in zip(v, m, strict=True)) for m in c] for v in x], object)
        own = np.array([min(range(len(c)), key=lambda j: (row[j], j)) for row in d])
        if at < rounds:
            c = np.array([[int(x[own == j, p].sum()) // int((own == j).sum()) for p in range(x.shape[1])] if (own == j).any() else list(c[j]) for j in range(len(c))], object)
    return own.tolist(), [int(row[j]) for row, j in zip(d, own, strict=True)], c.tolist()


@pytest.mark.parametrize("spread", [2, 300, cl.LARGEST])
def test_against_plain_kmeans(spark, spread):
    rng = np.random.default_rng(4)
    x = np.clip(rng.integers(-spread, spread, (240, 5)) // 2 + rng.integers(-2, 3, (240, 1)) * (spread // 4), -spread, spread).tolist()
    x += [x[0]] * 40
    df = spark.createDataFrame(list(enumerate(x)), "vec_id long, v array<long>")
    start = np.array([*x[:6], x[0]], "i8")  # one start twice: its cluster stays empty
    got, centroids, made = cl.ball_kmeans(df, start, 6)
    own, dist, c = plain(x, start.tolist(), 6)
    assert [tuple(r) for r in got.orderBy("vec_id").collect()] == list(zip(range(len(x)), own, dist, strict=True))
    assert centroids.tolist() == c


def test_core_and_annuli_save_distances(spark):
    rng = np.random.default_rng(2)
    x = (rng.integers(0, 40, (600, 3)) + 1000 * rng.integers(0, 6, (600, 1))).tolist()
    _, _, made = cl.ball_kmeans(spark.createDataFrame(list(enumerate(x)), "vec_id long, v array<long>"), np.array([[1000 * i] * 3 for i in range(6)], "i8"), 8)
    assert made[-1] == 600  # all in stable cores: one distance each
    assert len(made) < 9  # no centroid moved any more


def test_sql(spark):
    con = duckdb.connect()
    con.execute("CREATE VIEW embeddings AS SELECT * FROM '/root/testdata/sf0.001/embeddings.parquet'")
    columns = ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    want = sorted(con.execute(f"SELECT {', '.join(columns)} FROM ({cl.ORACLE})").fetchall())
    got = sorted(tuple(r) for r in cl.op13_clusters(spark, "/root/testdata/sf0.001").select(*columns).collect())
    assert got == want and len({r[1] for r in got}) > 3


def test_bad_vectors_and_few_rows(spark, tmp_path):
    nan, inf, good = float("nan"), float("inf"), [0.5] * 63
    rows = [(0, [*good, 1.0]), (1, None), (2, [*good, nan]), (3, [*good, None]), (4, [*good, -inf]), (5, []), (6, good), (None, [*good, -0.0001]), (0, [*good, 1.0])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, cluster string")
    df.write.parquet(f"{tmp_path}/some/embeddings.parquet")
    got = cl.op13_clusters(spark, f"{tmp_path}/some").collect()
    assert sorted((r.vec_id is None, r.vec_id or 0) for r in got) == [(False, 0), (False, 0), (True, 0)]
    assert {r.inertia for r in got} == {0} and len({r.cluster for r in got}) == 2
    df.limit(0).write.parquet(f"{tmp_path}/none/embeddings.parquet")
    assert cl.op13_clusters(spark, f"{tmp_path}/none").count() == 0
    with pytest.raises(Exception, match="beyond"):
        cl.quantised(spark.createDataFrame([(1, [1e9] * 64)], "vec_id long, embedding array<float>")).collect()
