"""Sums over points within a distance: against all pairs, also where a crowded square is dealt over several calls."""

import numpy as np
import pandas as pd
import pytest

from urbanloom.operators import environment as env


@pytest.mark.parametrize("each", [7, 1000])
def test_sums_and_mix_against_all_pairs(spark, monkeypatch, each):
    monkeypatch.setattr(env, "RECEIVERS", each)
    monkeypatch.setattr(env, "SOURCES", each)
    rng = np.random.default_rng(4)
    # Most stand in one square of the radius, some far away, at negative places too.
    a, b = (np.concatenate([rng.uniform(0, 30, (60, 2)), rng.uniform(-500, 500, (20, 2))]) for _ in "ab")
    kinds = [["x", "y", None][k] for k in rng.integers(0, 3, 80)]
    at = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(a)] + [(99, None, 1.0)], "id long, x double, y double")
    points = spark.createDataFrame([(*map(float, p), float(k), kinds[k]) for k, p in enumerate(b)], "bx double, by double, weight double, category string")
    d = np.hypot(a[:, None, 0] - b[None, :, 0], a[:, None, 1] - b[None, :, 1])
    want = np.where(d <= 25, (1 - (d / 25) ** 2) ** 2 * np.arange(80), 0).sum(axis=1)
    got = {r.id: r.density for r in env.kernel_density(at, points, 25.0).collect()}
    assert got.pop(99) == 0 and np.allclose([got[i] for i in range(80)], want, atol=1e-9)
    mix = {r.id: r.mix_ent for r in env.entropy_mix(at, points, 25.0).collect()}
    for i in range(80):
        n = pd.Series([str(kinds[k]) for k in np.flatnonzero(d[i] <= 25)], dtype=object).value_counts().to_numpy(float)
        p = n / n.sum() if n.size else n
        assert mix[i] == pytest.approx(-(p * np.log(p)).sum() / np.log(n.size) if n.size > 1 else 0.0, abs=1e-9)


def test_a_call_holds_few_rows_of_a_crowded_square(spark, monkeypatch):
    monkeypatch.setattr(env, "RECEIVERS", 50)
    monkeypatch.setattr(env, "SOURCES", 70)
    at = spark.range(400).selectExpr("id", "id % 10 / 10D AS x", "id % 7 / 10D AS y")
    b = at.selectExpr("x AS bx", "y AS by")
    held = env.met_within(at, b, 5.0, lambda p, q: pd.DataFrame({"a": [len(p)], "b": [len(q)]}), "a long, b long").collect()
    assert sum(r.a * r.b for r in held) >= 400 * 400 and max(r.a for r in held) <= 100 and max(r.b for r in held) <= 140
