"""Hand-computed cases of land-use allocation."""

import numpy as np
import pytest

from urbanloom.functions import text_params
from urbanloom.operators import allocation, contiguity


def parcels(spark, areas, suits, locks=None):
    rows = [(i, float(a), *map(float, s), (locks or [None] * len(areas))[i]) for i, (a, s) in enumerate(zip(areas, suits, strict=True))]
    return spark.createDataFrame(rows, "id long, area double, suit_a double, suit_b double, lock string")


def test_targets(spark):
    df = parcels(spark, [100] * 4, [(9, 1), (8, 2), (3, 4), (2, 9)])
    got = {r.id: r.alloc_use for r in allocation.land_allocation(df, {"a": 200.0, "b": 100.0}).collect()}
    assert got == {0: "a", 1: "a", 2: None, 3: "b"}


def test_exchange_escapes_greedy_trap(spark):
    df = parcels(spark, [10, 10], [(10, 8), (9, 1)])
    rows = allocation.land_allocation(df, {"a": 10.0, "b": 10.0}).collect()
    assert {r.id: r.alloc_use for r in rows} == {0: "b", 1: "a"} and sum(r.alloc_suit * r.alloc_area for r in rows) == 170


def test_locks_and_front(spark):
    df = parcels(spark, [10] * 6, [(5, 4), (4, 5), (5, 4), (4, 5), (5, 4), (4, 5)], ["b", None, None, None, None, None])
    borders = spark.createDataFrame([(i, i + 1, 10.0) for i in range(5)], "a long, b long, length double")
    assert {r.id: r.alloc_use for r in allocation.land_allocation(df, {"a": 30.0, "b": 30.0}, borders).collect()}[0] == "b"
    rows = sorted(allocation.pareto_allocation(df, {"a": 30.0, "b": 30.0}, borders, 4).collect(), key=lambda r: r.point)
    assert sum(r.knee for r in rows) == 1 and rows[-1].compactness >= rows[0].compactness
    assert max(rows, key=lambda r: r.suitability).on_front == 1


def pieces(use, borders):
    """Connected parts of each use."""
    out = {}
    for u in set(use.values()) - {None}:
        left, n = {p for p, x in use.items() if x == u}, 0
        while left:
            n, todo = n + 1, [left.pop()]
            while todo:
                p = todo.pop()
                for a, b in borders:
                    q = b if a == p else a if b == p else None
                    if q in left:
                        left.remove(q)
                        todo.append(q)
        out[u] = n
    return out


def test_each_use_is_one_region(spark):
    """Corners that suit a best are far apart: without the rule a is split, with it one region that meets its target."""
    suits = [(10, 1) if i in (0, 15) else (1, 5) for i in range(16)]
    grid = [(4 * r + c, 4 * r + c + d) for r in range(4) for c in range(4) for d in (1, 4) if (d == 4 and r < 3) or (d == 1 and c < 3)]
    borders = spark.createDataFrame([(a, b, 1.0) for a, b in grid], "a long, b long, length double")
    df = parcels(spark, [10] * 16, suits)
    targets = text_params.parse_targets("a=20, b=140")
    soft = {r.id: r.alloc_use for r in allocation.land_allocation(df, targets).collect()}
    assert pieces(soft, grid)["a"] == 2
    hard = contiguity.contiguous_allocation(df, targets, borders).collect()
    assert pieces({r.id: r.alloc_use for r in hard}, grid) == {"a": 1, "b": 1} and {r.whole for r in hard} == {1}
    assert sum(r.alloc_area for r in hard if r.alloc_use == "a") == 20 and sum(r.alloc_area for r in hard if r.alloc_use == "b") == 140


def test_study_areas_apart_and_fallback(spark):
    """Random grids in two study areas, a third whose parcels don't hang together falls back to the plan without the rule."""
    rng = np.random.default_rng(2)
    rows, links = [], []
    for s in range(3):
        for i in range(36):
            rows.append((100 * s + i, f"s{s}", 10.0, float(rng.integers(1, 9)), float(rng.integers(1, 9)), "a" if (s, i) == (0, 7) else None))
            links += [(100 * s + i, 100 * s + i + d) for d in (1, 6) if s < 2 and ((d == 6 and i < 30) or (d == 1 and i % 6 < 5))]
    df = spark.createDataFrame(rows, "id long, study string, area double, suit_a double, suit_b double, lock string")
    borders = spark.createDataFrame([(a, b, 2.0) for a, b in links], "a long, b long, length double")
    got = contiguity.contiguous_allocation(df, {"a": 120.0, "b": 90.0}, borders, 1.0, text_params.parse_compat("a|a=1, b|b=1, a|b=-0.5"), "study").collect()
    for s in range(3):
        use = {r.id: r.alloc_use for r in got if r.id // 100 == s}
        assert sum(u == "a" for u in use.values()) == 12 and sum(u == "b" for u in use.values()) == 9
        assert {r.whole for r in got if r.id // 100 == s} == {int(s < 2)}
        assert s == 2 or pieces(use, links) == {"a": 1, "b": 1}
    assert {r.id: r.alloc_use for r in got}[7] == "a"
    with pytest.raises(ValueError, match="area"):
        text_params.parse_targets("a=x")
    with pytest.raises(ValueError, match="pair"):
        text_params.parse_compat("a=1")
