import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from urbanloom.operators import environment, screening

RING = "array<struct<x: double, y: double>>"
BUILDINGS = f"building_id long, ext {RING}, holes array<{RING}>, height double"


def box(x, y, w, h):
    return [(float(a), float(b)) for a, b in ((x, y), (x + w, y), (x + w, y + h), (x, y + h))]


def side(a, b, c):
    return np.sign((b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0]))


def meets(a, b, rings):
    pairs = [(p, q) for r in rings for p, q in zip(r, r[1:] + r[:1], strict=True)]
    for p, q in pairs:
        overlap = all(min(a[k], b[k]) <= max(p[k], q[k]) and min(p[k], q[k]) <= max(a[k], b[k]) for k in (0, 1))
        if overlap and side(a, b, p) * side(a, b, q) <= 0 and side(p, q, a) * side(p, q, b) <= 0:
            return True
    return sum((p[1] > a[1]) != (q[1] > a[1]) and a[0] < p[0] + (a[1] - p[1]) * (q[0] - p[0]) / (q[1] - p[1]) for p, q in pairs) % 2 == 1


@pytest.mark.parametrize("cell", [50.0, 7.0])
def test_crossings_against_all_pairs(spark, cell):
    rng = np.random.default_rng(9)
    houses = [(i, [tuple(map(float, p)) for p in rng.integers(0, 30, (int(rng.integers(3, 6)), 2)) + rng.integers(0, 200, 2)], None, 5.0) for i in range(40)]
    houses.append((90, box(20, 20, 60, 60), [box(30, 30, 40, 40)], 5.0))
    sights = [(i, *map(float, rng.integers(0, 220, 2)), *map(float, rng.integers(0, 220, 2))) for i in range(120)]
    sights += [(200, 35.0, 35.0, 60.0, 60.0), (201, 22.0, 22.0, 23.0, 23.0), (202, 5.0, 5.0, 5.0, 5.0), (203, 20.0, 0.0, 20.0, 300.0), (204, None, 1.0, 2.0, 3.0), (205, 10.0, 20.0, 20.0, 20.0)]
    df = spark.createDataFrame(sights, "sight_id long, ax double, ay double, bx double, by double")
    got = [tuple(r) for r in screening.crossings(df, spark.createDataFrame(houses, BUILDINGS), cell).collect()]
    want = {(s[0], h[0]) for s in sights if s[1] is not None for h in houses if meets(s[1:3], s[3:], [h[1], *(h[2] or [])])}
    assert len(got) == len(set(got)) and set(got) == want
    assert (201, 90) in want and (200, 90) not in want and (205, 90) in want


def test_screening_takes_off_the_insertion_loss(spark):
    at = spark.createDataFrame([(1, 100.0, 0.0), (2, 0.0, 100.0), (3, 900.0, 0.0)], "id long, x double, y double")
    source = spark.createDataFrame([(0.0, 0.0, 80.0)], "bx double, by double, level double")
    houses = spark.createDataFrame([(1, box(40, -5, 10, 10), None, 9.0)], BUILDINGS)
    free = {r.id: r.db for r in environment.noise_at(at, source, 300.0).collect()}
    got = {r.id: r.db for r in screening.noise_screened(at, source, houses, 10.0, 300.0).collect()}
    assert free[1] - got[1] == pytest.approx(10.0) and got[2] == pytest.approx(free[2]) and got[3] == -1
    two = spark.createDataFrame([(1, box(40, -5, 10, 10), None, 9.0), (2, box(60, -5, 10, 10), None, 9.0)], BUILDINGS)
    again = {r.id: r.db for r in screening.noise_screened(at, source, two, 10.0, 300.0).collect()}
    assert again[1] == pytest.approx(got[1])  # any building hides, more hide no more


def test_walls_on_both_sides(spark):
    road = spark.createDataFrame([(1, [(0.0, 0.0), (300.0, 300.0)])], f"line_id long, pts {RING}")
    turn = lambda ring: [((x - y) / math.sqrt(2), (x + y) / math.sqrt(2)) for x, y in ring]
    houses = [(1, turn(box(90, 10, 20, 5)), None, 12.0), (2, turn(box(90, -20, 20, 5)), None, 6.0), (3, turn(box(190, 10, 20, 5)), None, 12.0), (4, turn(box(90, 20, 20, 5)), None, 0.2)]
    points = [(i, *turn([p])[0]) for i, p in enumerate([(100.0, 3.0), (200.0, 3.0), (100.0, 50.0), (300.0, 0.0)])]
    found = screening.canyon_factors(spark.createDataFrame(points, "id long, x double, y double"), road, spark.createDataFrame(houses, BUILDINGS), 20.0, 30.0, 15.0)
    got = {r.id: r.factor for r in found.collect()}
    assert got == pytest.approx({0: 1 + ((12 + 1) / 2 + 6) / 2 / 15, 1: 1.0, 2: 1.0, 3: 1.0})


def test_grid(spark):
    grid = screening.grid_receivers(spark.range(1), 100.0, 50.0, 3, 2, 10.0)
    assert [(r.row, r.col, r.x, r.y) for r in grid.orderBy("id").collect()] == [(0, 0, 105.0, 45.0), (0, 1, 115.0, 45.0), (0, 2, 125.0, 45.0), (1, 0, 105.0, 35.0), (1, 1, 115.0, 35.0), (1, 2, 125.0, 35.0)]
    source = spark.createDataFrame([(105.0, 45.0, 70.0)], "bx double, by double, level double")
    empty = spark.createDataFrame([], BUILDINGS)
    assert screening.noise_screened(grid, source, empty, nearest=5.0).where(F.col("id") == 0).first().db == pytest.approx(70 - 20 * math.log10(5))


def test_met_buildings_are_counted_within_tasks_as_pairs_say(spark):
    rng = np.random.default_rng(5)
    houses = [(i, [(x, y), (x + w, y), (x + w, y + h), (x, y + h)], [[(x + 1.0, y + 1.0), (x + w - 1, y + 1.0), (x + w - 1, y + h - 1), (x + 1.0, y + h - 1)]] if i % 3 == 0 else None, float(i)) for i, (x, y, w, h) in enumerate(rng.integers(4, 40, (30, 4)).astype(float).tolist())]
    buildings = spark.createDataFrame(houses, "building_id long, ext array<struct<x: double, y: double>>, holes array<array<struct<x: double, y: double>>>, height double")
    lines = [(i, *p) for i, p in enumerate(rng.integers(-10, 60, (200, 4)).astype(float).tolist())] + [(900, 10.0, 10.0, 10.0, 10.0), (901, None, 1.0, 1.0, 1.0)]
    sights = spark.createDataFrame(lines, "sight_id long, ax double, ay double, bx double, by double")
    want: dict[int, list[int]] = {}
    for r in screening.crossings(sights, buildings, 11.0).collect():
        want.setdefault(r.sight_id, []).append(r.building_id)
    for pairs in (1, 200_000):
        screening.PAIRS, old = pairs, screening.PAIRS
        got = {r.sight_id: (r.n, r.total) for r in screening.met_by_sights(sights, buildings, F.col("height"), 11.0).collect()}
        screening.PAIRS = old
        assert got == {k: (len(v), float(sum(v))) for k, v in want.items()}


def test_places_in_buildings_make_no_pairs(spark, monkeypatch):
    seen, real = [], environment.within
    monkeypatch.setattr(environment, "within", lambda a, b, r: seen.append((a.count(), b.count())) or real(a, b, r))
    houses = spark.createDataFrame([(1, box(0, 0, 50, 50), None, 3.0)], BUILDINGS)
    at = spark.range(100).selectExpr("id", "id % 10 * 4D + 1.5 AS x", "id div 10 * 4D + 1.5 AS y")
    loud = spark.createDataFrame([(60.0, 10.0, 70.0), (20.0, 20.0, 70.0)], "bx double, by double, level double")
    got = {r.id: r.db for r in screening.noise_screened(at, loud, houses, 10.0, 100.0).collect()}
    assert seen == [(0, 1)]
    d = [max(1.0, math.hypot(1.5 - x, 1.5 - y)) for x, y in ((60, 10), (20, 20))]
    assert got[0] == pytest.approx(10 * math.log10(sum(10**6 / v**2 for v in d)))


def test_rows_that_meet_in_squares_are_not_broadcast(spark, monkeypatch):
    houses = spark.createDataFrame([(1, box(0, 0, 50, 50), None, 3.0)], BUILDINGS)
    sights = spark.range(100).selectExpr("id AS sight_id", "id * 1D AS ax", "0D AS ay", "id * 1D AS bx", "30D AS by")
    for squares, hint in ((1000, "rightHint=(strategy=broadcast)"), (0, "rightHint=(strategy=merge)")):
        monkeypatch.setattr(environment, "SQUARES", squares)
        met = screening.met_by_sights(sights, houses, F.col("height"))
        joins = [line for line in met._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join " in line]
        assert len(joins) == 2 and all(hint in line for line in joins)
        assert met.count() == 51
