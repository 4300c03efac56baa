"""Sun and sky over tiles: the same as by joins, across borders of tiles and around missing cells, in a plan of one pass."""

import calendar
import datetime
import math

import numpy as np
import pytest

from urbanloom.operators import raster, sight
from urbanloom.plans import field_queries


@pytest.fixture(scope="module")
def dsm(spark):
    rng = np.random.default_rng(8)
    rows = [(r, c, float(v)) for (r, c), v in np.ndenumerate(rng.uniform(0, 30, (23, 17))) if rng.random() > 0.1]
    return spark.createDataFrame([(r - 9, c - 6, v) for r, c, v in rows], "row int, col int, value double").cache()


@pytest.mark.parametrize(("tile", "halo"), [(5, 1024), (128, 1024), (5, 1)])
def test_tiles_and_joins_agree(spark, dsm, monkeypatch, tile, halo):
    monkeypatch.setattr(raster, "TILE", tile)
    monkeypatch.setattr(raster, "HALO", halo)
    suns = [(20.0, 75.0, 1.0), (50.0, 180.0, 2.5), (8.0, 301.0, 4.0)]
    want = {}
    for up, way, weight in suns:
        for r in raster.shadow(dsm, up, way, 2.0, 14.0).collect():
            want[r.row, r.col] = want.get((r.row, r.col), 0.0) + weight * (1 - r.shadow)
    got = {(r.row, r.col): r.lit for r in raster.sunlit(dsm, suns, 2.0, 14.0).collect()}
    assert got == pytest.approx(want)
    part = {(r.row, r.col): 0.0 for r in dsm.collect()}
    for k in range(8):
        for r in raster.horizon(dsm, 45.0 * k, 2.0, 12.0).collect():
            s = max(r.slope or 0.0, 0.0)
            part[r.row, r.col] += s * s / (1 + s * s) / 8
    sky = {(r.row, r.col): r.svf for r in raster.sky_view_factor(dsm, 2.0, 8, 12.0).collect()}
    assert sky == pytest.approx({k: 1 - v for k, v in part.items()})


def test_plans_do_not_grow_with_the_suns(dsm):
    day = sight.irradiation(dsm, 2.0, datetime.date(2026, 6, 21), 2.0, 45.0, 9.0, 60.0, None, 12.0)
    year = sight.annual_irradiation(dsm, 2.0, 2026, 1.0, 45.0, 9.0, 60.0, None, 12.0)
    size = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("\n")
    assert size(year) == size(day) < 30


def _plain(cells, suns, pixel):
    """Weights of the suns that each cell sees, by whole rays."""
    lit = dict.fromkeys(cells, 0.0)
    for up, way, weight in suns:
        slope, rays = math.tan(math.radians(up)), {}
        for i in range(1, 80):
            rays.setdefault((round(-i * math.cos(math.radians(way))), round(i * math.sin(math.radians(way)))), i * pixel * slope)
        for (r, c), z in cells.items():
            hidden = any(cells.get((r + a, c + b), -1e9) - drop > z + 0.01 for (a, b), drop in rays.items())
            lit[r, c] += 0.0 if hidden else weight
    return lit


def test_queries_follow_shadows_to_their_end(spark, tmp_path):
    # Two towers shade cells far beyond ten cells.
    spark.createDataFrame([(k, 4000 if k in (420, 33) else 1 + k % 5) for k in range(12 * 50)], "p_partkey long, p_size int").coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    cells = {(r.row, r.col): r.value for r in field_queries._dem(spark, str(tmp_path)).collect()}
    days = [(datetime.date(2026, m, sight.REPRESENTATIVE_DAYS[m - 1]), calendar.monthrange(2026, m)[1]) for m in range(1, 13)]
    for query, zone, minutes, of in ((field_queries.solar_irradiation, 2.0, 30.0, [(datetime.date(2026, 6, 21), 1)]), (field_queries.annual_solar, 1.0, 60.0, days)):
        suns, diffuse = [], 0.0
        for date, times in of:
            own, sky = sight._day(date, zone, 45.0, 9.0, minutes)
            suns += [(up, way, energy * times) for up, way, energy in own]
            diffuse += sky * times
        want = {k: v + diffuse for k, v in _plain(cells, suns, 2.0).items()}
        assert {(r.row, r.col): r.kwh_m2 for r in query(spark, str(tmp_path)).collect()} == pytest.approx(want, abs=1e-5)
