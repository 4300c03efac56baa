"""Sight and sun over rasters: viewsheds, isovists, landmark exposure, irradiation; and the filling of pits.

Rays from one place need its surroundings in order, so they run in kernels. Views of a bounded radius go over tiles with the
cells around them; for others the raster (row, col, value) goes to every task as an array of at most CELLS cells, and places
are dealt over tasks. Results are cell tables again.
"""

from __future__ import annotations

import calendar
import datetime
import functools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from urbanloom.operators import raster

CELLS = 25_000_000


def as_array(cells: DataFrame) -> tuple[np.ndarray, int, int]:
    """(array with nan where no cell is, first row, first column) of at most CELLS cells; an error beyond."""
    b = cells.agg(F.min("row"), F.max("row"), F.min("col"), F.max("col")).first()
    if b[0] is None:
        return np.full((0, 0), np.nan), 0, 0
    shape = (b[1] - b[0] + 1, b[3] - b[2] + 1)
    if shape[0] * shape[1] > CELLS:
        raise ValueError(f"a raster of {shape[0]} x {shape[1]} cells is too large to be sent to every task")
    rows = cells.select("row", "col", F.col("value").cast("double")).toPandas()
    out = np.full(shape, np.nan)
    out[rows["row"] - b[0], rows["col"] - b[2]] = rows["value"]
    return out, b[0], b[2]


def _directions(n: int) -> np.ndarray:
    a = 2 * math.pi * np.arange(n) / n
    return np.stack([-np.cos(a), np.sin(a)], axis=1)


def visible(z: np.ndarray, at: tuple[int, int], pixel: float, eye: float, target: float, radius: float, rays: int, base: tuple[int, int] = (0, 0)) -> np.ndarray:
    """Which cells are seen: along each ray, in half pixels, a cell whose slope is not below all slopes before it.

    base: the array's first row and column in its raster, where halves are rounded to even places."""
    seen = np.zeros(z.shape, bool)
    if not (0 <= at[0] < z.shape[0] and 0 <= at[1] < z.shape[1]) or np.isnan(z[at]):
        return seen
    seen[at] = True
    r, c = (_steps(at[k] + base[k], k, pixel, radius, rays).astype(int) + at[k] for k in (0, 1))
    inside = (r >= 0) & (r < z.shape[0]) & (c >= 0) & (c < z.shape[1]) & ((r != at[0]) | (c != at[1]))
    ground = np.where(inside, z[np.clip(r, 0, z.shape[0] - 1), np.clip(c, 0, z.shape[1] - 1)], np.nan)
    d = pixel * np.hypot(r - at[0], c - at[1])
    with np.errstate(divide="ignore", invalid="ignore"):
        rise, top = (ground - z[at] - eye) / d, (ground + target - z[at] - eye) / d
    rise = np.where(np.isnan(rise), -np.inf, rise)
    before = np.concatenate([np.full((rays, 1), -np.inf), np.maximum.accumulate(rise, axis=1)[:, :-1]], axis=1)
    clear = inside & ~np.isnan(ground) & (top >= before - 1e-12)
    seen[r[clear], c[clear]] = True
    return seen


def _steps(place: int, axis: int, pixel: float, radius: float, rays: int) -> np.ndarray:
    """How far from a row (axis 0) or column (axis 1) `place` of the raster rays (first axis) are, in half pixels."""
    far = np.arange(pixel / 2, radius + pixel / 2, pixel / 2)
    return (np.rint(place + far[None, :] / pixel * _directions(rays)[:, axis : axis + 1]) - place).astype("i4")


@functools.lru_cache(maxsize=512)
def _way(place: int, axis: int, pixel: float, radius: float, rays: int) -> bytes:
    return _steps(place, axis, pixel, radius, rays).tobytes()


@functools.lru_cache(maxsize=64)
def _tree(rows: bytes, cols: bytes, rays: int) -> tuple[list[tuple[int, int]], list[tuple[int, int, int]]]:
    """(offsets of cells, steps): rays that pass the same cells so far share their steps. A step is (cell, the depth it
    stands at, whether rays part behind it), each ray's steps after those that it shares."""
    r, c = (np.frombuffer(x, "i4").reshape(rays, -1) for x in (rows, cols))
    root: dict = {}
    for way in zip(r.tolist(), c.tolist(), strict=True):
        at, last = root, (0, 0)
        for cell in zip(*way, strict=True):
            # A cell that a ray stays in counts once: its own slope does not hide it.
            if cell != last:
                at, last = at.setdefault(cell, {}), cell
    cells: dict[tuple[int, int], int] = {}
    steps, todo = [], [(cell, 1, more) for cell, more in root.items()]
    while todo:
        cell, depth, more = todo.pop()
        steps.append((cells.setdefault(cell, len(cells)), depth, len(more)))
        todo += [(k, depth + 1, v) for k, v in more.items()]
    return list(cells), steps


#: Observers times cells around them, about, that are looked at as one array.
SIGHTS = 1 << 20


def _seen(z: np.ndarray, rows: np.ndarray, cols: np.ndarray, times: np.ndarray, pixel: float, eye: float, target: float, radius: float, rays: int, base: tuple[int, int]) -> np.ndarray:
    """How many observers (distinct rows and cols of z, each as often as times says) see each cell, as visible() has it."""
    total = np.zeros(z.shape, "i8")
    kept = ~np.isnan(z[rows, cols])
    rows, cols, times = rows[kept], cols[kept], times[kept]
    ways, kinds = [], []
    for axis, own in enumerate((rows, cols)):
        places, back = np.unique(own, return_inverse=True)
        named: dict[bytes, int] = {}
        kinds.append(np.array([named.setdefault(_way(v + base[axis], axis, pixel, radius, rays), len(named)) for v in places.tolist()], "i8")[back])
        ways.append(list(named))
    kind = kinds[0] * max(1, len(ways[1])) + kinds[1]
    for one in np.unique(kind).tolist():
        own = np.flatnonzero(kind == one)
        r, c = rows[own], cols[own]
        cells, steps = _tree(ways[0][one // len(ways[1])], ways[1][one % len(ways[1])], rays)
        count = max(1, SIGHTS // max(1, len(cells)))
        for k in range(0, len(own), count):
            _look(total, z, r[k : k + count], c[k : k + count], times[own[k : k + count]], cells, steps, pixel, eye, target)
    return total


def _look(total: np.ndarray, z: np.ndarray, rows: np.ndarray, cols: np.ndarray, times: np.ndarray, cells: list[tuple[int, int]], steps: list[tuple[int, int, int]], pixel: float, eye: float, target: float) -> None:
    """Adds to total what observers see whose rays pass the same cells around them."""
    own = z[rows, cols]
    off = np.array(cells, "i8").reshape(-1, 2)
    y, x = rows[None, :] + off[:, :1], cols[None, :] + off[:, 1:]
    inside = (y >= 0) & (y < z.shape[0]) & (x >= 0) & (x < z.shape[1])
    ground = np.where(inside, z[np.clip(y, 0, z.shape[0] - 1), np.clip(x, 0, z.shape[1] - 1)], np.nan)
    d = pixel * np.hypot(off[:, 0], off[:, 1])[:, None]
    rise, top = (ground - own - eye) / d, (ground + target - own - eye) / d
    known = ~np.isnan(ground)
    rise[~known] = -np.inf
    clear = np.zeros(ground.shape, bool)
    deepest = max((depth for _, depth, _ in steps), default=0)
    before = np.full((deepest + 1, len(rows)), -np.inf)
    high, sees = np.empty(len(rows)), np.empty(len(rows), bool)
    for cell, depth, more in steps:
        np.subtract(before[depth - 1], 1e-12, out=high)
        np.greater_equal(top[cell], high, out=sees)
        np.logical_or(clear[cell], sees, out=clear[cell])
        if more:
            np.maximum(before[depth - 1], rise[cell], out=before[depth])
    clear &= known
    np.add.at(total, (rows, cols), times)
    at, who = np.nonzero(clear)
    place = y[at, who] * z.shape[1] + x[at, who]
    total += np.bincount(place, times[who], total.size).astype("i8").reshape(total.shape)


def viewshed(dsm: DataFrame, observers: DataFrame, pixel: float, eye: float = 1.6, target: float = 0.0, radius: float | None = None, rays: int = 720) -> DataFrame:
    """row, col, seen: how many observers (row, col) see each cell of the raster; observers outside see nothing.

    Observers look around in tiles, which are dealt over tasks with the cells that the radius reaches; beyond
    raster.HALO cells each task has the whole raster.
    """
    far = int(math.ceil(radius / pixel)) + 1 if radius else None
    if far is None or far > raster.HALO:
        return _viewshed_of_all(dsm, observers, pixel, eye, target, radius, rays)
    low = dsm.agg(F.min("row"), F.min("col")).first()
    side = max(raster.TILE, far)
    tiles = lambda c: F.explode(F.sequence(F.floor((F.col(c) - far) / side).cast("int"), F.floor((F.col(c) + far) / side).cast("int")))
    sent = dsm.select("row", "col", F.col("value").cast("double").alias("value"), F.lit(0).cast("long").alias("n")).withColumn("_i", tiles("row")).withColumn("_j", tiles("col"))
    eyes = observers.groupBy("row", "col").agg(F.count(F.lit(1)).alias("n")).where("row is not null and col is not null")
    eyes = eyes.select(F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"), F.lit(None).cast("double").alias("value"), "n", F.floor(F.col("row") / side).cast("int").alias("_i"), F.floor(F.col("col") / side).cast("int").alias("_j"))
    seats = eyes.select("_i", "_j").distinct()

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        base = [int(k) * side - far for k in key]
        r, c = (pdf[name].to_numpy("i8") - b for name, b in zip(("row", "col"), base, strict=True))
        n = pdf["n"].to_numpy("i8")
        held = np.full((side + 2 * far, side + 2 * far), np.nan)
        cell, eye_ = n == 0, n > 0
        held[r[cell], c[cell]] = pdf["value"].to_numpy("f8")[cell]
        total = _seen(held, r[eye_], c[eye_], n[eye_], pixel, eye, target, radius, rays, (base[0] - low[0], base[1] - low[1]))
        at = np.nonzero(total)
        return pd.DataFrame({"row": at[0] + base[0], "col": at[1] + base[1], "n": total[at]})

    every = sent.join(seats, ["_i", "_j"], "left_semi").unionByName(eyes)
    parts = every.groupBy("_i", "_j").applyInPandas(run, "row int, col int, n long")
    return _sums(dsm, parts)


def _sums(dsm: DataFrame, parts: DataFrame) -> DataFrame:
    sums = parts.groupBy("row", "col").agg(F.sum("n").alias("seen"))
    return dsm.select("row", "col").join(sums, ["row", "col"], "left").select("row", "col", F.coalesce("seen", F.lit(0)).alias("seen"))


def _viewshed_of_all(dsm: DataFrame, observers: DataFrame, pixel: float, eye: float, target: float, radius: float | None, rays: int) -> DataFrame:
    z, r0, c0 = as_array(dsm)
    spark = dsm.sparkSession
    shared = spark.sparkContext.broadcast(z)
    reach = radius or pixel * math.hypot(*z.shape)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(shared.value.shape, "i8")
        for pdf in batches:
            for r, c in zip(pdf["row"] - r0, pdf["col"] - c0, strict=True):
                total += visible(shared.value, (int(r), int(c)), pixel, eye, target, reach, rays)
        at = np.nonzero(total)
        yield pd.DataFrame({"row": at[0] + r0, "col": at[1] + c0, "n": total[at]})

    return _sums(dsm, observers.select("row", "col").repartition(spark.sparkContext.defaultParallelism).mapInPandas(run, "row int, col int, n long"))


def visual_exposure(dsm: DataFrame, landmark: DataFrame, pixel: float, extra: float = 0.0, eye: float = 1.6, radius: float | None = None) -> DataFrame:
    """row, col, seen: how many points (row, col) of a landmark an eye at each cell sees; sight works both ways."""
    return viewshed(dsm, landmark, pixel, extra, eye, radius, 360)


def isovists(blocked: DataFrame, points: DataFrame, pixel: float, rays: int = 180, reach: float = 200.0, shape: tuple[int, int] | None = None) -> DataFrame:
    """row, col, iso_area, iso_perim, min_rad, max_rad, mean_rad, circular, occlus of points (row, col) among blocked cells.

    A ray goes on in half pixels until it meets a blocked cell, the raster's edge or the reach. circular is
    4 pi area / perimeter squared, occlus the share of rays that nothing stops.
    """
    b, r0, c0 = as_array(blocked.select("row", "col", F.lit(1.0).alias("value")))
    if shape is not None:
        full = np.full(shape, np.nan)
        full[r0 : r0 + b.shape[0], c0 : c0 + b.shape[1]] = b
        b, r0, c0 = full, 0, 0
    shared = blocked.sparkSession.sparkContext.broadcast(~np.isnan(b))
    steps = np.arange(pixel / 2, reach + pixel / 4, pixel / 2)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        mask, way = shared.value, _directions(rays)
        for pdf in batches:
            out = []
            for r, c in zip(pdf["row"], pdf["col"], strict=True):
                y = np.rint(r - r0 + steps[None, :] / pixel * way[:, :1]).astype(int)
                x = np.rint(c - c0 + steps[None, :] / pixel * way[:, 1:]).astype(int)
                outside = (y < 0) | (y >= mask.shape[0]) | (x < 0) | (x >= mask.shape[1])
                stop = outside | mask[np.clip(y, 0, mask.shape[0] - 1), np.clip(x, 0, mask.shape[1] - 1)]
                open_ = ~stop.any(axis=1)
                rad = np.where(open_, reach, steps[np.argmax(stop, axis=1)])
                nxt, a = np.roll(rad, -1), 2 * math.pi / rays
                area = float((rad * nxt).sum() * math.sin(a) / 2)
                perim = float(np.sqrt(rad**2 + nxt**2 - 2 * rad * nxt * math.cos(a)).sum())
                out.append((r, c, area, perim, rad.min(), rad.max(), rad.mean(), 4 * math.pi * area / perim**2 if perim > 0 else 0.0, open_.mean()))
            yield pd.DataFrame(out, columns=["row", "col", "iso_area", "iso_perim", "min_rad", "max_rad", "mean_rad", "circular", "occlus"])

    return points.select("row", "col").repartition(blocked.sparkSession.sparkContext.defaultParallelism).mapInPandas(run, "row int, col int, iso_area double, iso_perim double, min_rad double, max_rad double, mean_rad double, circular double, occlus double")


def clear_sky(altitude: float, day: int) -> tuple[float, float]:
    """(direct on the flat, diffuse) kW per m2 of a clear sky, from the yearly courses of the apparent solar constant,
    extinction and the diffuse share."""
    if altitude <= 0:
        return 0.0, 0.0
    # The courses' means and swings.
    a = 1160 + 75 * math.sin(math.radians(360 / 365 * (day - 275)))
    k = 0.174 + 0.035 * math.sin(math.radians(360 / 365 * (day - 100)))
    c = 0.095 + 0.04 * math.sin(math.radians(360 / 365 * (day - 100)))
    h = math.sin(math.radians(altitude))
    normal = a * math.exp(-k / h)
    return normal * h / 1000, c * normal / 1000


def _day(date: datetime.date, utc_offset: float, lat: float, lon: float, interval_min: float) -> tuple[list[tuple[float, float, float]], float]:
    """(suns of a clear day: altitude, azimuth and direct energy of an interval; the day's diffuse energy)."""
    suns, diffuse, hours = [], 0.0, interval_min / 60
    for k in range(int(24 * 60 / interval_min)):
        up, way = raster.sun_position(date.year, date.month, date.day, (k + 0.5) * hours - utc_offset, lat, lon)
        direct, sky = clear_sky(up, date.timetuple().tm_yday)
        diffuse += sky * hours
        if direct > 0:
            suns.append((up, way, direct * hours))
    return suns, diffuse


def _energy(dsm: DataFrame, pixel: float, suns: list[tuple[float, float, float]], diffuse: float, svf: DataFrame | None, reach: float | None) -> DataFrame:
    direct = raster.sunlit(dsm, suns, pixel, reach) if suns else dsm.select("row", "col", F.lit(0.0).alias("lit"))
    held = direct.withColumn("svf", F.lit(1.0)) if svf is None else direct.join(svf, ["row", "col"], "left")
    return held.select("row", "col", (F.col("lit") + F.coalesce("svf", F.lit(1.0)) * diffuse).alias("kwh_m2"))


def irradiation(dsm: DataFrame, pixel: float, date: datetime.date, utc_offset: float, lat: float, lon: float, interval_min: float = 60.0, svf: DataFrame | None = None, reach: float | None = None) -> DataFrame:
    """row, col, kwh_m2 of a clear day: direct where the sun is not hidden, diffuse by the share of sky (row, col, svf)."""
    return _energy(dsm, pixel, *_day(date, utc_offset, lat, lon, interval_min), svf, reach)


#: The day of each month whose declination is nearest to the month's mean.
REPRESENTATIVE_DAYS = (17, 16, 16, 15, 15, 11, 17, 16, 15, 15, 14, 10)


def annual_irradiation(dsm: DataFrame, pixel: float, year: int, utc_offset: float, lat: float, lon: float, interval_min: float = 60.0, svf: DataFrame | None = None, reach: float | None = None) -> DataFrame:
    """row, col, kwh_m2 of a year: a representative day of each month, times the month's days."""
    suns, diffuse = [], 0.0
    for m in range(1, 13):
        days = calendar.monthrange(year, m)[1]
        own, sky = _day(datetime.date(year, m, REPRESENTATIVE_DAYS[m - 1]), utc_offset, lat, lon, interval_min)
        suns += [(up, way, energy * days) for up, way, energy in own]
        diffuse += sky * days
    return _energy(dsm, pixel, suns, diffuse, svf, reach)
