"""What is measured along streets and around buildings: samples of lines, densities, slopes, comfort, exposure, widths, collapse.

All of it is column expressions, windows over one line, and the distance join of `environment`.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from urbanloom.operators.environment import summed_within, tobler_kmh

#: Carriageway widths (m) by road class; ramps have their road's.
ROAD_WIDTHS = {
    "motorway": 25.0, "trunk": 25.0, "primary": 18.0, "secondary": 14.0, "tertiary": 10.0, "residential": 8.0,
    "unclassified": 8.0, "road": 8.0, "service": 5.0, "living_street": 5.0, "track": 4.0, "pedestrian": 3.0,
    "footway": 3.0, "cycleway": 3.0, "path": 3.0, "steps": 2.0,
}
AIR_BREAKS = tuple(range(10, 101, 10))
NOISE_BREAKS = (45, 50, 55, 60, 65, 70, 75)
SLOPE_BREAKS = (5.0, 8.0, 12.0)


def road_samples(lines: DataFrame, step: float) -> DataFrame:
    """Rows of lines (pts array<struct<x, y>>, ...) once for each sample: x, y, seg_len instead of pts.

    Every stretch between two points is cut into equal parts of at most `step`; samples are their middles. Stretches
    without length, null or empty lines have none.
    """
    rest = [c for c in lines.columns if c != "pts"]
    ends = F.arrays_zip(F.slice("pts", 1, F.size("pts") - 1).alias("a"), F.slice("pts", 2, F.size("pts")).alias("b"))
    parts = lines.where(F.size("pts") >= 2).select(*rest, F.explode(ends).alias("_s")).select(*rest, F.col("_s.a").alias("_a"), F.col("_s.b").alias("_b"))
    parts = parts.withColumn("_l", F.hypot(F.col("_b.x") - F.col("_a.x"), F.col("_b.y") - F.col("_a.y"))).where("_l > 0")
    parts = parts.withColumn("_n", F.ceil(F.col("_l") / step).cast("int")).withColumn("_k", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    t = (F.col("_k") + 0.5) / F.col("_n")
    at = lambda c: (F.col(f"_a.{c}") + t * (F.col(f"_b.{c}") - F.col(f"_a.{c}"))).alias(c)
    return parts.select(*rest, at("x"), at("y"), (F.col("_l") / F.col("_n")).alias("seg_len"))


def kernel(bandwidth: float, kind: str) -> Callable[[np.ndarray], np.ndarray]:
    """Weights of distances up to the bandwidth; the gaussian has a third of the bandwidth as its deviation."""
    shapes = {"uniform": np.ones_like, "triangular": lambda u: 1 - u, "epanechnikov": lambda u: 1 - u * u, "gaussian": lambda u: np.exp(-4.5 * u * u)}
    if bandwidth <= 0 or kind.lower() not in shapes:
        raise ValueError(f"no kernel {kind!r} of bandwidth {bandwidth}")
    return lambda d: shapes[kind.lower()](d / bandwidth)


def street_density(lines: DataFrame, points: DataFrame, bandwidth: float, step: float, kind: str = "gaussian") -> DataFrame:
    """line_id, density: weights of points (bx, by, weight) by the kernel of their distance, the mean over a line's samples."""
    samples = road_samples(lines.select("line_id", "pts"), step).withColumnRenamed("line_id", "id")
    counts = road_samples(lines.select("line_id", "pts"), step).groupBy("line_id").agg(F.count(F.lit(1)).alias("n"))
    sums = summed_within(samples, points, bandwidth, "weight", kernel(bandwidth, kind)).withColumnRenamed("id", "line_id")
    held = lines.select("line_id").join(counts, "line_id", "left").join(sums, "line_id", "left")
    return held.select("line_id", F.coalesce(F.try_divide("s", "n"), F.lit(0.0)).alias("density"))


def comfort_index(segments: DataFrame, directions: dict[str, int], weights: dict[str, float] | None = None) -> DataFrame:
    """Rows of segments with comfort, 0 to 100: the weighted mean of the columns in `directions`, each scaled to its range.

    Direction 1: more is better, -1: less is. Columns of one value throughout count for nothing; if all are so, it is
    an error. A null counts as the column's worst value.
    """
    spans = segments.agg(*[f(c).cast("double").alias(f"{n}_{c}") for c in directions for n, f in (("lo", F.min), ("hi", F.max))]).first()
    used = [c for c in directions if spans[f"lo_{c}"] is not None and spans[f"hi_{c}"] > spans[f"lo_{c}"]]
    if not used:
        raise ValueError("no component that differs between segments")
    share = lambda c: (F.col(c) - spans[f"lo_{c}"]) / (spans[f"hi_{c}"] - spans[f"lo_{c}"])
    given = {c: float((weights or {}).get(c, 1.0)) for c in used}
    total = F.lit(0.0)
    for c in used:
        total = total + given[c] * F.coalesce(share(c) if directions[c] > 0 else 1 - share(c), F.lit(0.0))
    return segments.select("*", (100 * total / sum(given.values())).alias("comfort"))


def class_of(value: Column, breaks: tuple[float, ...]) -> Column:
    """1 up to the first break, 2 up to the second, ..., one more above the last."""
    out = F.when(value <= breaks[0], 1)
    for k, b in enumerate(breaks[1:], 2):
        out = out.when(value <= b, k)
    return F.when(value.isNotNull(), out.otherwise(len(breaks) + 1))


def walking_slope(profiles: DataFrame, breaks: tuple[float, ...] = SLOPE_BREAKS) -> DataFrame:
    """Per line_id of samples (line_id, d, z): mean_grade and max_grade (%), climb and descent (m), minutes in both
    directions, class of the mean grade. d: distance from the start. Lines with one sample have zeros."""
    along = W.partitionBy("line_id").orderBy("d")
    steps = profiles.select("line_id", (F.lead("d").over(along) - F.col("d")).alias("l"), (F.lead("z").over(along) - F.col("z")).alias("up"))
    grade = F.when(F.col("l") > 0, F.col("up") / F.col("l"))
    minutes = lambda g: F.coalesce(F.sum(F.when(F.col("l") > 0, F.col("l") / 1000 / tobler_kmh(g) * 60)), F.lit(0.0))
    flat = F.lit(0.0)
    found = steps.groupBy("line_id").agg(
        F.coalesce(F.try_divide(100 * F.sum(F.when(F.col("l") > 0, F.abs("up"))), F.sum(F.when(F.col("l") > 0, F.col("l")))), flat).alias("mean_grade"),
        F.coalesce(100 * F.max(F.abs(grade)), flat).alias("max_grade"),
        F.coalesce(F.sum(F.greatest("up", flat)), flat).alias("climb"),
        F.coalesce(F.sum(F.greatest(-F.col("up"), flat)), flat).alias("descent"),
        minutes(grade).alias("minutes"),
        minutes(-grade).alias("minutes_back"),
    )
    return found.withColumn("grade_class", class_of(F.col("mean_grade"), breaks))


def air_strength(emission: Column, seg_len: Column) -> Column:
    """Strength of a point source that stands for a stretch of road (g/km/day), referred to 25 m."""
    return emission * 25 * F.greatest(seg_len, F.lit(1e-6)) / math.pi


def canyon_factor(height: Column, width: Column) -> Column:
    """How much a street between walls holds: 1 to 3, by height over width."""
    return 1 + F.least(F.lit(2.0), height / F.greatest(width, F.lit(1e-6)))


def exposure_bands(levels: DataFrame, level: str, weight: str | None, breaks: tuple[float, ...], unit: str = "") -> DataFrame:
    """band_no, band, total: weights (or rows) in each band of the level, bands that are empty too. No level, no band."""
    edges = [-math.inf, *breaks, math.inf]
    unit = f" {unit}" if unit else ""
    names = [f"< {b:g}{unit}" if a == -math.inf else f">= {a:g}{unit}" if b == math.inf else f"{a:g} - {b:g}{unit}" for a, b in zip(edges[:-1], edges[1:], strict=True)]
    value = F.col(level)
    no = F.lit(0)
    for b in breaks:
        no = no + (value >= b).cast("int")
    sums = levels.where(value.isNotNull() & ~F.isnan(value.cast("double"))).groupBy(no.alias("band_no")).agg((F.sum(weight) if weight else F.count(F.lit(1))).cast("double").alias("total"))
    bands = levels.sparkSession.createDataFrame(list(enumerate(names)), "band_no int, band string")
    return bands.join(sums, "band_no", "left").select("band_no", "band", F.coalesce("total", F.lit(0.0)).alias("total"))


def road_width(width: Column, road_class: Column, fallback: float) -> Column:
    """Metres from an attribute such as 6.5, "6,5" or "6.5 m"; else by road class; else the fallback."""
    text = F.regexp_replace(F.trim(F.lower(width.cast("string"))), r"\s*(?:meters?|metres?|m)$", "")
    number = F.replace(text, F.lit(","), F.lit(".")).try_cast("double")
    name = F.regexp_replace(F.trim(F.lower(road_class)), "_link$", "")
    known = F.create_map(*[F.lit(x) for pair in ROAD_WIDTHS.items() for x in pair])
    return F.coalesce(F.when((number > 0) & (number < math.inf), number), F.try_element_at(known, name), F.lit(float(fallback)))


def collapsed(buildings: DataFrame, key: str, probability: str, seed: int = 0) -> DataFrame:
    """Rows of buildings with collapsed: whether a draw of its own falls below its probability.

    A draw depends on the seed and the key alone, so it is the same on any cluster and for any order of rows.
    """
    digits = F.substr(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string")).cast("binary")), F.lit(1), F.lit(13))
    draw = F.conv(digits, 16, 10).cast("double") / float(1 << 52)
    return buildings.select("*", F.coalesce(draw < F.col(probability), F.lit(False)).alias("collapsed"))


def debris(buildings: DataFrame, height: str, area: str, factor: float = 0.4, solid: float = 0.3) -> DataFrame:
    """Rows of buildings (with collapsed) with spread_m and rubble_m3 of those that fall; 0 for the others."""
    falls = lambda v: F.when(F.col("collapsed"), F.coalesce(v, F.lit(0.0))).otherwise(0.0)
    return buildings.select("*", falls(F.col(height) * factor).alias("spread_m"), falls(F.col(area) * F.col(height) * solid).alias("rubble_m3"))
