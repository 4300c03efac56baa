"""Plan standards, population, housing, travel demand, cycling stress, emissions and seismic risk of tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from urbanloom.functions.text_params import parse_rules, parse_standards


def number(column: str | None, default: float) -> Column:
    """A column as a number; what is missing or no number has the default."""
    if column is None:
        return F.lit(float(default))
    x = F.col(column).try_cast("double")
    return F.when(x.isNotNull() & ~F.isnan(x), x).otherwise(float(default))


def landuse_balance(df: DataFrame, category: str, area: str, population: float, standards: str = "green=10, school=4") -> DataFrame:
    """Areas by category against areas per head: the first keyword that the category's name contains decides."""
    name = F.coalesce(F.col(category).cast("string"), F.lit(""))
    sums = df.groupBy(name.alias("category")).agg(F.sum(number(area, 0)).alias("area_m2"))
    key, per_head = F.lit(""), F.lit(None).cast("double")
    for k, v in reversed(parse_standards(standards)):
        hit = F.lower("category").contains(k)
        key, per_head = F.when(hit, F.lit(k)).otherwise(key), F.when(hit, F.lit(v)).otherwise(per_head)
    found = sums.select("category", "area_m2", key.alias("std_key"), per_head.alias("_per"))
    required = F.coalesce(F.col("_per") * population, F.lit(0.0))
    balance = F.when(F.col("_per").isNull(), 0.0).otherwise(F.col("area_m2") - required)
    status = F.when(F.col("_per").isNull(), "No standard").when(balance >= 0, "Meets standard").otherwise("Deficit")
    per = F.col("area_m2") / population if population > 0 else F.lit(0.0)
    return found.select("category", "area_m2", per.alias("m2_capita"), "std_key", F.coalesce("_per", F.lit(0.0)).alias("std_m2cap"), required.alias("required"), balance.alias("balance_m2"), status.alias("status"))


def residential_capacity(df: DataFrame, area: str, far: str, existing: str | None = None, unit_size: float = 90.0, efficiency: float = 0.85) -> DataFrame:
    """Rows of df, buildable_m2 = area x ratio less existing floor (none below 0), cap_units = whole dwellings."""
    if unit_size <= 0:
        raise ValueError("the unit size must be positive")
    zero = F.lit(0.0)
    built = F.greatest(number(area, 0) * F.greatest(number(far, 0), zero) - F.greatest(number(existing, 0), zero), zero)
    return df.withColumn("buildable_m2", built).withColumn("cap_units", F.floor(F.col("buildable_m2") * efficiency / unit_size).cast("long"))


def capacity_by_district(parcels: DataFrame, area: str, district: str | None) -> DataFrame:
    """Sums of residential_capacity() rows by district (`ALL` without one)."""
    name = F.coalesce(F.col(district).cast("string"), F.lit("")) if district else F.lit("ALL")
    return parcels.groupBy(name.alias("district")).agg(F.sum(number(area, 0)).alias("area_m2"), F.sum("buildable_m2").alias("buildable_m2"), F.sum("cap_units").alias("cap_units"))


def allocate_population(df: DataFrame, increment: int, order: str, weight: str | None = None) -> DataFrame:
    """Rows of df and `allocated`: a whole increment by largest remainder, ties in `order`; weights of 0 in all: equal.

    Only rows that compete for the remainder are ranked: each fraction is compared with a cut that a running
    count over fractions gives, so ties at the cut alone are ordered.
    """
    w = F.greatest(number(weight, 1), F.lit(0.0)) if weight else F.lit(1.0)
    held = df.withColumn("_w", w)
    totals = held.agg(F.sum("_w").alias("_sum"), F.count(F.lit(1)).alias("_n"))
    held = held.crossJoin(F.broadcast(totals))
    part = F.when(F.col("_sum") > 0, F.try_divide("_w", "_sum")).otherwise(F.lit(1.0) / F.col("_n"))
    held = held.withColumn("_quota", F.lit(float(max(0, increment))) * part)
    held = held.withColumns({"_whole": F.floor("_quota"), "_frac": F.col("_quota") - F.floor("_quota")})
    left = held.agg((F.lit(max(0, increment)) - F.sum("_whole")).alias("_left"))
    by_frac = held.groupBy("_frac").agg(F.count(F.lit(1)).alias("_m"))
    above = W.orderBy(F.col("_frac").desc()).rowsBetween(W.unboundedPreceding, -1)
    by_frac = by_frac.select(F.col("_frac"), F.col("_m"), F.coalesce(F.sum("_m").over(above), F.lit(0)).alias("_above"))
    held = held.join(by_frac, "_frac").crossJoin(F.broadcast(left))
    tied = W.partitionBy("_frac").orderBy(order)
    extra = F.when(F.col("_above") + F.col("_m") <= F.col("_left"), 1).when(F.col("_above") >= F.col("_left"), 0).otherwise((F.col("_above") + F.row_number().over(tied) <= F.col("_left")).cast("int"))
    return held.select(*df.columns, (F.col("_whole") + extra).cast("int").alias("allocated"))


def housing_needs(df: DataFrame, pop_future: str, existing: str, hh_size: float = 2.5, vacancy: float = 0.05, replacement: float = 0.0, backlog: float = 0.0) -> DataFrame:
    """Rows of df and households, target_stock, need: households with vacancies, less the stock, and what it lacks."""
    if hh_size <= 0:
        raise ValueError("the household size must be positive")
    households = number(pop_future, 0) / hh_size
    target = households * (1 + max(0.0, vacancy))
    need = target - number(existing, 0) + max(0.0, replacement) + max(0.0, backlog)
    return df.select("*", households.alias("households"), target.alias("target_stock"), need.alias("need"))


def housing_metrics(pop_future: float, existing: float, hh_size: float = 2.5, vacancy: float = 0.05, replacement: float = 0.0, backlog: float = 0.0) -> list[tuple[str, float]]:
    """The same for one place as (metric, value) rows, its inputs among them."""
    if hh_size <= 0:
        raise ValueError("the household size must be positive")
    floor = lambda v: max(0.0, v)
    households = pop_future / hh_size
    target = households * (1 + floor(vacancy))
    need = target - existing + floor(replacement) + floor(backlog)
    # Names of the metrics, in their order.
    return [("Horizon population", pop_future), ("Household size", hh_size), ("Future households", households), ("Vacancy allowance", vacancy), ("Target stock (units)", target),
            ("Existing dwellings", existing), ("Replacement losses", floor(replacement)), ("Backlog", floor(backlog)), ("Dwellings needed", need)]


def population_projection(df: DataFrame, order: str, age: str, pop: str, survival: str, fertility: str, migration: str | None = None, steps: int = 4, step_years: int = 5) -> DataFrame:
    """Cohorts in `order` carried on: step, year_offset, age_group, population.

    A step: births from all groups into the first; survivors move on, those of the last stay; net migrants are
    added; no group below 0. The table has one row for each age group (some dozens); a step is one window and
    one sum over it.
    """
    held = df.select(F.col(order).alias("_o"), F.col(age).cast("string").alias("age_group"), number(pop, 0).alias("population"), number(survival, 0).alias("_s"), number(fertility, 0).alias("_f"), number(migration, 0).alias("_m"))
    row = W.orderBy("_o")
    held = held.withColumns({"_i": F.row_number().over(row), "_k": F.count(F.lit(1)).over(W.partitionBy())})
    out = [held.withColumn("step", F.lit(0))]
    for step in range(1, steps + 1):
        last = out[-1]
        births = F.sum(F.col("_f") * F.col("population")).over(W.partitionBy())
        moved = F.coalesce(F.lag(F.col("_s") * F.col("population")).over(row), F.lit(0.0))
        stays = F.when(F.col("_i") == F.col("_k"), F.col("_s") * F.col("population")).otherwise(0.0)
        now = F.when(F.col("_i") == 1, births).otherwise(moved) + stays + F.col("_m")
        out.append(last.withColumn("population", F.greatest(now, F.lit(0.0))).withColumn("step", F.lit(step)))
    every = out[0]
    for more in out[1:]:
        every = every.unionByName(more)
    return every.select("step", (F.col("step") * step_years).alias("year_offset"), "age_group", "population")


def projection_totals(projection: DataFrame) -> DataFrame:
    """step, year_offset, population, growth_pct (against the step before) of population_projection() rows."""
    sums = projection.groupBy("step", "year_offset").agg(F.sum("population").alias("population"))
    before = F.lag("population").over(W.orderBy("step"))
    return sums.withColumn("growth_pct", F.coalesce(100 * F.try_divide(F.col("population") - before, before), F.lit(0.0)))


def trip_generation(df: DataFrame, pop: str, jobs: str, p_rate: float = 1.5, a_rate: float = 2.0) -> DataFrame:
    """Rows of df, production = pop x p_rate, attraction = jobs x a_rate."""
    return df.select("*", (number(pop, 0) * p_rate).alias("production"), (number(jobs, 0) * a_rate).alias("attraction"))


def mode_split(df: DataFrame, flow: str, times: list[str], betas: list[float], constants: list[float], names: list[str]) -> DataFrame:
    """Rows of df, share_<mode> and flow_<mode>: shares by exp of constant + beta x time, from the largest down."""
    if not len(times) == len(betas) == len(constants) == len(names):
        raise ValueError("modes need as many times, betas, constants and names")
    use = [F.lit(float(c)) + float(b) * number(t, 0) for t, b, c in zip(times, betas, constants, strict=True)]
    held = df.withColumn("_use", F.array(*use))
    held = held.withColumn("_e", F.transform("_use", lambda u: F.exp(u - F.array_max("_use"))))
    total = F.aggregate("_e", F.lit(0.0), lambda a, e: a + e)
    shares = {f"share_{n}": F.col("_e")[i] / total for i, n in enumerate(names)}
    flows = {f"flow_{n}": number(flow, 0) * s for n, s in zip(names, shares.values(), strict=True)}
    return held.select(*df.columns, *[c.alias(n) for n, c in (shares | flows).items()])


#: Bounds of the traffic stress classes.
LTS_RULES = {
    "path_lts": 1.0, "lane_lts2_speed": 50.0, "lane_lts2_lanes": 3.0, "lane_lts_low": 2.0, "lane_lts_high": 3.0,
    "mixed_lts1_speed": 30.0, "mixed_lts1_lanes": 2.0, "mixed_lts1_aadt": 1000.0, "mixed_lts2_speed": 30.0,
    "mixed_lts2_lanes": 2.0, "mixed_lts3_speed": 50.0,
}
#: Names of the classes.
LTS_LABELS = {1: "LTS 1 low stress", 2: "LTS 2 low stress", 3: "LTS 3 moderate stress", 4: "LTS 4 high stress"}


def lts_label(lts: str = "lts") -> Column:
    """Name of a stress class."""
    out = F.lit(LTS_LABELS[4])
    for k in (1, 2, 3):
        out = F.when(F.col(lts) == k, LTS_LABELS[k]).otherwise(out)
    return out


def cycling_stress(df: DataFrame, speed: str | None, lanes: str | None, aadt: str | None, infra: str | None, rules: str | None = None, speed_default: float = 50.0, lanes_default: float = 2.0, aadt_default: float = 0.0, infra_default: str = "mixed") -> DataFrame:
    """Rows of df and lts (1 calm to 4): paths; lanes by speed and lanes; mixed traffic by speed, lanes and volume."""
    r = parse_rules(rules, LTS_RULES)
    s, n, v = number(speed, speed_default), number(lanes, lanes_default), number(aadt, aadt_default)
    text = F.lower(F.trim(F.col(infra).cast("string"))) if infra else F.lit(None).cast("string")
    kind = F.when(text.isNull() | (text == ""), infra_default).otherwise(text)
    level = (
        F.when(kind == "path", round(r["path_lts"]))
        .when((kind == "lane") & (s <= r["lane_lts2_speed"]) & (n <= r["lane_lts2_lanes"]), round(r["lane_lts_low"]))
        .when(kind == "lane", round(r["lane_lts_high"]))
        .when((s <= r["mixed_lts1_speed"]) & (n <= r["mixed_lts1_lanes"]) & (v < r["mixed_lts1_aadt"]), 1)
        .when((s <= r["mixed_lts2_speed"]) & (n <= r["mixed_lts2_lanes"]), 2)
        .when(s <= r["mixed_lts3_speed"], 3)
        .otherwise(4)
    )
    return df.select("*", F.least(F.greatest(level, F.lit(1)), F.lit(4)).cast("int").alias("lts"), s.alias("speed_used"), n.alias("lanes_used"), v.alias("aadt_used"), kind.alias("infra_used"))


def stress_summary(df: DataFrame, length: str) -> DataFrame:
    """Classes 1 to 4, also those without segments: label, length_m, share_len (percent), segments."""
    sums = df.groupBy("lts").agg(F.sum(number(length, 0)).alias("length_m"), F.count(F.lit(1)).alias("segments"))
    every = df.sparkSession.range(1, 5).select(F.col("id").cast("int").alias("lts"))
    found = every.join(sums, "lts", "left").select("lts", F.coalesce("length_m", F.lit(0.0)).alias("length_m"), F.coalesce("segments", F.lit(0)).alias("segments"))
    total = F.sum("length_m").over(W.partitionBy())
    return found.select("lts", lts_label().alias("label"), "length_m", F.coalesce(100 * F.try_divide("length_m", total), F.lit(0.0)).alias("share_len"), "segments")


def road_emissions(df: DataFrame, volume: str, factor: float = 1.0, ef_gkm: float = 0.5) -> DataFrame:
    """Rows of df, vol_used = volume x factor (no number: 0), emission = that x grams per kilometre."""
    used = number(volume, 0) * factor
    return df.select("*", (used * ef_gkm).alias("emission"), used.alias("vol_used"))


def collapse_probability(year: Column, magnitude: float = 7.0) -> Column:
    """By year of construction, scaled by exp(0.8 (magnitude - 7)), at most 1."""
    # Code generations and their probabilities.
    base = F.when(year <= 1985, 0.85).when(year <= 2000, 0.60).when(year <= 2018, 0.25).otherwise(0.05)
    return F.least(F.greatest(base * F.exp(F.lit(0.8 * (magnitude - 7.0))), F.lit(0.0)), F.lit(1.0))


def seismic_risk(df: DataFrame, floors: str | None, year: str | None, area: str, magnitude: float = 7.0, floor_height: float = 3.0, debris_factor: float = 0.4, solid_ratio: float = 0.3) -> DataFrame:
    """Rows of df, height_m, collapse_prob, debris_radius_m and debris_vol_m3 of a collapse, and both as expected values."""
    height = F.greatest(number(floors, 1), F.lit(1.0)) * floor_height
    prob = collapse_probability(number(year, 2000), magnitude)
    volume = number(area, 0) * height * solid_ratio
    return df.select("*", height.alias("height_m"), prob.alias("collapse_prob"), (height * debris_factor).alias("debris_radius_m"), volume.alias("debris_vol_m3"), (prob * volume).alias("expected_vol_m3"))


def landcover_change(df: DataFrame, before: str, after: str, cell_ha: float) -> DataFrame:
    """Transitions that occur: from_class, to_class, cells, area_ha, kind. Cells without a class are left out."""
    a, b = F.col(before).cast("string"), F.col(after).cast("string")
    sums = df.where(a.isNotNull() & b.isNotNull()).groupBy(a.alias("from_class"), b.alias("to_class")).agg(F.count(F.lit(1)).alias("cells"))
    kind = F.when(F.col("from_class") == F.col("to_class"), "Persistence").otherwise("Conversion")
    return sums.select("*", (F.col("cells") * cell_ha).alias("area_ha"), kind.alias("kind"))


def landcover_classes(matrix: DataFrame) -> DataFrame:
    """Per class of landcover_change(): t1_ha, t2_ha, persisted_ha, lost_ha, gained_ha, net_ha."""
    ends = F.array(F.struct(F.col("from_class").alias("class"), F.lit(1).alias("out")), F.struct(F.col("to_class").alias("class"), F.lit(0).alias("out")))
    each = matrix.select(F.explode(ends).alias("e"), "area_ha", "kind").select("e.*", "area_ha", "kind")
    total = lambda cond: F.sum(F.when(cond, F.col("area_ha")).otherwise(0.0))
    stay = F.col("kind") == "Persistence"
    sums = each.groupBy("class").agg(total(F.col("out") == 1).alias("t1_ha"), total(F.col("out") == 0).alias("t2_ha"), total(stay & (F.col("out") == 1)).alias("persisted_ha"))
    return sums.select("*", (F.col("t1_ha") - F.col("persisted_ha")).alias("lost_ha"), (F.col("t2_ha") - F.col("persisted_ha")).alias("gained_ha"), (F.col("t2_ha") - F.col("t1_ha")).alias("net_ha"))


def density_grid(df: DataFrame, x: str, y: str, cell: float = 100.0, value: str | None = None) -> DataFrame:
    """Cells that hold points: col, row, cell_id (row by row from the lower left), n_feat, value, dens_ha.

    The grid starts at the multiple of `cell` below the smallest coordinates.
    """
    if cell <= 0:
        raise ValueError("the cell size must be positive")
    placed = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).withColumns({"_i": F.floor(F.col(x) / cell), "_j": F.floor(F.col(y) / cell)})
    sums = placed.groupBy("_i", "_j").agg(F.count(F.lit(1)).alias("n_feat"), F.sum(number(value, 1)).alias("value"))
    origin = sums.agg(F.min("_i").alias("_i0"), F.min("_j").alias("_j0"), F.max("_i").alias("_i1"))
    at = sums.crossJoin(F.broadcast(origin)).withColumns({"col": F.col("_i") - F.col("_i0"), "row": F.col("_j") - F.col("_j0")})
    wide = F.col("_i1") - F.col("_i0") + 1
    return at.select("col", "row", (F.col("row") * wide + F.col("col") + 1).alias("cell_id"), "n_feat", "value", (F.col("value") / (cell * cell / 10_000)).alias("dens_ha"))


def heat_risk(built: Column, green: Column, water: Column, height: Column, h_ref: float = 20.0, weights: tuple[float, float, float, float] = (0.4, 0.2, 0.3, 0.1)) -> Column:
    """0 to 100 on a scale that the weights fix: built-up at h_ref is 100, all under the stronger coolant is 0."""
    b, h, g, w = weights
    share = lambda c: F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))
    low, high = -max(g, w), b + h
    score = b * share(built) + h * share(height / max(h_ref, 1e-9)) - g * share(green) - w * share(water)
    return F.least(F.greatest(100 * (score - low) / ((high - low) if high > low else 1.0), F.lit(0.0)), F.lit(100.0))
