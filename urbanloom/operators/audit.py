"""Plans judged as a whole: metrics of several operators in one table, audits, grown scenarios and a report."""

from __future__ import annotations

from functools import reduce
from html import escape
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from urbanloom.functions.ordered import value_curve
from urbanloom.functions.scratch import written
from urbanloom.functions.text_params import parse_hierarchy
from urbanloom.operators import equity, network, planning, raster, scenarios
from urbanloom.operators.walkability import walkability

#: The metrics whose mean is the index of a plan, and those without which there is nothing to report.
INDEX = ("access_mean", "standards_compliance_pct", "covered_share")
REPORTED = ("access_mean", "standards_categories", "facilities")
#: Rows that a report shows of a table, at most: more are an error.
REPORT_ROWS = 10_000


class Audit(NamedTuple):
    """What an audit found: metrics (metric_key, metric, value), and the tables behind them, where there are any."""

    metrics: DataFrame
    balance: DataFrame | None = None
    facilities: DataFrame | None = None


def _tall(row: DataFrame, values: dict[str, Column]) -> DataFrame:
    """metric, value of one row's values; what is null or no number is left out."""
    wide = row.select(*[v.cast("double").alias(k) for k, v in values.items()])
    return wide.unpivot([], list(values), "metric", "value").where("value is not null and not isnan(value)")


def access_metrics(scores: DataFrame, column: str = "score") -> DataFrame:
    """metric, value of scores from 0 to 100: mean, median, shares at 100 and below 50, number; nothing without scores."""
    rows = scores.select(F.col(column).try_cast("double").alias("x"), F.lit(1.0).alias("one")).where("x is not null and not isnan(x)")
    curve = value_curve(rows, [], "x", "one")
    share = lambda holds: 100 * F.sum(F.when(holds, F.col("w")).otherwise(0.0)) / F.sum("w")

    def at(place: Column) -> Column:
        return F.max(F.when((F.col("w_below") <= place) & (place < F.col("w_below") + F.col("w")), F.col("x")))

    middle = (at(F.floor((F.col("w_all") - 1) / 2)) + at(F.floor(F.col("w_all") / 2))) / 2
    row = curve.agg((F.sum(F.col("w") * F.col("x")) / F.sum("w")).alias("mean"), middle.alias("median"), share(F.col("x") >= 100 - 1e-9).alias("full"), share(F.col("x") < 50).alias("low"), F.sum("w").alias("n"))
    return _tall(row, {"access_mean": F.col("mean"), "access_median": F.col("median"), "access_share_full": F.col("full"), "access_share_low": F.col("low"), "origins": F.col("n")})


def walk_metrics(segments: DataFrame) -> DataFrame:
    """metric, value of walkability() rows: the mean score and the share of segments below 50."""
    held = segments.where("walk_score is not null")
    low = 100 * F.try_divide(F.count_if(F.col("walk_score") < 50).cast("double"), F.count(F.lit(1)))
    return _tall(held.agg(F.avg("walk_score").alias("mean"), low.alias("low")), {"walk_score_mean": F.col("mean"), "walk_low_share": F.col("low")})


def balance_metrics(balance: DataFrame) -> DataFrame:
    """metric, value of landuse_balance() rows: categories with a standard, those in deficit, the share that meets it."""
    row = balance.agg(F.count_if(F.col("status") != "No standard").alias("n"), F.count_if(F.col("status") == "Deficit").alias("short"))
    met = 100 * F.try_divide((F.col("n") - F.col("short")).cast("double"), F.col("n"))
    return _tall(row, {"standards_compliance_pct": met, "standards_deficits": F.col("short"), "standards_categories": F.col("n")})


def adequacy_metrics(facilities: DataFrame, demand: DataFrame) -> DataFrame:
    """metric, value of facility_adequacy() rows and of demand (covered: 0 or 1, pop; below 0 or no number: 0)."""
    used = F.when(F.col("status") != "Unused", F.col("utilization"))
    f = facilities.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("status") == "Overloaded").alias("over"), F.count_if(F.col("status") == "Unused").alias("idle"), F.coalesce(F.avg(used), F.lit(0.0)).alias("use"))
    people = F.greatest(planning.number("pop", 0), F.lit(0.0))
    d = demand.agg(F.coalesce(F.sum(people), F.lit(0.0)).alias("pop"), F.coalesce(F.sum(F.when(F.col("covered") != 0, people)), F.lit(0.0)).alias("near"))
    share = 100 * F.try_divide("near", "pop")
    values = {"covered_share": share, "covered_pop": F.col("near"), "total_pop": F.col("pop"), "facilities": F.col("n"), "facilities_overloaded": F.col("over"), "facilities_unused": F.col("idle"), "mean_utilization": F.col("use")}
    return _tall(f.crossJoin(d), values)


def density_metrics(cells: DataFrame, column: str = "dens_ha") -> DataFrame:
    """metric, value of density_grid() rows: mean, largest and number of cells; nothing without cells."""
    row = cells.select(F.col(column).try_cast("double").alias("x")).where("x is not null and not isnan(x)").agg(F.avg("x").alias("mean"), F.max("x").alias("max"), F.nullif(F.count(F.lit(1)), F.lit(0)).alias("n"))
    return _tall(row, {"density_mean": F.col("mean"), "density_max": F.col("max"), "density_cells": F.col("n")})


def with_index(parts: list[DataFrame]) -> DataFrame:
    """All parts' rows (metric, value) and plan_performance_index: the mean of those of INDEX that are there."""
    metrics = written(reduce(DataFrame.unionByName, parts))
    index = metrics.where(F.col("metric").isin(*INDEX)).agg(F.avg("value").alias("i"))
    return metrics.unionByName(_tall(index, {"plan_performance_index": F.col("i")}))


def labelled(metrics: DataFrame) -> DataFrame:
    """metric_key, metric (its label), value (4 digits) of metrics (metric, value)."""
    return scenarios.named(metrics).select(F.col("metric").alias("metric_key"), F.col("label").alias("metric"), F.round("value", 4).alias("value"))


def _walked(lines: DataFrame, amenities: dict[str, DataFrame] | None, landuse: DataFrame | None, radius: float, relief: DataFrame | None, grid: tuple[float, float, float, float] | None) -> DataFrame:
    """Walkability of the lines; the first layer of amenities is its destinations, land use counts where it has rings."""
    pois = next(iter(amenities.values())) if amenities else None
    rings = landuse.select("category", "ring") if landuse is not None and "ring" in landuse.columns else None
    return walkability(lines.select("line_id", "pts"), radius, pois=pois, landuse=rings, dem=relief, grid=grid)


def plan_audit(
    lines: DataFrame, demand: DataFrame, pop: str | None = None, amenities: dict[str, DataFrame] | None = None, threshold_min: float = 15.0,
    landuse: DataFrame | None = None, population: float = 0.0, standards: str = "green=10, school=4", facilities: DataFrame | None = None, capacity: str | None = None,
    max_cost: float = 500.0, greens: DataFrame | None = None, hierarchy: str = "0.5=300, 2=800", cost: str | None = None, walk_radius: float = 400.0,
    relief: DataFrame | None = None, grid: tuple[float, float, float, float] | None = None,
) -> Audit:
    """All that the given layers allow: access scores and their inequality (amenities), walkability of all lines,
    land-use balance (landuse: category, area_m2, perhaps ring; population above 0), adequacy of facilities (id, x, y,
    pos, capacity) and access to greens (x, y, area_ha). lines: line_id, pts; demand: id, x, y and pop (absent: 1 each).
    """
    nodes, edges = network.build_graph(lines, cost=cost)
    people = demand.select("id", "x", "y", (planning.number(pop, 0) if pop else F.lit(1.0)).alias("pop"))
    parts, balance, served = [walk_metrics(_walked(lines, amenities, landuse, walk_radius, relief, grid))], None, None
    if amenities:
        scores = written(network.access_score(nodes, edges, people, amenities, 4.8, threshold_min))
        gini = equity.access_equity(scores, "score", "pop").where("scope = 'ALL'")
        parts += [access_metrics(scores), _tall(gini, {"access_gini": F.col("gini")})]
    if landuse is not None and population > 0 and standards.strip():
        balance = written(planning.landuse_balance(landuse, "category", "area_m2", population, standards))
        parts.append(balance_metrics(balance))
    if facilities is not None and capacity:
        assigned = written(network.nearest_facility(nodes, edges, people, facilities, max_cost))
        served = written(network.facility_adequacy(assigned, facilities, "pop", capacity))
        parts.append(adequacy_metrics(served, assigned.select("pop", (F.col("facility") != "").cast("int").alias("covered"))))
    if greens is not None and hierarchy.strip():
        classes = network.green_access(nodes, edges, people, greens, parse_hierarchy(hierarchy), "pop")[1]
        parts.append(_tall(classes.agg(F.min("coverage_pct").alias("c")), {"green_coverage_worst": F.col("c")}))
    return Audit(labelled(with_index(parts)), balance, served)


def scenario_pipeline(
    lines: DataFrame, urban: DataFrame, suitability: DataFrame, cells: int, pop_growth: int, grid: tuple[float, float, float, float], amenities: dict[str, DataFrame] | None = None,
    demand: DataFrame | None = None, pop: str = "pop", threshold_min: float = 15.0, landuse: DataFrame | None = None, steps: int = 5, blocked: DataFrame | None = None,
    weight: float = 1.0, base: float = 0.1, cost: str | None = None, walk_radius: float = 400.0,
) -> Audit:
    """The metrics of a town after growth: `cells` new cells by grow(), pop_growth people dealt over them by suitability
    (largest remainder, ties by row and column), and the people that are there already (demand: x, y, pop).

    grid: x of the left edge, width, y of the upper edge and height (below 0) of the cells. Access is scored for old
    and new places alike.
    """
    new = raster.grow(urban, suitability, cells, steps, blocked, weight, base).where("year_of > 0").join(suitability, ["row", "col"])
    place = F.col("row").cast("long") * F.lit(1 << 32) + F.col("col")
    fit = F.when(F.isnan("value") | (F.abs("value") == F.lit(float("inf"))), 0.0).otherwise(F.coalesce("value", F.lit(0.0)))
    settled = planning.allocate_population(new.select(place.alias("id"), "row", "col", fit.alias("fit")), pop_growth, "id", "fit")
    x0, dx, y0, dy = grid
    places = settled.select(((F.col("col") + 0.5) * dx + x0).alias("x"), ((F.col("row") + 0.5) * dy + y0).alias("y"), F.col("allocated").cast("double").alias("pop"))
    if demand is not None:
        places = demand.select(F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), planning.number(pop, 0).alias("pop")).unionByName(places)
    parts = [walk_metrics(_walked(lines, amenities, landuse, walk_radius, None, None))]
    if amenities:
        nodes, edges = network.build_graph(lines, cost=cost)
        parts.append(access_metrics(network.access_score(nodes, edges, written(places), amenities, 4.8, threshold_min)))
    return Audit(labelled(with_index(parts)))


def _table(df: DataFrame, title: str) -> str:
    rows = df.limit(REPORT_ROWS + 1).collect()
    if len(rows) > REPORT_ROWS:
        raise ValueError(f"{title}: more than {REPORT_ROWS} rows")
    cell = lambda v: "" if v is None else f"{v:,.2f}" if isinstance(v, float) else escape(str(v))
    head = "".join(f"<th>{escape(c)}</th>" for c in df.columns)
    body = "".join("<tr>" + "".join(f"<td>{cell(v)}</td>" for v in r) + "</tr>\n" for r in rows)
    return f"<h2>{escape(title)}</h2>\n<table>\n<tr>{head}</tr>\n{body}</table>\n"


def performance_report(audit: Audit, title: str = "Urban Plan", population: float | None = None) -> str:
    """An HTML page of an audit: the index, all metrics, balance and facilities. Small tables alone reach the driver.

    Without access scores, a balance or facilities there is nothing to report: an error.
    """
    held = {r.metric_key: r.value for r in audit.metrics.collect()}
    if not any(k in held for k in REPORTED):
        raise ValueError("nothing to report: access scores, a land-use balance or facilities are needed")
    index = held.get("plan_performance_index")
    parts = [f"<h1>{escape(title)}</h1>\n"]
    if population:
        parts.append(f"<p>Population: {population:,.0f}</p>\n")
    if index is not None:
        parts.append(f"<p class='index'>Plan Performance Index: {index:.1f}</p>\n")
    parts.append(_table(audit.metrics.orderBy("metric").select("metric", "value"), "Metrics"))
    if audit.balance is not None:
        parts.append(_table(audit.balance.orderBy("category"), "Land-use balance"))
    if audit.facilities is not None:
        parts.append(_table(audit.facilities.orderBy(F.col("utilization").desc(), "facility"), "Facilities"))
    return f"<!DOCTYPE html>\n<html><head><meta charset='utf-8'><title>{escape(title)}</title></head>\n<body>\n{''.join(parts)}</body></html>\n"
