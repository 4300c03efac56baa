"""Timetables: service days, frequencies and earliest arrival, on tables of trips and stop times.

Times are whole seconds after midnight of the service day and may exceed 86 400. Tables: trips(trip_id, route_id,
service_id), stop_times(trip_id, stop_id, seq, arr, dep), calendar(service_id, mon..sun, start_date, end_date),
calendar_dates(service_id, date, exception_type); dates are text, YYYYMMDD.
"""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from urbanloom.functions.scratch import written
from urbanloom.operators.network import nearest_node, nearest_source

DAYS = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")


def seconds(text: str | Column) -> Column:
    """H:MM:SS as seconds; hours may exceed 23; null for anything else."""
    t = F.trim(F.col(text) if isinstance(text, str) else text)
    part = lambda i: F.regexp_extract(t, r"^(\d+):(\d{1,2}):(\d{1,2})$", i).try_cast("int")
    return part(1) * 3600 + part(2) * 60 + part(3)


def clock(secs: str | Column) -> Column:
    """Seconds as HH:MM."""
    s = F.col(secs) if isinstance(secs, str) else secs
    return F.format_string("%02d:%02d", F.floor(s / 3600).cast("int"), (F.floor(s / 60) % 60).cast("int"))


def active_services(calendar: DataFrame, calendar_dates: DataFrame, day: str) -> DataFrame:
    """service_id of the services that run on a day: by weekday and range, and the day's exceptions (1 adds, 2 takes away)."""
    try:
        weekday = DAYS[datetime.datetime.strptime(day, "%Y%m%d").weekday()]
    except ValueError:
        raise ValueError(f"not a date (YYYYMMDD): {day!r}") from None
    regular = calendar.where((F.col(weekday).cast("int") == 1) & (F.col("start_date") <= day) & (F.col("end_date") >= day)).select("service_id")
    today = calendar_dates.where(F.col("date") == day)
    added = today.where(F.col("exception_type").cast("int") == 1).select("service_id")
    taken = today.where(F.col("exception_type").cast("int") == 2).select("service_id")
    return regular.unionByName(added).distinct().join(taken, "service_id", "left_anti")


def first_service_day(calendar: DataFrame, calendar_dates: DataFrame) -> str:
    """The earliest served day within a week of a service's start; else the first day that an exception adds."""
    start = F.try_to_timestamp("start_date", F.lit("yyyyMMdd")).cast("date")
    days = calendar.withColumn("_d", F.explode(F.sequence(F.lit(0), F.lit(6)))).withColumn("_day", F.date_add(start, F.col("_d")))
    served = F.element_at(F.array(*[F.col(c).cast("int") for c in DAYS]), F.weekday("_day") + 1) == 1
    found = days.where(served & (F.date_format("_day", "yyyyMMdd") <= F.col("end_date"))).agg(F.min(F.date_format("_day", "yyyyMMdd"))).first()[0]
    found = found or calendar_dates.where(F.col("exception_type").cast("int") == 1).agg(F.min("date")).first()[0]
    if not found:
        raise ValueError("no service runs on any day")
    return found


def day_times(trips: DataFrame, stop_times: DataFrame, services: DataFrame) -> DataFrame:
    """Stop times of the trips of some services, with route_id and last (whether it is the trip's last stop)."""
    own = trips.join(services, "service_id", "left_semi").select("trip_id", "route_id")
    order = W.partitionBy("trip_id").orderBy("seq")
    return stop_times.join(own, "trip_id").withColumn("last", F.lead("seq").over(order).isNull())


def stop_frequencies(times: DataFrame, start: float, end: float) -> DataFrame:
    """stop_id, departures, per_hour, headway_min, n_routes in start <= departure < end; a trip's last stop has none."""
    if end <= start:
        raise ValueError("the window must end after its start")
    inside = times.where(~F.col("last") & (F.col("dep") >= start) & (F.col("dep") < end))
    sums = inside.groupBy("stop_id").agg(F.count(F.lit(1)).alias("departures"), F.countDistinct("route_id").alias("n_routes"))
    return sums.select("stop_id", "departures", (F.col("departures") / ((end - start) / 3600)).alias("per_hour"), ((end - start) / 60 / F.col("departures")).alias("headway_min"), "n_routes")


def route_trips(times: DataFrame, start: float, end: float) -> DataFrame:
    """route_id, trips_in_window: trips with a departure in the window."""
    inside = times.where(~F.col("last") & (F.col("dep") >= start) & (F.col("dep") < end))
    return inside.groupBy("route_id").agg(F.countDistinct("trip_id").alias("trips_in_window"))


def route_statistics(times: DataFrame) -> DataFrame:
    """route_id, n_trips, first_dep, last_arr (HH:MM), n_stops."""
    sums = times.groupBy("route_id").agg(F.countDistinct("trip_id").alias("n_trips"), F.min("dep").alias("_d"), F.max("arr").alias("_a"), F.countDistinct("stop_id").alias("n_stops"))
    return sums.select("route_id", "n_trips", clock("_d").alias("first_dep"), clock("_a").alias("last_arr"), "n_stops")


def earliest_arrival(times: DataFrame, access: DataFrame, max_transfers: int = 2) -> DataFrame:
    """stop_id, arrival: earliest arrival from the stops of access (stop_id, at), riding at most max_transfers + 1 trips.

    A round boards each trip at the first stop that was reached in time before the round, and takes the smallest
    arrival at its later stops. No order of the trips of a route is assumed. Only stops that got earlier go on.
    """
    ride = written(times.select("trip_id", "stop_id", "seq", "arr", "dep"))
    best = written(access.groupBy("stop_id").agg(F.min("at").alias("arrival")))
    fresh = best
    for _ in range(max_transfers + 1):
        board = ride.join(fresh, "stop_id").where(F.col("dep") >= F.col("arrival")).groupBy("trip_id").agg(F.min("seq").alias("_on"))
        off = ride.join(board, "trip_id").where(F.col("seq") > F.col("_on")).groupBy("stop_id").agg(F.min("arr").alias("_new"))
        merged = written(best.join(off, "stop_id", "full").withColumn("_better", F.coalesce(F.col("_new") < F.col("arrival"), F.col("arrival").isNull())))
        best = merged.select("stop_id", F.when(F.col("_better"), F.col("_new")).otherwise(F.col("arrival")).alias("arrival"))
        fresh = merged.where("_better").select("stop_id", F.col("_new").alias("arrival"))
        if not fresh.limit(1).count():
            break
    return best


def door_to_door(nodes: DataFrame, edges: DataFrame, times: DataFrame, stops: DataFrame, origins: DataFrame, demand: DataFrame, departure: float, walk_kmh: float = 4.8, max_walk_min: float = 10.0, max_transfers: int = 2) -> DataFrame:
    """Rows of demand (x, y, ...) with walk_min, transit_min, best_min, saved_min, mode: from the nearest of the origins
    (x, y) on foot, and on foot to a stop, by trips and on foot again, leaving at `departure` (seconds).

    stops (stop_id, x, y) that are farther from the network than the longest walk to a stop take no part; the walk
    from the last stop has no limit. Walks go along the network from the nearest node, with a stop's way to its node. mode is
    Transit if that is faster, else Walk, or Unreachable (all minutes null); saved_min is 0 for walks and null if no walk
    leads there. A place that takes no walking at all is a walk of 0 minutes.
    """
    speed = walk_kmh / 3.6
    ways = written(edges.select("a", "b", (F.col("len") / speed).alias("cost")))
    starts = nearest_node(origins.select("x", "y"), nodes).select("node_id", F.lit(0).alias("start"), F.lit(0.0).alias("offset"))
    walk = written(nearest_source(ways, starts).select(F.col("node").alias("node_id"), F.col("cost").alias("_walk")))
    at = nearest_node(stops.select("stop_id", "x", "y"), nodes).where(F.col("snap_m") <= max_walk_min * 60 * speed)
    at = written(at.select("stop_id", "node_id", (F.col("snap_m") / speed).alias("_snap")))
    to_stop = F.col("_walk") + F.col("_snap")
    access = at.join(walk, "node_id").where(to_stop <= max_walk_min * 60).select("stop_id", (departure + to_stop).alias("at"))
    arrived = at.join(earliest_arrival(times, access, max_transfers), "stop_id")
    left = arrived.select("node_id", F.lit(0).alias("start"), (F.col("arrival") + F.col("_snap")).alias("offset"))
    ride = written(nearest_source(ways, left).select(F.col("node").alias("node_id"), F.col("cost").alias("_ride")))
    ends = nearest_node(demand, nodes).drop("snap_m").join(walk, "node_id", "left").join(ride, "node_id", "left")
    on_foot, by_trips = F.col("_walk") / 60, (F.col("_ride") - departure) / 60
    faster = by_trips < F.coalesce(on_foot, F.lit(float("inf")))
    best = F.least(on_foot, by_trips)
    mode = F.when(best.isNull(), "Unreachable").when(faster, "Transit").otherwise("Walk")
    saved = F.when(faster, on_foot - by_trips).when(best.isNotNull(), 0.0)
    return ends.select(*demand.columns, on_foot.alias("walk_min"), by_trips.alias("transit_min"), best.alias("best_min"), saved.alias("saved_min"), mode.alias("mode"))
