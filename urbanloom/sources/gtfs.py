"""Timetable feeds: a zip of CSV files as tables."""

from __future__ import annotations

import csv
import io
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from urbanloom.operators.transit import seconds

NEEDED = ("stops", "routes", "trips", "stop_times")
EMPTY = {"calendar": "service_id, monday, tuesday, wednesday, thursday, friday, saturday, sunday, start_date, end_date", "calendar_dates": "service_id, date, exception_type"}


def read_feed(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """stops, routes, trips, stop_times, calendar, calendar_dates of a feed; a missing file is an error that names it.

    The zip is one file and is unpacked where the call runs. Untimed stop times, and those of unknown trips or
    stops, are left out.
    """
    tables = {}
    with zipfile.ZipFile(path) as z:
        held = set(z.namelist())
        if missing := [f"{n}.txt" for n in NEEDED if f"{n}.txt" not in held]:
            raise ValueError(f"the feed lacks {', '.join(missing)}")
        if not {"calendar.txt", "calendar_dates.txt"} & held:
            raise ValueError("the feed lacks calendar.txt and calendar_dates.txt")
        for name in (*NEEDED, *EMPTY):
            rows: list[dict[str, str]] = []
            columns = [c.strip() for c in EMPTY.get(name, "").split(",") if c]
            if f"{name}.txt" in held:
                reader = csv.DictReader(io.TextIOWrapper(z.open(f"{name}.txt"), "utf-8-sig"))
                rows = [{(k or "").strip(): (v or "").strip() for k, v in r.items() if k} for r in reader]
                columns = [c.strip() for c in reader.fieldnames or []]
            tables[name] = spark.createDataFrame([tuple(r.get(c) for c in columns) for r in rows], ", ".join(f"`{c}` string" for c in columns))
    times = tables["stop_times"].select("trip_id", "stop_id", F.col("stop_sequence").try_cast("int").alias("seq"), seconds("arrival_time").alias("arr"), seconds("departure_time").alias("dep"))
    times = times.withColumns({"arr": F.coalesce("arr", "dep"), "dep": F.coalesce("dep", "arr")}).where("arr is not null")
    tables["stop_times"] = times.join(tables["trips"].select("trip_id"), "trip_id", "left_semi").join(tables["stops"].select("stop_id"), "stop_id", "left_semi")
    return tables
