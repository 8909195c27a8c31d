"""The date dimension with festival windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagwatch.functions.numbers import date_key


def calendar(spark: SparkSession, start: str, end: str, windows: list[tuple[str, str, str]]) -> DataFrame:
    """One row per day; days_to_festival is 0 inside a window, else minus the days to the next start, null after the last.

    windows is configuration: a few literals, looked up in the row.  The first window that holds a day names it.
    """
    days = spark.range(1).select(F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"))).alias("date"))
    known = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(a).cast("date").alias("start"), F.lit(b).cast("date").alias("end")) for n, a, b in windows])
    if not windows:
        known = F.array().cast("array<struct<name:string,start:date,end:date>>")
    d = F.col("date")
    inside = F.get(F.filter(known, lambda w: (w["start"] <= d) & (d <= w["end"])), F.lit(0))["name"]
    ahead = F.array_min(F.transform(F.filter(known, lambda w: w["start"] > d), lambda w: F.datediff(w["start"], d)))
    iso = F.weekday(d) + 1
    return days.select(
        date_key(d).alias("date_key"),
        "date",
        F.year(d).alias("year"),
        F.quarter(d).alias("quarter"),
        F.month(d).alias("month"),
        F.date_format(d, "MMMM").alias("month_name"),
        F.dayofmonth(d).alias("day"),
        iso.cast("int").alias("day_of_week"),
        F.date_format(d, "EEEE").alias("day_name"),
        F.when(iso >= 6, 1).otherwise(0).alias("is_weekend"),
        inside.alias("festival_window"),
        F.when(inside.isNotNull(), 1).otherwise(0).alias("is_festival"),
        F.when(inside.isNotNull(), 0).otherwise(-ahead).cast("int").alias("days_to_festival"),
    )
