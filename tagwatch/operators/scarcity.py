"""Scarcity claims: does a counter ever move?"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tagwatch.functions.numbers import pct, rounded

GROUP = ["listing_id", "site_key", "pattern_type"]


def claims(rows: DataFrame, min_rows: int = 7) -> DataFrame:
    """One row per listing and pattern.  rows: numeric_value ordered by (at, seq).

    Runs are islands between changes and reversals are changes of the last non-zero sign: windows over one
    partitioning, then one aggregation.
    """
    series = Window.partitionBy(*GROUP).orderBy("at", "seq")
    counted = rows.where(F.col("numeric_value").isNotNull())
    v = F.col("numeric_value")
    change = counted.withColumn("prev", F.lag(v).over(series)).withColumn("first", F.row_number().over(series))
    change = change.withColumn("island", F.sum(F.when(F.col("prev").isNull() | (v != F.col("prev")), 1).otherwise(0)).over(series))
    change = change.withColumn("sign", F.nullif(F.signum(v - F.col("prev")), F.lit(0.0)))
    earlier = series.rowsBetween(Window.unboundedPreceding, -1)
    change = change.withColumn("turn", F.when(F.col("sign") != F.last("sign", ignorenulls=True).over(earlier), 1).otherwise(0))
    runs = change.groupBy(*GROUP, "island").agg(F.count("*").alias("run"), F.first("numeric_value").alias("value"), F.sum("turn").alias("turns"), F.min("first").alias("first"))
    by_value = runs.groupBy(*GROUP, "value").agg(F.max("run").alias("run"), F.sum("run").alias("n"), F.sum("turns").alias("turns"), F.min("first").alias("first"))
    told = by_value.groupBy(*GROUP).agg(
        F.max("run").alias("run"), F.sum("turns").alias("turns"), F.count("*").alias("distinct"), F.max_by("value", F.struct(F.col("n"), F.negate("first"))).alias("mode")
    )
    found = rows.groupBy(*GROUP).agg(F.count("*").alias("n_days_observed")).join(told, GROUP, "left")
    few, silent = F.col("n_days_observed") < min_rows, F.col("run").isNull()
    case = lambda quiet, value: F.when(few, F.lit(0)).when(silent, quiet).otherwise(value).cast("long")
    return found.select(
        *GROUP,
        "n_days_observed",
        case(F.lit(1), F.col("distinct")).alias("distinct_values"),
        F.when(~few, F.col("mode")).alias("modal_value"),
        case(F.col("n_days_observed"), F.col("run")).alias("longest_static_run"),
        case(F.lit(0), F.col("turns")).alias("changed_direction_count"),
        F.when(few, "insufficient").when(silent | (F.col("distinct") == 1), "static").when(F.col("turns") >= 3, "erratic").otherwise("plausible").alias("verdict"),
    )


def summary(found: DataFrame) -> DataFrame:
    seen = found.where("verdict <> 'insufficient'")
    share = lambda c: rounded(pct(F.count_if(F.col("verdict") == c).cast("double"), F.count("*").cast("double")))
    return seen.agg(
        F.count("*").alias("n_assessed"),
        F.count_if(F.col("verdict") == "static").alias("n_static"),
        F.count_if(F.col("verdict") == "erratic").alias("n_erratic"),
        share("static").alias("pct_static"),
        share("erratic").alias("pct_erratic"),
        F.max("longest_static_run").alias("longest_static_run_days"),
    )


def summary_by_site(found: DataFrame) -> DataFrame:
    seen = found.where("verdict <> 'insufficient'")
    return seen.groupBy("site_key").agg(F.count("*").alias("assessed"), F.count_if(F.col("verdict") == "static").alias("static"), F.count_if(F.col("verdict") == "erratic").alias("erratic"))


def mart(rows: DataFrame) -> DataFrame:
    """The BI view, whose verdict knows no reversals."""
    n, distinct = F.col("days_observed"), F.col("distinct_values")
    out = rows.groupBy(*GROUP).agg(
        F.count("*").alias("days_observed"), F.count_distinct("numeric_value").alias("distinct_values"), F.min("numeric_value").alias("min_value"), F.max("numeric_value").alias("max_value")
    )
    return out.withColumn("verdict", F.when(n < 7, "insufficient").when(distinct <= 1, "static").otherwise("moves"))


def static_stock_claims(rows: DataFrame) -> DataFrame:
    """How many listings claim the same number at least seven times."""
    return mart(rows).where("verdict = 'static'").agg(F.count_distinct("listing_id").alias("static_claims"))
