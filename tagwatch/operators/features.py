"""Eighteen scale-free features of a price series, by windows and one aggregation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tagwatch.functions.numbers import exact_avg, rounded, safe_div
from tagwatch.operators.timeline import included, series

NAMES = [
    "n_observations", "coef_variation", "range_ratio", "n_price_levels_norm", "max_daily_rise_pct", "max_daily_drop_pct", "n_large_moves_norm", "max_rise_21d_pct",
    "max_drop_after_rise_pct", "frac_days_at_max", "frac_days_at_min", "time_at_elevated_frac", "peak_to_median_pct", "median_to_min_pct", "rise_then_fall_score",
    "lag1_autocorr", "mean_abs_daily_change_pct", "trend_slope_norm",
]


def _signature(points: DataFrame) -> DataFrame:
    """Of each listing, the first greatest rise within 22 trailing observations and the drop that follows it."""
    series = Window.partitionBy("listing_id").orderBy("i")
    around = F.collect_list("p").over(series.rowsBetween(-21, 0))
    tail = F.min("p").over(series.rowsBetween(0, Window.unboundedFollowing))
    seen = points.select("listing_id", "i", around.alias("seg"), tail.alias("tail"))
    seen = seen.select("listing_id", "i", "tail", "seg", F.array_min("seg").alias("low"), F.array_max("seg").alias("high"))
    rose = seen.where((F.size("seg") >= 3) & (F.col("low") > 0) & (F.array_position("seg", F.col("high")) > F.array_position("seg", F.col("low"))))
    rose = rose.withColumn("rise", (F.col("high") - F.col("low")) / F.col("low") * 100).where("rise > 0")
    best = F.max_by(F.struct("rise", "high", "tail"), F.struct(F.col("rise"), F.negate("i")))
    out = rose.groupBy("listing_id").agg(best.alias("b"))
    return out.select("listing_id", F.col("b.rise").alias("rise21"), ((F.col("b.high") - F.col("b.tail")) / F.col("b.high") * 100).alias("drop21"))


def features(obs: DataFrame, min_observations: int = 10, digits: int | None = None) -> DataFrame:
    """One row per listing with enough points: listing_id, site_key, title and NAMES.  digits: rounding, for comparison."""
    points = included(obs).select(
        "listing_id", "site_key", "title", F.col("selling_price").alias("p"), (F.row_number().over(series()) - 1).alias("i"), F.lag("selling_price").over(series()).alias("prev")
    )
    levels = points.groupBy("listing_id").agg(
        F.count("*").alias("n"), exact_avg(F.col("p")).alias("mean"), F.median("p").alias("mid"), F.min("p").alias("lo"), F.max("p").alias("hi"), F.min("site_key").alias("site_key"), F.min("title").alias("title")
    )
    levels = levels.where(F.col("n") >= min_observations)
    with_levels = points.drop("site_key", "title").join(levels, "listing_id")
    p, prev, mean, mid, lo, hi, n, i = (F.col(c) for c in ("p", "prev", "mean", "mid", "lo", "hi", "n", "i"))
    change = F.when(prev > 0, (p - prev) / prev * 100)
    tick = F.greatest(mid * 0.005, F.lit(1e-9))
    x_mean = (n - 1) / 2.0
    agg = with_levels.groupBy("listing_id", "site_key", "title", "n", "mean", "mid", "lo", "hi").agg(
        F.sqrt(F.sum((p - mean) * (p - mean)) / F.first("n")).alias("sd"),
        F.count_distinct(F.rint(p / tick)).alias("levels"),
        F.max(F.when(change > 0, change)).alias("up"),
        F.min(F.when(change < 0, change)).alias("down"),
        F.count_if(F.abs(change) >= 5).alias("large"),
        F.avg(F.abs(change)).alias("moved"),
        F.count_if(p >= hi * 0.99).alias("at_max"),
        F.count_if(p <= lo * 1.01).alias("at_min"),
        F.count_if(p > mid * 1.05).alias("elevated"),
        F.sum((p - mean) * (prev - mean)).alias("cov"),
        F.sum((i - x_mean) * (p - mean)).alias("sxy"),
        F.sum((i - x_mean) * (i - x_mean)).alias("sxx"),
    )
    rise, drop = F.coalesce("rise21", F.lit(0.0)), F.coalesce("drop21", F.lit(0.0))
    sd, count = F.col("sd"), n.cast("double")
    values = {
        "n_observations": count,
        "coef_variation": safe_div(sd, mean) * 100,
        "range_ratio": safe_div(hi - lo, mid) * 100,
        "n_price_levels_norm": safe_div(F.col("levels").cast("double"), count),
        "max_daily_rise_pct": F.coalesce("up", F.lit(0.0)),
        "max_daily_drop_pct": F.abs(F.coalesce("down", F.lit(0.0))),
        "n_large_moves_norm": safe_div(F.col("large").cast("double"), count),
        "max_rise_21d_pct": rise,
        "max_drop_after_rise_pct": drop,
        "frac_days_at_max": safe_div(F.col("at_max").cast("double"), count),
        "frac_days_at_min": safe_div(F.col("at_min").cast("double"), count),
        "time_at_elevated_frac": safe_div(F.col("elevated").cast("double"), count),
        "peak_to_median_pct": safe_div(hi - mid, mid) * 100,
        "median_to_min_pct": safe_div(mid - lo, mid) * 100,
        "rise_then_fall_score": F.least(rise, drop),
        "lag1_autocorr": F.when((sd > 0) & (n > 3), safe_div(F.col("cov"), (n - 1) * sd * sd)).otherwise(0.0),
        "mean_abs_daily_change_pct": F.coalesce("moved", F.lit(0.0)),
        "trend_slope_norm": safe_div(safe_div(F.col("sxy"), F.col("sxx")) * n, mean) * 100,
    }
    keep = lambda c: c if digits is None else rounded(c, digits)
    short = n < 3
    told = [keep(F.when(short, 0.0).otherwise(v)).alias(name) for name, v in values.items()]
    return agg.join(_signature(points.join(levels.select("listing_id"), "listing_id", "left_semi")), "listing_id", "left").select("listing_id", "site_key", "title", *told)
