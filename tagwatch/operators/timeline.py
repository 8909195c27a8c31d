"""Price timelines: movement and trailing windows of each listing.  All windows share one partitioning and order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagwatch.functions.numbers import exact_avg_of, pct, rounded


def series():
    """A listing's observations in order of days."""
    return Window.partitionBy("listing_id").orderBy("date_key")


def included(obs: DataFrame, sources: tuple[str, ...] | None = ("live",)) -> DataFrame:
    """Observations with a price, of the given sources (None: all); filtered before any window."""
    priced = obs.where(F.col("selling_price").isNotNull())
    return priced if sources is None else priced.where(F.col("source").isin(*sources))


def trailing(first: int, last: int):
    return series().rowsBetween(first, last)


def window_avg(price: Column, frame) -> Column:
    return exact_avg_of(lambda c: F.sum(c).over(frame), lambda c: F.count(c).over(frame), price)


def price_timeline(obs: DataFrame, dates: DataFrame, sources: tuple[str, ...] | None = ("live",)) -> DataFrame:
    price, before = F.col("selling_price"), trailing(-30, -1)
    base = included(obs, sources).join(F.broadcast(dates.select("date_key", "is_festival", "festival_window")), "date_key")  # one row for each day
    moved = base.select(
        "*",
        F.lag("selling_price").over(series()).alias("prev_price"),
        F.lag("obs_date").over(series()).alias("prev_date"),
        F.min(price).over(before).alias("low"),
        F.max(price).over(before).alias("high"),
        window_avg(price, before).alias("mean"),
        F.count("*").over(Window.partitionBy("listing_id")).alias("n_observations"),
    )
    prev, low = F.col("prev_price"), F.col("low")
    return moved.select(
        "listing_id",
        "product_id",
        "site_key",
        "title",
        "category",
        "obs_date",
        "is_festival",
        "festival_window",
        "selling_price",
        "mrp",
        "computed_discount_pct",
        "prev_price",
        rounded(price - prev).alias("price_delta"),
        rounded(pct(price - prev, prev)).alias("price_delta_pct"),
        F.datediff("obs_date", "prev_date").alias("days_since_prev"),
        rounded(low).alias("trailing_min_30"),
        rounded(F.col("high")).alias("trailing_max_30"),
        rounded(F.col("mean")).alias("trailing_avg_30"),
        rounded(pct(price - low, low)).alias("premium_over_trailing_min_pct"),
        "n_observations",
    )


def daily_prices(obs: DataFrame) -> DataFrame:
    """The daily mart: least and greatest price of the last 31 observations."""
    frame = trailing(-30, 0)
    return obs.where(F.col("source") == "live").select(
        "listing_id",
        "product_id",
        "seller_id",
        "date_key",
        "site_key",
        "category",
        "selling_price",
        "mrp",
        "computed_discount_pct",
        "source",
        F.min("selling_price").over(frame).alias("price_min_30d"),
        F.max("selling_price").over(frame).alias("price_max_30d"),
    )


def day_number(day: Column) -> Column:
    return F.datediff(day, F.lit("1970-01-01").cast("date"))


def rolling_daily_avg(obs: DataFrame, days: int = 7) -> DataFrame:
    """Mean of the daily averages of the last ``days`` calendar days, per site."""
    daily = included(obs).groupBy("site_key", "obs_date").agg(rounded(exact_avg_of(F.sum, F.count, F.col("selling_price"))).alias("avg_price"))
    frame = Window.partitionBy("site_key").orderBy(day_number(F.col("obs_date"))).rangeBetween(1 - days, 0)
    return daily.select("site_key", "obs_date", "avg_price", rounded(window_avg(F.col("avg_price"), frame), 4).alias("rolling_avg"))


def price_days_ago(obs: DataFrame, days: int = 30) -> DataFrame:
    """Daily average price per site, that of ``days`` calendar days before, and the change."""
    daily = included(obs).groupBy("site_key", "obs_date").agg(rounded(exact_avg_of(F.sum, F.count, F.col("selling_price"))).alias("avg_price"))
    then = daily.select("site_key", F.date_add("obs_date", days).alias("obs_date"), F.col("avg_price").alias("price_then"))
    return daily.join(then, ["site_key", "obs_date"], "left").select("site_key", "obs_date", "avg_price", "price_then", rounded(pct(F.col("avg_price") - F.col("price_then"), F.col("price_then"))).alias("change_pct"))


def trailing_min_premium(obs: DataFrame, days: int = 30) -> DataFrame:
    """Price against the least of the last ``days`` calendar days, per listing."""
    frame = Window.partitionBy("listing_id").orderBy(day_number(F.col("obs_date"))).rangeBetween(1 - days, 0)
    low = F.min("selling_price").over(frame)
    return included(obs).select("listing_id", "obs_date", "selling_price", low.alias("low")).select("listing_id", "obs_date", "selling_price", F.col("low").alias("trailing_min"), rounded(pct(F.col("selling_price") - F.col("low"), F.col("low"))).alias("premium_pct"))
