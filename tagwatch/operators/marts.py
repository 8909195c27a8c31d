"""Reporting marts, status queries and the documented BI measures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagwatch.functions.numbers import exact_avg, pct, rounded
from tagwatch.operators.timeline import included


def collection_health(obs: DataFrame) -> DataFrame:
    return obs.where(F.col("source") == "live").groupBy("date_key", "site_key").agg(
        F.count("*").alias("observations"),
        F.count_distinct("listing_id").alias("listings_seen"),
        F.count_if(F.col("selling_price").isNull()).alias("missing_price"),
        F.count_if(F.col("mrp").isNull()).alias("missing_mrp"),
        rounded(exact_avg(F.col("selling_price"))).alias("avg_price"),
    )


def category_summary(obs: DataFrame, events: DataFrame, fan_out: bool = True) -> DataFrame:
    """By category and site.  fan_out: the mean discount weighs an observation by its listing's events, as the BI view does."""
    live = obs.where(F.col("source") == "live")
    flagged = events.select("listing_id", F.col("listing_id").alias("flagged"), "sale_start")
    rows = live.join(flagged, "listing_id", "left") if fan_out else live.join(flagged.dropDuplicates(["listing_id"]), "listing_id", "left")
    return rows.groupBy("category", "site_key").agg(
        F.count_distinct("listing_id").alias("listings_tracked"),
        F.count_distinct("product_id").alias("products_tracked"),
        rounded(exact_avg(F.col("computed_discount_pct"))).alias("avg_advertised_discount_pct"),
        F.count_distinct("flagged", "sale_start").alias("flagged_events"),
        rounded(pct(F.count_distinct("flagged").cast("double"), F.count_distinct("listing_id").cast("double"))).alias("pct_listings_flagged"),
    )


def discount_integrity(events: DataFrame) -> DataFrame:
    columns = [c for c in events.columns if c != "evidence"]
    return events.select(
        *columns,
        rounded(F.col("peak_price") - F.col("baseline_price")).alias("rupees_of_inflation"),
        F.when(F.col("confidence") == "high", 3).when(F.col("confidence") == "medium", 2).otherwise(1).alias("confidence_rank"),
    )


def status_by_source(obs: DataFrame) -> DataFrame:
    return obs.groupBy("source").agg(F.count("*").alias("observations"), F.min("obs_date").alias("first_date"), F.max("obs_date").alias("last_date"))


def last_days(obs: DataFrame, n: int = 14) -> DataFrame:
    """The n latest live days with their numbers of observations: a report's limit."""
    return obs.where(F.col("source") == "live").groupBy("obs_date").agg(F.count("*").alias("observations")).orderBy(F.desc("obs_date")).limit(n)


def coverage(obs: DataFrame, sites: list[str]) -> DataFrame:
    """Observations by day, a column for each site."""
    return obs.groupBy("obs_date").pivot("site_key", sites).agg(F.count(F.lit(1))).na.fill(0, sites)


def describe(rows: DataFrame, by: str, value: str) -> DataFrame:
    return rows.groupBy(by).agg(F.count(value).alias("n"), rounded(exact_avg(F.col(value)), 4).alias("mean"), F.median(value).alias("median"), F.max(value).alias("max"))


def histogram(rows: DataFrame, value: str, low: float, high: float, bins: int = 40) -> DataFrame:
    """Equal bins of [low, high); what lies outside counts in the nearest."""
    at = F.least(F.greatest(F.floor((F.col(value) - low) / ((high - low) / bins)), F.lit(0)), F.lit(bins - 1))
    return rows.where(F.col(value).isNotNull()).groupBy(at.cast("int").alias("bin")).agg(F.count("*").alias("n"))


def headline_measures(obs: DataFrame, events: DataFrame) -> DataFrame:
    """One row of the dashboard's cards."""
    live = obs.where(F.col("source") == "live")
    seen = live.agg(
        F.count_distinct("listing_id").alias("listings_tracked"),
        F.count("*").alias("observations"),
        rounded(exact_avg(F.col("selling_price"))).alias("avg_price"),
        rounded(exact_avg(F.col("computed_discount_pct"))).alias("avg_advertised_discount"),
    )
    solid = F.col("confidence").isin("high", "medium")
    flagged = events.agg(
        F.count_distinct(F.when(solid, F.col("listing_id"))).alias("flagged_listings"),
        rounded(F.median(F.when(solid, F.col("overstatement_pp")))).alias("median_overstatement"),
        rounded(exact_avg(F.col("claimed_discount_pct")) - exact_avg(F.col("real_discount_pct"))).alias("claimed_minus_real"),
    )
    return seen.join(flagged).withColumn("flagged_rate_pct", rounded(pct(F.col("flagged_listings").cast("double"), F.col("listings_tracked").cast("double"))))


def festival_uplift(obs: DataFrame, dates: DataFrame) -> DataFrame:
    rows = included(obs).join(F.broadcast(dates.select("date_key", "is_festival")), "date_key")  # one row for each day
    side = lambda k: exact_avg(F.when(F.col("is_festival") == k, F.col("computed_discount_pct")))
    return rows.groupBy("site_key").agg(rounded(side(1)).alias("festival_discount"), rounded(side(0)).alias("other_discount"), rounded(side(1) - side(0)).alias("uplift_pp"))


def what_if(events: DataFrame, thresholds: int = 41) -> DataFrame:
    """Listings whose rise reaches each threshold of 0 to thresholds - 1 percent.

    Each event is counted once at its highest whole threshold, and the counts are summed from above.
    """
    top = F.least(F.floor("rise_pct"), F.lit(thresholds - 1)).cast("int")
    highest = events.where("rise_pct >= 0").groupBy("listing_id").agg(F.max(top).alias("threshold"))
    counts = highest.groupBy("threshold").agg(F.count("*").alias("n"))
    grid = events.sparkSession.range(thresholds).select(F.col("id").cast("int").alias("threshold"))
    from pyspark.sql import Window

    above = Window.orderBy(F.desc("threshold"))  # one row for each threshold
    return grid.join(counts, "threshold", "left").select("threshold", F.sum(F.coalesce("n", F.lit(0))).over(above).alias("n_listings"))


def visible_to(rows: DataFrame, user: str, grants: DataFrame, column: str) -> DataFrame:
    """Row-level security: the rows whose ``column`` is granted to the user.  grants: (user, value)."""
    own = grants.where(F.col("user") == user).select(F.col("value").alias(column)).distinct()
    return rows.join(own, column, "left_semi")


def panel_seed(quotes: DataFrame, min_sites: int, most: int) -> DataFrame:
    """The products on the most sites, a report's limit; ties by id."""
    return quotes.groupBy("product_id").agg(F.count_distinct("site_key").alias("n_sites")).where(F.col("n_sites") >= min_sites).orderBy(F.desc("n_sites"), "product_id").limit(most)


def per_group_limit(rows: DataFrame, group: str, order: list[str], n: int) -> DataFrame:
    from pyspark.sql import Window

    return rows.withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("place") <= n)


def discovery_status(items: DataFrame) -> DataFrame:
    """Stored, discovered (no price) or skipped (no title or link) items."""
    missing = (F.coalesce("raw_title", F.lit("")) == "") | (F.coalesce("url", F.lit("")) == "")
    status = F.when(missing, "skipped").when(F.col("selling_price").isNull(), "discovered").otherwise("stored")
    return items.groupBy(status.alias("status")).agg(F.count("*").alias("n"))


def table_counts(spark: SparkSession, names: list[str]) -> dict[str, int]:
    """Rows of each table; -1 where there is none."""
    return {n: spark.table(n).count() if spark.catalog.tableExists(n) else -1 for n in names}
