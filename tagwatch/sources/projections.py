"""Test tables projected onto the price-observation model.  Every projection is one DataFrame, lazily."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagwatch.functions.numbers import computed_discount, date_key, exact_avg, rounded
from tagwatch.operators.calendar import calendar

WINDOWS = [("New Year sale", "2024-01-01", "2024-01-05"), ("Republic Day sale", "2024-01-18", "2024-01-26")]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dates(spark: SparkSession) -> DataFrame:
    return calendar(spark, "2024-01-01", "2024-03-31", WINDOWS)


def user_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations of ``events``: a listing for each user, its mean value of a day as price and the largest as list price."""
    e = table(spark, sf_dir, "events")
    days = e.groupBy(F.col("user_id").alias("listing_id"), F.col("ts").cast("date").alias("obs_date")).agg(rounded(exact_avg(F.col("value"))).alias("selling_price"), F.max("value").alias("mrp"))
    site = F.concat(F.lit("site"), (F.col("listing_id") % 5).cast("string"))
    return days.select(
        "listing_id",
        (F.col("listing_id") % 50).alias("product_id"),
        (F.col("listing_id") % 5).alias("seller_id"),
        site.alias("site_key"),
        F.concat(F.lit("item "), F.col("listing_id").cast("string")).alias("title"),
        F.concat(F.lit("category"), (F.col("listing_id") % 4).cast("string")).alias("category"),
        "obs_date",
        date_key(F.col("obs_date")).alias("date_key"),
        "selling_price",
        "mrp",
        computed_discount(F.col("selling_price"), F.col("mrp")).alias("computed_discount_pct"),
        F.when(F.col("listing_id") % 10 == 9, "wayback").otherwise("live").alias("source"),
    )


def region_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """List prices of parts by region of the supplier: a product for each part, a site for each region."""
    li, su, na, re, pa = (table(spark, sf_dir, t) for t in ("lineitem", "supplier", "nation", "region", "part"))
    sites = su.join(na, su.s_nationkey == na.n_nationkey).join(re, na.n_regionkey == re.r_regionkey).select("s_suppkey", F.col("r_name").alias("site_key"))
    unit = rounded(F.col("l_extendedprice") / F.nullif(F.col("l_quantity"), F.lit(0.0)))
    lines = li.select("l_partkey", "l_suppkey", "l_shipdate", unit.alias("unit")).join(sites, F.col("l_suppkey") == F.col("s_suppkey"))
    return lines.join(pa.select("p_partkey", "p_name", "p_brand", "p_type", "p_retailprice"), F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("l_partkey").alias("product_id"),
        F.col("l_suppkey").alias("listing_id"),
        "site_key",
        F.col("unit").alias("mrp"),
        rounded(F.col("unit") * 0.9).alias("selling_price"),
        F.col("p_retailprice").alias("list_price"),
        F.col("p_name").alias("canonical_title"),
        F.col("p_brand").alias("brand"),
        F.col("p_type").alias("model"),
        (F.year("l_shipdate") * 10000 + 101).cast("int").alias("date_key"),
    )


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scarcity claims of ``events``: coarse values, so that runs repeat."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("user_id").alias("listing_id"),
        F.concat(F.lit("site"), (F.col("user_id") % 5).cast("string")).alias("site_key"),
        F.col("event_type").alias("pattern_type"),
        F.col("ts").alias("at"),
        F.col("event_id").alias("seq"),
        F.floor(F.col("value") / 100).cast("double").alias("numeric_value"),
        F.lit("live").alias("source"),
    )


def quarter_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations of ``lineitem`` over its years: a listing for each supplier, a site for each of their nations, the least unit price of a day."""
    li, su = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "supplier")
    unit = rounded(F.col("l_extendedprice") / F.nullif(F.col("l_quantity"), F.lit(0.0)))
    days = li.groupBy(F.col("l_suppkey").alias("listing_id"), F.col("l_shipdate").cast("date").alias("obs_date")).agg(F.min(unit).alias("selling_price"))
    sites = su.select(F.col("s_suppkey").alias("listing_id"), F.concat(F.lit("nation"), F.col("s_nationkey").cast("string")).alias("site_key"))
    return days.join(sites, "listing_id").select("listing_id", "site_key", "obs_date", date_key(F.col("obs_date")).alias("date_key"), "selling_price", F.lit("live").alias("source"))
