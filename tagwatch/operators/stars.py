"""Joins of the warehouse's facts with their dimensions: what the analyses read."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagwatch.operators import marts, scarcity, timeline
from tagwatch.sources.warehouse import Warehouse


def observations(house: Warehouse) -> DataFrame:
    """Fact, listing, product and date: a row for each observation.  Only the date dimension, one row a day, is broadcast."""
    fact, listing, product, date = (house.read(t) for t in ("fact_price_observation", "dim_listing", "dim_product", "dim_date"))
    listing = listing.select("listing_id", "site_key", "url", "raw_title", "is_active", "first_seen_date")
    product = product.select("product_id", "category", "brand", "model", "variant", "canonical_title")
    date = date.select("date_key", F.col("date").alias("obs_date"), "is_festival", "festival_window")
    joined = fact.join(listing, "listing_id").join(product, "product_id").join(F.broadcast(date), "date_key")
    return joined.withColumn("title", F.coalesce("canonical_title", "raw_title"))


def claims(house: Warehouse) -> DataFrame:
    """Scarcity fact, listing, its product, and date."""
    fact, listing, product, date = (house.read(t) for t in ("fact_dark_pattern", "dim_listing", "dim_product", "dim_date"))
    joined = fact.join(listing.select("listing_id", "product_id", "site_key", "raw_title"), "listing_id")
    joined = joined.join(product.select("product_id", "category", "canonical_title"), "product_id").join(F.broadcast(date.select("date_key", F.col("date").alias("obs_date"))), "date_key")
    return joined.select("*", F.coalesce("canonical_title", "raw_title").alias("title"), F.col("scraped_at").alias("at"), F.col("pattern_id").alias("seq"))


def events(house: Warehouse) -> DataFrame:
    """Stored inflation events with listing and product."""
    event, listing, product = (house.read(t) for t in ("inflation_event", "dim_listing", "dim_product"))
    listing = listing.select("listing_id", "site_key", "url", "raw_title")
    joined = event.join(listing, "listing_id").join(product.select("product_id", "category", "brand", "canonical_title"), "product_id")
    return joined.withColumn("title", F.coalesce("canonical_title", "raw_title"))


def latest_day(obs: DataFrame, source: str | None = "live") -> DataFrame:
    """The observations of the last day that has any of the source: one row of a maximum, joined."""
    own = obs if source is None else obs.where(F.col("source") == source)
    last = own.agg(F.max("date_key").alias("date_key"))
    return own.join(F.broadcast(last), "date_key")


def active_listings(house: Warehouse, site_key: str | None = None) -> DataFrame:
    """Listings that the panel visits."""
    active = house.read("dim_listing").where("is_active = 1")
    return active if site_key is None else active.where(F.col("site_key") == site_key)


def export_dates(house: Warehouse, today: str) -> DataFrame:
    """Days that have observations, or lie between 120 days before today and 60 after."""
    used = house.read("fact_price_observation").select("date_key").distinct().withColumn("used", F.lit(True))
    day = F.lit(today).cast("date")
    near = F.col("date").between(F.date_sub(day, 120), F.date_add(day, 60))
    return house.read("dim_date").join(used, "date_key", "left").where(F.col("used") | near).drop("used")


#: What an export takes of each table; None: all columns.
EXPORTS = {
    "dim_product": "product_id match_key brand model variant category canonical_title first_seen_date",
    "dim_seller": None,
    "dim_listing": "listing_id product_id seller_id site_key url raw_title first_seen_date last_seen_date is_active",
    "dim_date": None,
    "fact_price_observation": "observation_id listing_id date_key product_id seller_id selling_price mrp discount_pct computed_discount_pct in_stock source",
    "fact_dark_pattern": "pattern_id listing_id date_key pattern_type raw_text numeric_value",
    "inflation_event": "event_id run_id listing_id product_id baseline_price peak_price sale_price rise_pct claimed_discount_pct real_discount_pct discount_overstatement_pp rise_start_date sale_start_date days_between confidence manually_reviewed reviewer_verdict",
    "mrp_contradiction": None,
    "analysis_run": None,
}


def exports(house: Warehouse, today: str, include_synthetic: bool = False) -> dict[str, DataFrame]:
    """The nine projections of an export; without synthetic rows only live observations."""
    out = {}
    for name, columns in EXPORTS.items():
        rows = export_dates(house, today) if name == "dim_date" else house.read(name)
        if name == "fact_price_observation" and not include_synthetic:
            rows = rows.where("source = 'live'")
        out[name] = rows.select(*columns.split()) if columns else rows
    return out


def create_views(house: Warehouse) -> list[str]:
    """The five reporting views, over stars and marts; the events are those stored, not found anew."""
    obs, found = observations(house), events(house)
    flagged = found.withColumnRenamed("sale_start_date", "sale_start")
    views = {
        "vw_daily_prices": timeline.daily_prices(obs),
        "vw_discount_integrity": found.select("event_id", "run_id", "listing_id", "product_id", "site_key", "category", "title", "baseline_price", "peak_price", "sale_price", "claimed_discount_pct", "real_discount_pct", "discount_overstatement_pp", "confidence", "reviewer_verdict"),
        "vw_scarcity_claims": scarcity.mart(claims(house)),
        "vw_collection_health": marts.collection_health(obs),
        "vw_category_summary": marts.category_summary(obs, flagged),
    }
    for name, df in views.items():
        df.createOrReplaceTempView(name)
    return list(views)
