"""Ingest: scraped items become products, sellers, listings, observations and claims, in one commit.

An item without a title or link is skipped.  One without a price is a discovery: its listing is
registered and no price recorded.  Within a batch the order of arrival (``seq``) decides what comes first.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagwatch.functions.numbers import computed_discount, date_key
from tagwatch.functions.titles import parse_title
from tagwatch.operators.calendar import calendar
from tagwatch.operators.merge import append_claims, first_wins, merge_batch, merge_observations
from tagwatch.sources.warehouse import Warehouse

ITEM = (
    "seq long, site_key string, url string, raw_title string, selling_price double, mrp double, discount_pct double, category string, site_product_id string, in_stock int, "
    "rating double, rating_count int, seller_name string, dark_patterns array<struct<kind:string,text:string,value:double>>, raw_snapshot string, source string"
)
_CLAIM_KEY = ["listing_id", "date_key", "pattern_type", "raw_text"]


def _id(*parts: str) -> Column:
    """A surrogate id that depends on the natural key alone."""
    return F.xxhash64(*[F.coalesce(F.col(p), F.lit("\0")) for p in parts])


def prepared(items: DataFrame) -> DataFrame:
    """Items that can be stored, with their parsed titles, ids and days.  items: the columns of ITEM and obs_date.

    A title is parsed once for a batch, however many items bear it; the hint keeps a batch of many titles from being broadcast.
    """
    told = items.where((F.col("raw_title") != "") & (F.col("url") != ""))
    parsed = told.select("raw_title").distinct().select("raw_title", parse_title(F.col("raw_title"), apart=True).alias("t"))
    return told.join(parsed.hint("merge"), "raw_title").select(
        "*",
        F.col("t.match_key").alias("match_key"),
        _id("t.match_key").alias("product_id"),
        _id("site_key", "seller_name").alias("seller_id"),
        _id("site_key", "url").alias("listing_id"),
        date_key(F.col("obs_date")).alias("date_key"),
        F.to_timestamp("obs_date").alias("scraped_at"),
    )


def _products(house: Warehouse, rows: DataFrame) -> DataFrame:
    """A known match_key is never touched."""
    columns = ["product_id", "match_key", "brand", "model", "variant", "category", "canonical_title", "first_seen_date", "created_at"]
    named = rows.select(
        "product_id", "match_key", "t.brand", "t.model", "t.variant", F.coalesce(F.nullif("category", F.lit("")), F.lit("unknown")).alias("category"), "t.canonical_title",
        F.col("obs_date").alias("first_seen_date"), F.col("scraped_at").alias("created_at"), "seq",
    )
    old = house.read("dim_product")
    return first_wins(old.withColumn("seq", F.lit(0).cast("long")), named, "match_key", ["first_seen_date", "seq"]).select(*columns)


def _sellers(house: Warehouse, rows: DataFrame, site_names: Mapping[str, str]) -> DataFrame:
    """A seller without a name is the site itself."""
    name = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in site_names.items() for x in pair]), F.col("site_key")), F.col("site_key")) if site_names else F.col("site_key")
    new = rows.select("seller_id", "site_key", name.alias("site_name"), "seller_name").dropDuplicates(["seller_id"])
    new = new.withColumn("is_first_party", F.col("seller_name").isNull().cast("int"))
    old = house.read("dim_seller")
    return old.unionByName(new.join(old.select("seller_id"), "seller_id", "left_anti"))


def _listings(house: Warehouse, rows: DataFrame) -> DataFrame:
    """A known listing gets the batch's last day and is active again; its product and seller stay."""
    at = F.struct("obs_date", "seq")
    kept = ("product_id", "seller_id", "site_key", "site_product_id", "url", "raw_title")
    seen = rows.groupBy("listing_id").agg(F.min_by(F.struct(*kept), at).alias("n"), F.min("obs_date").alias("first"), F.max("obs_date").alias("last"))
    both = house.read("dim_listing").join(seen, "listing_id", "full_outer")
    return both.select(
        "listing_id",
        *[F.coalesce(F.col(c), F.col(f"n.{c}")).alias(c) for c in kept],
        F.coalesce("first_seen_date", "first").alias("first_seen_date"),
        F.coalesce("last", "last_seen_date").alias("last_seen_date"),
        F.when(F.col("last").isNotNull(), 1).otherwise(F.col("is_active")).alias("is_active"),
    )


def _observations(house: Warehouse, rows: DataFrame) -> DataFrame:
    old = house.read("fact_price_observation")
    new = rows.where("selling_price is not null").withColumn("observation_id", F.xxhash64("listing_id", "date_key", "source"))
    new = new.withColumn("computed_discount_pct", computed_discount(F.col("selling_price"), F.col("mrp")))
    batch = merge_batch(new.select(*old.columns, "seq"), ["seq"]).drop("seq")
    # a key that is there already keeps its ratings and page; the time is that of the last arrival
    latest = ("selling_price", "mrp", "discount_pct", "computed_discount_pct", "in_stock", "scraped_at")
    return merge_observations(old, batch, latest=latest)


def _claims(house: Warehouse, rows: DataFrame) -> DataFrame:
    old = house.read("fact_dark_pattern")
    told = rows.where("selling_price is not null").select("listing_id", "date_key", "scraped_at", "source", "seq", F.explode("dark_patterns").alias("p"))
    new = told.select(F.col("p.kind").alias("pattern_type"), F.col("p.text").alias("raw_text"), F.col("p.value").alias("numeric_value"), "listing_id", "date_key", "scraped_at", "source", "seq")
    new = new.groupBy(*_CLAIM_KEY).agg(F.min_by(F.struct("numeric_value", "scraped_at", "source"), "seq").alias("n")).withColumn("pattern_id", F.xxhash64(*_CLAIM_KEY))
    return append_claims(old, new.select("*", "n.*").select(*old.columns))


def upsert_dates(house: Warehouse, first: str, last: str, windows: list[tuple[str, str, str]]) -> DataFrame:
    """The date dimension over the days; of days that are there already only the three festival columns change."""
    new, old = calendar(house.spark, first, last, windows), house.read("dim_date")
    festival = ("festival_window", "is_festival", "days_to_festival")
    both = old.alias("o").join(new.alias("n"), "date_key", "full_outer")
    hit = F.col("n.date").isNotNull()
    pick = lambda c: F.when(hit, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")) if c in festival else F.coalesce(f"o.{c}", f"n.{c}")
    return both.select("date_key", *[pick(c).alias(c) for c in old.columns if c != "date_key"])


def store_items(house: Warehouse, items: DataFrame, windows: list[tuple[str, str, str]] = (), site_names: Mapping[str, str] | None = None) -> DataFrame:
    """Stage a batch of items; one row of counters: stored, skipped, discovered, products_created, dark_patterns."""
    given = house.scratch(items)  # whatever they are made of is run once
    rows = house.scratch(prepared(given))  # parsed once, read by each merge
    known = house.read("dim_product").select("match_key")
    stored = F.col("selling_price").isNotNull()
    told = rows.agg(
        F.count_if(stored).alias("stored"),
        F.count_if(~stored).alias("discovered"),
        F.coalesce(F.sum(F.when(stored, F.greatest(F.size(F.coalesce("dark_patterns", F.array().cast("array<struct<kind:string,text:string,value:double>>"))), F.lit(0)))), F.lit(0)).cast("long").alias("dark_patterns"),
        F.min("obs_date").cast("string").alias("first"),
        F.max("obs_date").cast("string").alias("last"),
    ).first()
    created = rows.select("match_key").distinct().join(known, "match_key", "left_anti").count()
    skipped = given.count() - told["stored"] - told["discovered"]
    if told["first"]:
        house.write("dim_date", upsert_dates(house, told["first"], told["last"], list(windows)))
        for name, made in (("dim_product", _products(house, rows)), ("dim_seller", _sellers(house, rows, site_names or {})), ("dim_listing", _listings(house, rows))):
            house.write(name, made)
        house.write("fact_price_observation", _observations(house, rows))
        house.write("fact_dark_pattern", _claims(house, rows))
    house.clear()
    return house.spark.createDataFrame(
        [(told["stored"], skipped, created, told["dark_patterns"], told["discovered"])], "stored long, skipped long, products_created long, dark_patterns long, discovered long"
    )


def activate(house: Warehouse, listings: DataFrame) -> DataFrame:
    """Stage dim_listing with these listing_ids active (the panel)."""
    chosen = listings.select("listing_id").distinct().withColumn("chosen", F.lit(1))
    table = house.read("dim_listing").join(chosen, "listing_id", "left")
    return house.write("dim_listing", table.withColumn("is_active", F.when(F.col("chosen") == 1, 1).otherwise(F.col("is_active"))).drop("chosen"))


def append_run(house: Warehouse, run: DataFrame, **found: DataFrame) -> None:
    """Stage an analysis run with what it found; found: inflation_event or mrp_contradiction, without run_id."""
    row = run.first()
    house.write("analysis_run", house.read("analysis_run").unionByName(run))
    for name, rows in found.items():
        old = house.read(name)
        given = rows.withColumn("run_id", F.lit(row["run_id"]).cast("long"))
        key = "event_id" if name == "inflation_event" else "contradiction_id"
        given = given.withColumn(key, F.xxhash64("run_id", "product_id", *(["listing_id", "sale_start_date"] if name == "inflation_event" else ["date_key"])))
        missing = [c for c in old.columns if c not in given.columns]
        given = given.withColumns({c: F.lit(0 if c == "manually_reviewed" else None).cast(dict(old.dtypes)[c]) for c in missing})
        house.write(name, old.unionByName(given.select(*old.columns)))
