"""Upserts on plain Parquet: join and overwrite.  Each is idempotent: the same batch twice gives the same table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OBSERVATION_KEY = ("listing_id", "date_key", "source")
#: Columns of which a later value replaces an earlier one, but a null never does.
LATEST = ("selling_price", "mrp", "discount_pct", "computed_discount_pct", "in_stock")


def merge_batch(batch: DataFrame, order: list[str], key: tuple[str, ...] = OBSERVATION_KEY, latest: tuple[str, ...] = LATEST) -> DataFrame:
    """One row per key of a batch: the last value that is not null of ``latest`` columns, the first row's of all others."""
    kept = [c for c in batch.columns if c not in key]
    at, first = F.struct(*order), [c for c in kept if c not in latest]
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), at))
    row = [F.min_by(F.struct(*first), at).alias("__first")] if first else []  # one comparison for all of them
    told = batch.groupBy(*key).agg(*row, *[last(c).alias(c) for c in kept if c in latest])
    return told.select(*[F.col(f"__first.{c}").alias(c) if c in first else F.col(c) for c in batch.columns])


def merge_observations(store: DataFrame, batch: DataFrame, key: tuple[str, ...] = OBSERVATION_KEY, latest: tuple[str, ...] = LATEST) -> DataFrame:
    """store with a batch of one row per key merged in: latest columns take the new value unless null, others keep the old."""
    old, new = store.alias("old"), batch.alias("new")
    on = [F.col(f"old.{c}").eqNullSafe(F.col(f"new.{c}")) for c in key]
    both = old.join(new, on, "full_outer")
    pick = lambda c: F.coalesce(f"new.{c}", f"old.{c}") if c in latest else F.coalesce(f"old.{c}", f"new.{c}")
    return both.select(*[pick(c).alias(c) for c in store.columns])


def first_wins(store: DataFrame | None, batch: DataFrame, key: str, order: list[str]) -> DataFrame:
    """A dimension in which a key, once there, is never touched: of new keys the first row by ``order`` is appended."""
    new = batch if store is None else batch.join(store.select(key), key, "left_anti")
    first = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    new = new.withColumn("__first", first).where("__first = 1").drop("__first").select(*batch.columns)
    return new if store is None else store.unionByName(new)


def with_ids(table: DataFrame, key: list[str], into: str) -> DataFrame:
    """A surrogate id that depends on the natural key alone, so it is the same in every run."""
    return table.withColumn(into, F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in key]))


def upsert_sellers(store: DataFrame, batch: DataFrame) -> DataFrame:
    """(site_key, seller_name) compared null-safely; a seller without a name is the site itself."""
    new = batch.select("site_key", "site_name", "seller_name").dropDuplicates(["site_key", "seller_name"]).alias("n")
    on = F.col("n.site_key").eqNullSafe(F.col("s.site_key")) & F.col("n.seller_name").eqNullSafe(F.col("s.seller_name"))
    added = new.join(store.alias("s"), on, "left_anti").withColumn("is_first_party", F.when(F.col("seller_name").isNull(), 1).otherwise(0))
    return store.unionByName(added)


def upsert_listings(store: DataFrame, batch: DataFrame, order: list[str]) -> DataFrame:
    """(site_key, url): a known listing gets the batch's last day as last_seen_date and is active again; others are added."""
    at = F.struct(*order)
    seen = batch.groupBy("site_key", "url").agg(F.min_by("raw_title", at).alias("raw_title"), F.min_by("seen", at).alias("first_seen"), F.max_by("seen", at).alias("last_seen"))
    old, new = store.alias("o"), seen.alias("n")
    both = old.join(new, ["site_key", "url"], "full_outer")
    return both.select(
        "site_key",
        "url",
        F.coalesce("o.raw_title", "n.raw_title").alias("raw_title"),
        F.coalesce("o.first_seen_date", "n.first_seen").alias("first_seen_date"),
        F.coalesce("n.last_seen", "o.last_seen_date").alias("last_seen_date"),
        F.when(F.col("n.last_seen").isNotNull(), 1).otherwise(F.col("o.is_active")).alias("is_active"),
    )


def append_claims(store: DataFrame, batch: DataFrame) -> DataFrame:
    """Scarcity claims appended once each: by listing, day, kind and text."""
    key = ["listing_id", "date_key", "pattern_type", "raw_text"]
    new = batch.dropDuplicates(key).join(store.select(*key), key, "left_anti")
    return store.unionByName(new)


def update_verdicts(events: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Review results by event_id; verdicts are trimmed and lower-cased, unknown ones ignored."""
    clean = F.lower(F.trim("verdict"))
    known = verdicts.select("event_id", clean.alias("new_verdict"), F.col("reviewer_note").alias("new_note")).where(clean.isin("confirmed", "rejected", "unclear")).dropDuplicates(["event_id"])
    hit = F.col("new_verdict").isNotNull()
    replaced: dict[str, Column] = {
        "manually_reviewed": F.when(hit, 1).otherwise(F.col("manually_reviewed")),
        "reviewer_verdict": F.coalesce("new_verdict", "reviewer_verdict"),
        "reviewer_note": F.when(hit, F.col("new_note")).otherwise(F.col("reviewer_note")),
    }
    return events.join(known, "event_id", "left").select(*[replaced[c].alias(c) if c in replaced else F.col(c) for c in events.columns])


def duplicate_keys(table: DataFrame, key: list[str]) -> DataFrame:
    return table.groupBy(*key).count().where("count > 1")


def orphans(table: DataFrame, parent: DataFrame, key: str) -> DataFrame:
    return table.where(F.col(key).isNotNull()).join(parent.select(key), key, "left_anti")
