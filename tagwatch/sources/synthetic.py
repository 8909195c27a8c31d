"""Synthetic observations with planted inflations: seeded by hashes of listing and day, so every task draws the same."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tagwatch.functions.numbers import computed_discount, date_key, rounded

# Catalogue of the fixture: (title, price).  Fixed values.
CATALOGUE = tuple((f"Device {k}", 1500.0 * 1.32**k) for k in range(18))
SITES = ("site_a", "site_b", "site_c")


def uniform(*parts) -> Column:
    """A number in [0, 1) that depends on the parts alone."""
    return F.pmod(F.xxhash64(*[p if isinstance(p, Column) else F.lit(p) for p in parts]), F.lit(1_000_003)) / 1_000_003.0


def listings(spark: SparkSession, seed: int, inflation_rate: float, honest_rate: float, mrp_rate: float, days: int) -> DataFrame:
    titles = spark.createDataFrame([(k, t, p) for k, (t, p) in enumerate(CATALOGUE)], "product_id long, title string, base double")
    each = titles.select("*", F.explode(F.array(*[F.lit(s) for s in SITES])).alias("site_key"))
    u = lambda name: uniform(seed, name, F.col("product_id"), F.col("site_key"))
    each = each.where(u("kept") < 0.8).withColumn("listing_id", F.row_number().over(Window.orderBy("product_id", "site_key")).cast("long"))
    start = int(days * 0.72)
    kind = F.when(u("kind") < inflation_rate, "inflated").when(u("honest") < honest_rate, "honest").otherwise("plain")
    return each.select(
        "listing_id",
        "product_id",
        "site_key",
        "title",
        (F.col("base") * (0.95 + 0.1 * u("level"))).alias("base"),
        kind.alias("kind"),
        (8 + F.floor(13 * u("lead"))).cast("int").alias("lead"),
        (1.10 + 0.25 * u("rise")).alias("rise"),
        (0.80 + 0.13 * u("cut")).alias("cut"),
        F.when(u("mrp") < mrp_rate, 1.12 + 0.43 * u("mrp2")).otherwise(1.0).alias("mrp_factor"),
        F.lit(start).alias("sale_day"),
    )


def generate(spark: SparkSession, days: int = 90, end: str = "2026-09-30", seed: int = 42, inflation_rate: float = 0.22, honest_rate: float = 0.30, mrp_rate: float = 0.25) -> tuple[DataFrame, DataFrame]:
    """(observations, planted truth)."""
    each = listings(spark, seed, inflation_rate, honest_rate, mrp_rate, days)
    rows = each.select("*", F.explode(F.sequence(F.lit(0), F.lit(days - 1))).alias("t"))
    u = lambda name: uniform(seed, name, F.col("listing_id"), F.col("t"))
    t, sale = F.col("t"), F.col("sale_day")
    on_sale = (t >= sale) & (t < sale + 8)
    level = (
        F.when((F.col("kind") == "inflated") & on_sale, F.lit(0.985))
        .when((F.col("kind") == "inflated") & (t >= sale - F.col("lead")) & (t < sale), F.col("rise"))
        .when((F.col("kind") == "honest") & on_sale, F.col("cut"))
        .otherwise(1.0)
    )
    price = rounded(F.col("base") * level * (1 + 0.01 * (u("noise") - 0.5)) * (1 - 0.0002 * t))
    day = F.date_add(F.date_sub(F.lit(end).cast("date"), days - 1), t)
    mrp = rounded(F.col("base") * 1.3 * F.col("mrp_factor"), 0)
    obs = rows.where(u("missing") >= 0.04).select(
        "listing_id", "product_id", F.col("product_id").alias("seller_id"), "site_key", "title", F.lit("synthetic").alias("category"), day.alias("obs_date"), date_key(day).alias("date_key"),
        price.alias("selling_price"), mrp.alias("mrp"), computed_discount(price, mrp).alias("computed_discount_pct"), F.lit("synthetic").alias("source"),
    )
    base, peak, sold = rounded(F.col("base")), rounded(F.col("base") * F.col("rise")), rounded(F.col("base") * 0.985)
    truth = each.where("kind = 'inflated'").select(
        "listing_id", "site_key", "title", base.alias("baseline"), peak.alias("peak"), sold.alias("sale"), rounded(((peak - sold) / peak - (base - sold) / base) * 100).alias("true_overstatement_pp")
    )
    return obs, truth


def counters(obs: DataFrame) -> DataFrame:
    """Scarcity claims by listing_id % 3: a static counter, one that falls, none."""
    k = F.col("listing_id") % 3
    left = F.datediff("obs_date", F.min("obs_date").over(Window.partitionBy("listing_id")))
    value = F.when(k == 0, 3.0).otherwise(F.greatest(20 - F.pmod(left, F.lit(20)), F.lit(1)).cast("double"))
    return obs.where(k != 2).select("listing_id", "site_key", F.lit("stock_claim").alias("pattern_type"), F.col("obs_date").cast("timestamp").alias("at"), F.lit(0).alias("seq"), value.alias("numeric_value"), "source")


def items(spark: SparkSession, days: int = 90, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """The observations as items to ingest, with their counters as claims, and the planted truth by the listings' ids in the warehouse."""
    obs, truth = generate(spark, days, seed=seed)
    url = F.concat(F.lit("https://"), F.col("site_key"), F.lit(".example/p/"), F.col("listing_id").cast("string"))
    said = counters(obs).select("listing_id", F.col("at").cast("date").alias("obs_date"), F.array(F.struct(F.col("pattern_type").alias("kind"), F.format_string("only %.0f left", "numeric_value").alias("text"), F.col("numeric_value").alias("value"))).alias("dark_patterns"))
    rows = obs.join(said, ["listing_id", "obs_date"], "left").select(
        F.col("listing_id").alias("seq"), "site_key", url.alias("url"), F.col("title").alias("raw_title"), "selling_price", "mrp", F.lit(None).cast("double").alias("discount_pct"), "category",
        F.lit(None).cast("string").alias("site_product_id"), F.lit(1).alias("in_stock"), F.lit(None).cast("double").alias("rating"), F.lit(None).cast("int").alias("rating_count"),
        F.lit(None).cast("string").alias("seller_name"), "dark_patterns", F.lit(None).cast("string").alias("raw_snapshot"), "source", "obs_date",
    )
    return rows, truth.withColumn("listing_id", F.xxhash64("site_key", url))
