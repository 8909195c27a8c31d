"""List prices: dispersion across sellers, contradictions, and how product-specific a retailer's list prices are."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tagwatch.functions.numbers import ends_in_99, exact_avg, pct, rounded

#: Parts in which a site's list prices are ranked first.
SALTS = 64


def one_quote_per_site(quotes: DataFrame, by: str = "least") -> DataFrame:
    """A quote for each product and site: the least list price, or (by="first") that of the least listing."""
    valid = quotes.where(F.col("mrp") > 0)
    if by == "least":
        picked = valid.groupBy("product_id", "site_key").agg(F.min("listing_id").alias("listing_id"), F.min("mrp").alias("mrp"), F.min("selling_price").alias("selling_price"), F.min("canonical_title").alias("canonical_title"), F.min("brand").alias("brand"))
    else:
        row = F.min(F.struct("listing_id", "mrp", "selling_price", "canonical_title", "brand"))
        picked = valid.groupBy("product_id", "site_key").agg(row.alias("q")).select("product_id", "site_key", "q.*")
    return picked


def dispersion(quotes: DataFrame, min_sellers: int = 3, tolerance_pct: float = 2.0) -> DataFrame:
    """One row per product whose sellers disagree, at the site that quotes most (ties: first by name)."""
    sites = one_quote_per_site(quotes)
    product = Window.partitionBy("product_id")
    ranked = sites.select(
        "*",
        F.count("*").over(product).alias("n_sellers"),
        F.min("mrp").over(product).alias("low"),
        F.max("mrp").over(product).alias("high"),
        F.row_number().over(product.orderBy(F.desc("mrp"), "site_key")).alias("rn"),
        F.median("mrp").over(product).alias("mid"),
    )
    mid, low, high = F.col("mid"), F.col("low"), F.col("high")
    return ranked.where((F.col("rn") == 1) & (F.col("n_sellers") >= min_sellers) & (pct(high - low, mid) > tolerance_pct)).select(
        "product_id",
        "canonical_title",
        "brand",
        "n_sellers",
        rounded(low).alias("min_mrp"),
        rounded(mid).alias("median_mrp"),
        rounded(high).alias("max_mrp"),
        rounded(pct(high - low, mid)).alias("spread_pct"),
        F.col("site_key").alias("highest_quoting_site"),
        rounded(pct(F.col("mrp") - mid, mid)).alias("overstatement_vs_median_pct"),
        rounded(pct(F.col("mrp") - F.col("selling_price"), F.col("mrp"))).alias("claimed_discount_pct"),
        rounded(pct(mid - F.col("selling_price"), mid)).alias("discount_vs_median_mrp_pct"),
    )


def contradictions(quotes: DataFrame, tolerance_pct: float = 2.0, min_sellers: int = 3) -> DataFrame:
    """Products whose sites' first quotes differ by more than the tolerance; only confidently matched ones (brand and model known)."""
    sure = F.col("brand").isNotNull() & F.col("model").isNotNull()
    sites = one_quote_per_site(quotes.where(sure), by="first")
    worst = F.min_by(F.struct("listing_id", "site_key", "mrp"), F.struct(F.negate("mrp").alias("down"), F.col("site_key").alias("site")))
    found = sites.groupBy("product_id").agg(
        F.min("canonical_title").alias("canonical_title"),
        F.count("*").alias("n_sellers"),
        F.min("mrp").alias("min_mrp"),
        F.max("mrp").alias("max_mrp"),
        F.median("mrp").alias("median_mrp"),
        worst.alias("worst"),
    )
    mid = F.col("median_mrp")
    return (
        found.where((F.col("n_sellers") >= min_sellers) & (mid > 0) & (pct(F.col("max_mrp") - F.col("min_mrp"), mid) > tolerance_pct))
        .select(
            "product_id",
            "canonical_title",
            "n_sellers",
            "min_mrp",
            "max_mrp",
            rounded(mid, 4).alias("median_mrp"),
            rounded(pct(F.col("max_mrp") - F.col("min_mrp"), mid)).alias("spread_pct"),
            F.col("worst.listing_id").alias("worst_listing_id"),
            F.col("worst.site_key").alias("worst_site_key"),
            rounded(pct(F.col("worst.mrp") - mid, mid)).alias("inflation_vs_median_pct"),
        )
    )


def contradictions_by_site(found: DataFrame) -> DataFrame:
    return found.groupBy(F.col("worst_site_key").alias("site_key")).agg(F.count("*").alias("n_highest_quotes"))


def contradictions_summary(found: DataFrame) -> DataFrame:
    return found.agg(
        F.count("*").alias("n_contradictions"),
        rounded(F.median("spread_pct")).alias("median_spread_pct"),
        F.max("spread_pct").alias("max_spread_pct"),
        rounded(exact_avg(F.col("inflation_vs_median_pct"))).alias("mean_overstatement_pct"),
    )


def latest_per_listing(obs: DataFrame) -> DataFrame:
    """Rows of each listing's last day of any kind, then those with both prices."""
    last = F.max("date_key").over(Window.partitionBy("listing_id"))
    return obs.withColumn("last_key", last).where(F.col("date_key") == F.col("last_key")).where((F.col("mrp") > 0) & F.col("selling_price").isNotNull()).drop("last_key")


def credibility(obs: DataFrame, sources: tuple[str, ...] | None = ("live",)) -> DataFrame:
    """One profile per site of what its list prices on each listing's last day look like.

    The frequency table is aggregated first, so a site's rows meet only as counts of distinct values.
    """
    rows = latest_per_listing(obs)
    rows = rows if sources is None else rows.where(F.col("source").isin(*sources))
    values = rows.groupBy("site_key", "mrp").agg(F.count("*").alias("n"))
    counts = values.groupBy("site_key").agg(
        F.sum("n").alias("n_products"), F.count("*").alias("n_distinct_mrp"), F.sum(F.when(ends_in_99(F.col("mrp")), F.col("n")).otherwise(0)).alias("n_99")
    )
    top = counts.join(commonest(values, 5).groupBy("site_key").agg(F.sum("n").alias("top5")), "site_key")
    discounts = rows.groupBy("site_key").agg(
        F.median("computed_discount_pct").alias("mid"), F.min("computed_discount_pct").alias("low"), F.max("computed_discount_pct").alias("high")
    )
    n = F.col("n_products").cast("double")
    out = top.join(discounts, "site_key").select(
        "site_key",
        "n_products",
        "n_distinct_mrp",
        rounded(F.col("n_distinct_mrp") / n, 4).alias("diversity_ratio"),
        rounded(F.col("top5") / n, 4).alias("top5_concentration"),
        rounded(F.col("n_99") / n, 4).alias("round_number_rate"),
        F.coalesce(rounded(F.col("mid")), F.lit(0.0)).alias("median_discount_pct"),
        F.coalesce(rounded(F.col("low")), F.lit(0.0)).alias("min_discount_pct"),
        F.coalesce(rounded(F.col("high")), F.lit(0.0)).alias("max_discount_pct"),
    )
    return out.withColumn("verdict", verdict())


def commonest(values: DataFrame, k: int) -> DataFrame:
    """The k commonest list prices of each site with their place; of equal ones the smaller.

    First within SALTS parts of a site, so that no task sorts all prices of one, then among the parts' k.
    """
    order = F.desc("n"), "mrp"
    salted = values.withColumn("salt", F.pmod(F.xxhash64("mrp"), F.lit(SALTS)))
    near = salted.withColumn("place", F.row_number().over(Window.partitionBy("site_key", "salt").orderBy(*order))).where(F.col("place") <= k)
    return near.withColumn("place", F.row_number().over(Window.partitionBy("site_key").orderBy(*order))).where(F.col("place") <= k).drop("salt")


def verdict():
    # the wording and the bounds are fixed values
    return (
        F.when(F.col("n_products") < 20, "insufficient")
        .when((F.col("diversity_ratio") < 0.35) & (F.col("top5_concentration") > 0.50), "inconsistent with product-specific pricing")
        .when(F.col("diversity_ratio") < 0.60, "unusually concentrated")
        .otherwise("consistent with product-specific pricing")
    )


def most_repeated(obs: DataFrame, k: int = 6) -> DataFrame:
    """The k commonest list prices of each site that occur more than once."""
    values = latest_per_listing(obs.where(F.col("source") == "live")).groupBy("site_key", "mrp").agg(F.count("*").alias("n"))
    return commonest(values, k).where("n > 1")


def compare(profiles: DataFrame) -> DataFrame:
    """The least and the most diverse retailer; with fewer than two, only a note."""
    key = F.struct("diversity_ratio", "site_key")
    row = F.struct("site_key", "diversity_ratio", "median_discount_pct")
    ends = profiles.agg(F.count("*").alias("n_retailers"), F.min_by(row, key).alias("least"), F.max_by(row, key).alias("most"))
    two = F.col("n_retailers") >= 2
    return ends.select(
        "n_retailers",
        F.when(two, F.col("least.site_key")).alias("least_credible"),
        F.when(two, F.col("most.site_key")).alias("most_credible"),
        F.when(two, rounded(F.col("most.diversity_ratio") - F.col("least.diversity_ratio"), 3)).alias("diversity_gap"),
        F.when(two, rounded(F.col("least.median_discount_pct") - F.col("most.median_discount_pct"), 1)).alias("discount_gap_pp"),
        # the note is a fixed value
        F.when(~two, "comparison needs at least two retailers with MRP data").alias("note"),
    )
