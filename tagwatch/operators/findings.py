"""The findings report: a page of text from a few summary rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from tagwatch.operators import inflation, mrp, scarcity, stars
from tagwatch.sources.warehouse import Warehouse


def report(house: Warehouse, sources: tuple[str, ...] | None = ("live",)) -> str:
    """Markdown over what the warehouse holds; only summaries of one row, or one for each retailer, come to the driver."""
    obs = stars.observations(house)
    seen = obs.agg(F.count("*").alias("n"), F.count_distinct("listing_id").alias("listings"), F.min("obs_date").alias("first"), F.max("obs_date").alias("last")).first()
    found = inflation.events(obs, sources=sources)
    told = inflation.summary(found, obs.agg(F.count_distinct("listing_id"))).first()
    lines = ["# Findings", "", f"_{seen['n']:,} observations of {seen['listings']:,} listings, {seen['first']} to {seen['last']}._", "", "## Discounts after a price rise", ""]
    if told["n_events"]:
        worst = inflation.headline(found).agg(F.max_by("headline", F.struct("overstatement_pp", F.negate("listing_id").alias("id"))).alias("h")).first()["h"]
        lines += [
            f"- {told['n_events']} listings rose before a sale: {told['n_high_confidence']} with high, {told['n_medium_confidence']} with medium, {told['n_low_confidence']} with low confidence",
            f"- median advertised discount {told['median_claimed_discount_pct']} %, against the price before {told['median_real_discount_pct']} %",
            f"- median overstatement {told['median_overstatement_pp']} points",
            "",
            f"> {worst}",
        ]
    else:
        lines.append("_None found; it takes some weeks of prices._")
    lines += ["", "## How product-specific list prices are", ""]
    profiles = mrp.credibility(obs, sources).orderBy("diversity_ratio", "site_key").collect()
    if profiles:
        lines += ["| Retailer | Products | List prices | Diversity | Top five | Median discount | Verdict |", "|-|-|-|-|-|-|-|"]
        lines += [
            f"| {p['site_key']} | {p['n_products']} | {p['n_distinct_mrp']} | {p['diversity_ratio']:.2f} | {p['top5_concentration']:.0%} | {p['median_discount_pct']:.0f} % | {p['verdict']} |" for p in profiles
        ]
        common = mrp.most_repeated(obs, 3).groupBy("site_key").agg(F.array_sort(F.collect_list(F.struct("place", "mrp", "n"))).alias("r")).orderBy("site_key").collect()
        lines += ["", *(f"- {c['site_key']}, most repeated: {', '.join(f'{x.mrp:,.0f} ({x.n} times)' for x in c['r'])}" for c in common)]
    else:
        lines.append("_No list prices yet._")
    claims = scarcity.summary(scarcity.claims(stars.claims(house))).first()
    lines += ["", "## Scarcity claims", ""]
    if claims and claims["n_assessed"]:
        lines.append(f"- of {claims['n_assessed']} counters, {claims['n_static']} never changed")
    else:
        lines.append("_Too few days._")
    return "\n".join([*lines, ""])


def write(house: Warehouse, path: str, sources: tuple[str, ...] | None = ("live",)) -> str:
    """The report as a file; path as any file system of Spark's takes it."""
    spark = house.spark
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at, True)
    out.write(bytearray(report(house, sources).encode()))
    out.close()
    return path
