"""Registered queries that first ingest a projection of the test tables into a warehouse, and read it by its star joins."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagwatch.functions.numbers import rounded
from tagwatch.operators import inflation, ingest, merge, mrp, pages, stars, timeline, validation
from tagwatch.plans.queries import LOOSE, product_pages, query
from tagwatch.sources.projections import WINDOWS, region_quotes, table, user_days
from tagwatch.sources.tables import run_row, shared_folder
from tagwatch.sources.warehouse import Warehouse


def items(s: SparkSession, d: str) -> DataFrame:
    """Items of the observations: links for most, no price for some, and a second arrival of others on the same day."""
    o, k = user_days(s, d), F.col("listing_id")
    claim = F.array(F.struct(F.lit("stock_claim").alias("kind"), F.lit("only 3 left").alias("text"), F.lit(3.0).alias("value")))
    first = o.select(
        k.alias("seq"),
        "site_key",
        F.when(k % 50 == 8, F.lit("")).otherwise(F.concat(F.lit("https://"), "site_key", F.lit(".example/p/"), k.cast("string"))).alias("url"),
        F.col("title").alias("raw_title"),
        F.when(k % 50 != 7, F.col("selling_price")).alias("selling_price"),
        "mrp",
        F.lit(None).cast("double").alias("discount_pct"),
        "category",
        F.lit(None).cast("string").alias("site_product_id"),
        F.lit(1).alias("in_stock"),
        F.lit(4.5).alias("rating"),
        F.lit(10).alias("rating_count"),
        F.when(k % 3 == 0, F.concat(F.lit("seller "), (k % 7).cast("string"))).alias("seller_name"),
        F.when(k % 3 == 0, claim).alias("dark_patterns"),
        F.lit(None).cast("string").alias("raw_snapshot"),
        "source",
        "obs_date",
    )
    again = first.where("seq % 10 = 1").select(
        *[{"seq": F.col("seq") + 1_000_000, "selling_price": rounded(F.col("selling_price") + 1), "mrp": F.lit(None).cast("double")}.get(c, F.col(c)).alias(c) for c in first.columns]
    )
    return first.unionByName(again)


#: Warehouses that queries of one application share, by application and tables.
_SHARED: dict[tuple[str, str], tuple[str, DataFrame]] = {}


def ingested(s: SparkSession, d: str) -> tuple[Warehouse, DataFrame]:
    """A warehouse of the items, for reading, and the last commit's counters."""
    key = (s.sparkContext.applicationId, d)
    if key not in _SHARED:
        _SHARED[key] = ingest_anew(s, d)
    root, counters = _SHARED[key]
    return Warehouse(s, root, readonly=True), counters


def ingest_anew(s: SparkSession, d: str) -> tuple[str, DataFrame]:
    """A new warehouse of the items in two commits, split by day, and the second one's counters."""
    root = f"{shared_folder(s)}/tagwatch-warehouse-{uuid.uuid4().hex}"
    early = F.col("obs_date") < F.lit("2024-01-16").cast("date")
    rows, counters = items(s, d), None
    for part in (rows.where(early), rows.where(~early)):
        with Warehouse(s, root) as house:
            counters = ingest.store_items(house, part, WINDOWS)
    path = s._jvm.org.apache.hadoop.fs.Path(root)
    path.getFileSystem(s._jsc.hadoopConfiguration()).deleteOnExit(path)  # goes with the driver
    return root, counters


@query
def store_items(s, d):
    return ingested(s, d)[1]


@query
def ingest_then_timeline(s, d):
    house, _ = ingested(s, d)
    obs = stars.observations(house).drop("is_festival", "festival_window")
    told = timeline.price_timeline(obs, house.read("dim_date").select("date_key", "is_festival", "festival_window"))
    links = house.read("dim_listing").select("listing_id", "url")
    return told.join(links, "listing_id").select("url", "title", "category", "obs_date", "is_festival", "selling_price", "mrp", "prev_price", "price_delta", "n_observations")


@query
def ingest_star_counts(s, d):
    house, _ = ingested(s, d)
    counts = house.counts()
    return s.createDataFrame(sorted(counts.items()), "name string, n long")


@query
def ingest_listings(s, d):
    house, _ = ingested(s, d)
    return stars.active_listings(house).select("site_key", "url", "raw_title", "first_seen_date", "last_seen_date")


@query
def ingest_claims_star(s, d):
    house, _ = ingested(s, d)
    return stars.claims(house).groupBy("site_key", "category", "obs_date").agg(F.count("*").alias("n"))


@query
def ingest_events_star(s, d):
    """Events found on the ingested observations, stored with their run, and read with listing and product."""
    root, _ = ingest_anew(s, d)
    found = inflation.events(stars.observations(Warehouse(s, root)), LOOSE, ("live",)).drop("evidence", "hold_days", "n_observations", "site_key", "title")
    found = found.withColumnsRenamed({"overstatement_pp": "discount_overstatement_pp", "rise_start": "rise_start_date", "sale_start": "sale_start_date"})
    with Warehouse(s, root) as writer:
        ingest.append_run(writer, run_row(s, "inflation", {"min_rise_pct": 3.0}, 0, 0, "2024-02-01"), inflation_event=found)
    stored = stars.events(Warehouse(s, root, readonly=True))
    return stored.select("url", "title", "category", "baseline_price", "peak_price", "sale_price", "rise_pct", F.col("discount_overstatement_pp").alias("overstatement_pp"), "sale_start_date", "confidence")


@query
def mrp_dispersion_latest_day(s, d):
    return mrp.dispersion(stars.latest_day(region_quotes(s, d).withColumn("source", F.lit("live"))))


@query
def panel_activate(s, d):
    """The panel of the products on most sites: their listings are active, others as they were."""
    root, _ = ingest_anew(s, d)
    with Warehouse(s, root) as writer:
        off = writer.read("dim_listing").withColumn("is_active", F.lit(0))
        writer.write("dim_listing", off)
        chosen = writer.read("dim_listing").where(F.col("site_key").isin("site1", "site2"))
        ingest.activate(writer, chosen)
    return Warehouse(s, root, readonly=True).read("dim_listing").groupBy("site_key").agg(F.count("*").alias("n"), F.sum("is_active").cast("long").alias("n_active"))


@query
def archived_extract(s, d):
    """Pages with a schema.org block, with selectors only, and with amounts only."""
    p = table(s, d, "part")
    url, price = F.concat(F.lit("/p/"), F.col("p_partkey").cast("string")), F.floor("p_retailprice").cast("string")
    plain = F.concat(F.lit("<html><title> "), "p_name", F.lit(" </title><p>now ₹"), price, F.lit(" was ₹99,999 now ₹"), price, F.lit("</p></html>"))
    chosen = F.concat(F.lit('<h1 class="name">'), "p_name", F.lit('</h1><b class="now">Rs. '), price, F.lit("</b>"))
    own = p.select(url.alias("url"), F.when(F.col("p_partkey") % 3 == 1, plain).otherwise(chosen).alias("html")).where(F.col("p_partkey") % 3 != 0)
    blocks = product_pages(s, d).where(F.substring("url", 4, 20).cast("long") % 3 == 0)
    return pages.archived(own.unionByName(blocks.select("url", "html")), {"title": ".name", "selling_price": ".now", "price": ".now"})


@query
def resolved_links(s, d):
    p = table(s, d, "part")
    links = F.array(*[F.lit(x) for x in ("/a/b?c", "b/../c", "//other.example/x", "https://z.example/", "?page=2", "../up", "#top")])
    rows = p.select("p_partkey", F.concat(F.lit("https://shop.example/d/"), F.col("p_partkey").cast("string"), F.lit("/page?x=1")).alias("base"), F.get(links, (F.col("p_partkey") % 7).cast("int")).alias("link"))
    return rows.select("p_partkey", pages.resolved(F.col("base"), F.col("link")).alias("url"))


@query
def category_health(s, d):
    p = table(s, d, "part").select(F.col("p_type").alias("category"), F.col("p_name").alias("url"))
    return pages.category_health(p.union(p.where("category = 'ECONOMY'").select(F.lit("COPY"), "url")))


@query
def pseudo_sku(s, d):
    return table(s, d, "part").select("p_partkey", F.upper(F.substring(F.md5(F.col("p_name").cast("binary")), 1, 7)).alias("sku"))


@query
def export_date_dim(s, d):
    house, _ = ingested(s, d)
    return stars.export_dates(house, "2024-05-20").select("date_key", "date", "is_festival", "days_to_festival")


@query
def view_daily_prices(s, d):
    house, _ = ingested(s, d)
    stars.create_views(house)
    return s.sql("SELECT site_key, count(*) AS n, min(price_min_30d) AS low, max(price_max_30d) AS high FROM vw_daily_prices GROUP BY site_key")


@query
def verdict_update(s, d):
    """Review results read back into events: trimmed, lower-cased, unknown ones left out."""
    c = table(s, d, "customer")
    events = c.select(F.col("c_custkey").alias("event_id"), F.lit(0).alias("manually_reviewed"), F.lit(None).cast("string").alias("reviewer_verdict"), F.lit(None).cast("string").alias("reviewer_note"))
    verdicts = c.select(F.col("c_custkey").alias("event_id"), F.element_at(F.array(F.lit(" Confirmed"), F.lit("REJECTED "), F.lit("unclear"), F.lit("maybe")), (F.col("c_custkey") % 4 + 1).cast("int")).alias("verdict"), F.col("c_mktsegment").alias("reviewer_note"))
    return merge.update_verdicts(events, verdicts)


@query
def overstatement_error(s, d):
    from tagwatch.sources import synthetic

    obs, truth = synthetic.generate(s)
    return validation.overstatement_error(inflation.events(obs, sources=None), truth).select("n", (F.col("mae_pp") <= 3).alias("near"))
