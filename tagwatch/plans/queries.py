"""The registered queries of the price-integrity engine, over the test tables' projections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagwatch.functions import titles
from tagwatch.functions.numbers import date_key, rounded
from tagwatch.operators import anomaly, features, inflation, marts, merge, mrp, pages, scarcity, timeline, validation
from tagwatch.operators.calendar import calendar
from tagwatch.sources import synthetic
from tagwatch.sources.projections import WINDOWS, claims, dates, quarter_days, region_quotes, table, user_days
from tagwatch.streaming import days

QUERIES = {}
#: A rise of 3 % is enough on the test series, which are short.
LOOSE = inflation.Thresholds(min_rise_pct=3.0, min_hold_days=1)


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def price_timeline(s: SparkSession, d: str) -> DataFrame:
    return timeline.price_timeline(user_days(s, d), dates(s))


@query
def inflation_candidates_sql(s, d):
    return inflation.candidates(user_days(s, d), dates(s), None)


@query
def inflation_candidates_top1(s, d):
    return inflation.candidates(user_days(s, d), dates(s), None).where("rn = 1")


def found_events(s, d, t=inflation.Thresholds()):
    return inflation.events(user_days(s, d), t, None)


@query
def inflation_events(s, d):
    return found_events(s, d).drop("evidence")


@query
def inflation_events_loose(s, d):
    return found_events(s, d, LOOSE).drop("evidence")


@query
def inflation_summary(s, d):
    n = user_days(s, d).agg(F.count_distinct("listing_id").alias("n_listings"))
    return inflation.summary(found_events(s, d), n)


@query
def inflation_by_site(s, d):
    return inflation.by_site(found_events(s, d))


@query
def mrp_dispersion_latest(s, d):
    return mrp.dispersion(region_quotes(s, d))


@query
def mrp_contradictions(s, d):
    return mrp.contradictions(region_quotes(s, d))


@query
def mrp_contradictions_by_site(s, d):
    return mrp.contradictions_by_site(mrp.contradictions(region_quotes(s, d)))


@query
def mrp_contradictions_summary(s, d):
    return mrp.contradictions_summary(mrp.contradictions(region_quotes(s, d)))


@query
def mrp_credibility(s, d):
    return mrp.credibility(user_days(s, d), None)


@query
def mrp_credibility_compare(s, d):
    return mrp.compare(mrp.credibility(user_days(s, d), None))


@query
def mrp_most_repeated(s, d):
    return mrp.most_repeated(user_days(s, d).withColumn("mrp", F.ceil(F.col("mrp") / 50) * 50.0))  # stock values, so that some repeat


@query
def scarcity_claims(s, d):
    return scarcity.claims(claims(s, d))


@query
def scarcity_summary(s, d):
    return scarcity.summary(scarcity.claims(claims(s, d)))


@query
def scarcity_by_site(s, d):
    return scarcity.summary_by_site(scarcity.claims(claims(s, d)))


@query
def mart_scarcity(s, d):
    return scarcity.mart(claims(s, d))


@query
def static_stock_claims(s, d):
    return scarcity.static_stock_claims(claims(s, d))


@query
def mart_daily_prices(s, d):
    return timeline.daily_prices(user_days(s, d))


@query
def mart_collection_health(s, d):
    return marts.collection_health(user_days(s, d))


@query
def mart_category_summary(s, d):
    return marts.category_summary(user_days(s, d), found_events(s, d))


@query
def mart_discount_integrity(s, d):
    return marts.discount_integrity(found_events(s, d))


@query
def calendar_dim(s, d):
    return calendar(s, "2024-01-01", "2024-03-31", WINDOWS)


@query
def status_by_source(s, d):
    return marts.status_by_source(user_days(s, d))


@query
def last_14_days(s, d):
    return marts.last_days(user_days(s, d))


@query
def coverage_pivot(s, d):
    return marts.coverage(user_days(s, d), [f"site{k}" for k in range(5)])


@query
def claims_describe(s, d):
    return marts.describe(table(s, d, "part"), "p_brand", "p_retailprice")


@query
def price_histogram(s, d):
    return marts.histogram(table(s, d, "part"), "p_retailprice", 900.0, 1100.0)


@query
def panel_seed(s, d):
    return marts.panel_seed(region_quotes(s, d), 4, 300)


@query
def panel_limit_per_site(s, d):
    return marts.per_group_limit(table(s, d, "supplier").select("s_suppkey", "s_nationkey"), "s_nationkey", ["s_suppkey"], 3)


@query
def discovery_status_counts(s, d):
    li = table(s, d, "lineitem")
    items = li.select(F.col("l_linestatus").alias("raw_title"), F.nullif(F.col("l_returnflag"), F.lit("R")).alias("url"), F.nullif(F.col("l_discount"), F.lit(0.0)).alias("selling_price"))
    return marts.discovery_status(items)


def arrivals(s, d) -> DataFrame:
    """Several arrivals of a listing and day, with nulls."""
    e = table(s, d, "events")
    odd = F.col("event_id") % 2
    return e.select(
        F.col("user_id").alias("listing_id"),
        date_key(F.col("ts").cast("date")).alias("date_key"),
        F.lit("live").alias("source"),
        F.when(F.col("event_id") % 3 != 0, F.col("value")).alias("selling_price"),
        F.when(odd == 0, rounded(F.col("value") * 2)).alias("mrp"),
        F.col("event_type").alias("rating"),
        F.col("event_id").alias("seq"),
    )


@query
def same_day_merge(s, d):
    return merge.merge_batch(arrivals(s, d), ["seq"])


@query
def observation_merge(s, d):
    rows = arrivals(s, d)
    old, new = (merge.merge_batch(rows.where(F.col("seq") % 2 == k), ["seq"]).drop("seq") for k in (0, 1))
    return merge.merge_observations(old, new)


@query
def listing_upsert(s, d):
    o = table(s, d, "orders").select(
        F.col("o_orderpriority").alias("site_key"), F.concat(F.lit("/c/"), F.col("o_custkey").cast("string")).alias("url"), F.col("o_orderstatus").alias("raw_title"),
        F.col("o_orderdate").cast("date").alias("seen"), F.col("o_orderkey").alias("seq"),
    )
    cut = F.col("seen") < F.lit("1997-01-01").cast("date")
    empty = s.createDataFrame([], "site_key string, url string, raw_title string, first_seen_date date, last_seen_date date, is_active int")
    return merge.upsert_listings(merge.upsert_listings(empty, o.where(cut), ["seen", "seq"]), o.where(~cut), ["seen", "seq"])


@query
def dim_product_first_wins(s, d):
    p = table(s, d, "part").select(F.col("p_name").alias("match_key"), F.col("p_type").alias("category"), F.col("p_partkey").alias("seq"))
    return merge.first_wins(merge.first_wins(None, p.where("seq < 500"), "match_key", ["seq"]), p.where("seq >= 500"), "match_key", ["seq"])


@query
def seller_upsert(s, d):
    c = table(s, d, "customer").select(F.col("c_mktsegment").alias("site_key"), F.lower("c_mktsegment").alias("site_name"), F.when(F.col("c_nationkey") > 2, F.concat(F.lit("seller "), F.col("c_nationkey").cast("string"))).alias("seller_name"), "c_nationkey")
    store = s.createDataFrame([], "site_key string, site_name string, seller_name string, is_first_party int")
    cut = F.col("c_nationkey") < 10
    return merge.upsert_sellers(merge.upsert_sellers(store, c.where(cut)), c.where(~cut))


@query
def features_matrix(s, d):
    return features.features(user_days(s, d), digits=4)


@query
def detector_confusion(s, d):
    flagged = inflation.candidates(user_days(s, d), dates(s), None).where("rn = 1")
    return validation.confusion(flagged, found_events(s, d), "candidates")


def _truth(s, d):
    return user_days(s, d).where(F.col("computed_discount_pct") >= 65).select("listing_id").distinct()


@query
def set_ops_benchmark(s, d):
    sets = {"candidates": inflation.candidates(user_days(s, d), dates(s), None), "events": found_events(s, d)}
    return validation.benchmark(sets, _truth(s, d))


@query
def validation_precision_wilson(s, d):
    verdict = F.when(F.col("toxic") == 1, "unclear").when(F.col("quality") == 1, "confirmed").otherwise("rejected")
    return validation.precision_report(table(s, d, "labels").select(verdict.alias("reviewer_verdict")))


@query
def validation_sample(s, d):
    return validation.draw_sample(found_events(s, d).drop("evidence"), 10)


@query
def changepoint_pelt(s, d):
    return anomaly.changepoints(user_days(s, d), sources=None)


def scored(s, d) -> DataFrame:
    return anomaly.isolation_scores(features.features(user_days(s, d)))


@query
def isolation_forest(s, d):
    return anomaly.isolation_forest(scored(s, d), 0.25)


@query
def contamination_sweep(s, d):
    return anomaly.contamination_sweep(scored(s, d), _truth(s, d))


def planted(s, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    return synthetic.generate(s, seed=seed)


@query
def detector_benchmark(s, d):
    obs, truth = planted(s)
    sets = {
        "rules": inflation.events(obs, sources=None),
        "forest": anomaly.isolation_forest(anomaly.isolation_scores(features.features(obs.withColumn("source", F.lit("live")))), 0.25),
        "changepoint": anomaly.changepoints(obs, sources=None),
    }
    return validation.benchmark(sets, truth)


@query
def synthetic_evaluate(s, d):
    obs, truth = planted(s)
    return validation.confusion(inflation.events(obs, sources=None), truth, "rules")


@query
def parse_price(s, d):
    li = table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    label = F.concat(F.lit("MRP: Rs. "), F.format_number("l_extendedprice", 2), F.lit(" only"))
    return li.select("l_orderkey", "l_linenumber", titles.parse_price(label).alias("price"))


@query
def parse_int(s, d):
    return table(s, d, "orders").select("o_orderkey", titles.parse_int(F.concat(F.lit("about "), F.format_number("o_custkey", 0), F.lit(" ratings (4 stars)"))).alias("n"))


def _titled(s, d) -> DataFrame:
    size = F.col("p_size") % 8
    ram = F.element_at(F.array(*[F.lit(x) for x in (2, 3, 4, 6, 8, 12, 16, 24)]), (size + 1).cast("int"))
    brand = F.element_at(F.array(F.lit("Samsung"), F.lit("iPhone"), F.lit("Acme"), F.lit("OnePlus")), (F.col("p_partkey") % 4 + 1).cast("int"))
    title = F.concat(brand, F.lit(" "), F.col("p_name"), F.lit(" Smartphone ("), ram.cast("string"), F.lit("GB RAM, 128 GB Storage) X"), (F.col("p_partkey") % 100).cast("string"))
    return table(s, d, "part").select("p_partkey", title.alias("title"))


@query
def parse_title(s, d):
    return _titled(s, d).select("p_partkey", titles.parse_title(F.col("title")).alias("t")).select("p_partkey", "t.*")


@query
def extract_variant(s, d):
    return _titled(s, d).select("p_partkey", titles.variant_of(F.col("title")).alias("variant"))


@query
def extract_brand(s, d):
    return _titled(s, d).select("p_partkey", titles.brand_of(F.lower("title")).alias("brand"))


def product_pages(s, d) -> DataFrame:
    """A page for each part: a schema.org block, prices in the text and urgency."""
    p = table(s, d, "part")
    price, mrp_ = F.format_number(F.floor("p_retailprice"), 0), F.format_number(F.floor("p_retailprice") + F.col("p_size") - 25, 0)
    block = F.concat(
        F.lit('<html><script type="application/ld+json">[{"@type":"WebSite"},{"@graph":[{"@type":"Product","name":"Item &amp;amp; '), F.col("p_name"), F.lit('","brand":{"name":"'), F.col("p_brand"),
        F.lit('"},"offers":[{"price":"'), price, F.lit('","highPrice":"'), mrp_, F.lit('","availability":"https://schema.org/'), F.when(F.col("p_size") % 2 == 0, "InStock").otherwise("Out_Of_Stock"),
        F.lit('",}]}]}]</script>'),
    )
    body = F.concat(F.lit("<body><p>Hurry, only "), F.col("p_size").cast("string"), F.lit(" left!</p> now ₹"), price, F.lit(" was ₹"), mrp_, F.lit(" now ₹"), price, F.lit(" save ₹12</body></html>"))
    return p.select(F.concat(F.lit("/p/"), F.col("p_partkey").cast("string")).alias("url"), F.concat(block, body).alias("html"))


@query
def jsonld_products(s, d):
    return pages.jsonld_products(product_pages(s, d))


@query
def jsonld_listing(s, d):
    p = table(s, d, "part").groupBy("p_brand").agg(F.array_sort(F.collect_set("p_name")).alias("names"))
    items = F.array_join(F.transform("names", lambda n: F.concat(F.lit('{"name":"'), n, F.lit('","url":"//shop.example/'), F.replace(n, F.lit(" "), F.lit("-")), F.lit('"}'))), ",")
    html = F.concat(F.lit('<script type="application/ld+json">{"@type":"ItemList","itemListElement":['), items, F.lit(","), items, F.lit("]}</script>"))
    return pages.jsonld_listing(p.select(F.col("p_brand").alias("url"), html.alias("html")))


@query
def modal_price(s, d):
    return pages.modal_price(product_pages(s, d))


@query
def urgency_extract(s, d):
    return pages.urgency(product_pages(s, d))


@query
def state_items(s, d):
    html = F.concat(F.lit('<script>window.state = {"note":"a } in text","list":{"items":[{"t":"'), F.col("p_name"), F.lit('","p":"'), F.floor("p_retailprice").cast("string"), F.lit('","m":"10"}]}};</script>'))
    rows = table(s, d, "part").select(F.concat(F.lit("/p/"), F.col("p_partkey").cast("string")).alias("url"), html.alias("html"))
    return pages.state_items(rows, "window.state", "$.list.items", {"title": "$.t", "price": "$.p", "mrp": "$.m"})


@query
def css_items(s, d):
    html = F.concat(F.lit('<ul><li class="item"><a class="name" href="/x/'), F.col("p_partkey").cast("string"), F.lit('">'), F.col("p_name"), F.lit('</a><b class="now">Rs. '), F.floor("p_retailprice").cast("string"), F.lit("</b></li><li class='item'></li></ul>"))
    rows = table(s, d, "part").select(F.concat(F.lit("/p/"), F.col("p_partkey").cast("string")).alias("url"), html.alias("html"))
    return pages.css_items(rows, "item", {"title": ".title, .name", "href": "a.name@href", "price": ".now"})


@query
def category_fingerprint_collisions(s, d):
    p = table(s, d, "part").select(F.col("p_type").alias("category"), F.col("p_name").alias("url"))
    return pages.fingerprint_collisions(p.union(p.where("category = 'ECONOMY'").select(F.lit("COPY"), "url")))


@query
def rolling_7d_avg(s, d):
    return timeline.rolling_daily_avg(user_days(s, d))


@query
def price_30d_ago(s, d):
    return timeline.price_days_ago(quarter_days(s, d), 30)


@query
def trailing_30d_min_premium(s, d):
    return timeline.trailing_min_premium(user_days(s, d))


@query
def festival_uplift(s, d):
    return marts.festival_uplift(user_days(s, d), dates(s))


@query
def what_if_threshold(s, d):
    return marts.what_if(found_events(s, d, LOOSE))


@query
def headline_measures(s, d):
    return marts.headline_measures(user_days(s, d), found_events(s, d))


@query
def row_level_security(s, d):
    grants = s.createDataFrame([("ann", "category1"), ("ann", "category2"), ("bob", "category3")], "user string, value string")
    return marts.visible_to(user_days(s, d), "ann", grants, "category").groupBy("category").agg(F.count("*").alias("n"))


@query
def snapshot_lenient_casts(s, d):
    from tagwatch.sources.tables import lenient_double, lenient_int

    text = F.when(F.col("o_orderkey") % 5 == 0, "None").when(F.col("o_orderkey") % 7 == 0, "").when(F.col("o_orderkey") % 11 == 0, "n/a").otherwise(F.concat(F.col("o_custkey").cast("string"), F.lit(".5")))
    return table(s, d, "orders").select("o_orderkey", lenient_double(text).alias("as_double"), lenient_int(text).alias("as_int"))


def _as_stream(s: SparkSession, d: str) -> DataFrame:
    at = f"{d}/events.parquet"
    return s.readStream.schema(s.read.parquet(at).schema).option("pathGlobFilter", "events*").parquet(d)


@query
def stream_daily_windows(s, d):
    rows = days.to_table(days.daily_windows(_as_stream(s, d).withColumn("ts", F.col("ts").cast("timestamp"))), days.checkpoint_folder(s), "complete")
    return rows.select(F.col("window.start").cast("date").alias("day"), "event_type", "n", "hundredths")


@query
def stream_static_run(s, d):
    rows = _as_stream(s, d).select(F.col("user_id").alias("listing_id"), F.col("ts").cast("timestamp").alias("at"), F.floor(F.col("value") / 100).cast("double").alias("numeric_value"))
    out = days.to_table(days.static_runs(rows), days.checkpoint_folder(s), "update")
    return out.groupBy("listing_id").agg(F.max("longest_static_run").alias("longest_static_run"))


@query
def stream_sliding_average(s, d):
    rows = days.to_table(days.sliding_average(_as_stream(s, d).withColumn("ts", F.col("ts").cast("timestamp"))), days.checkpoint_folder(s), "complete")
    return rows.select(F.col("window.start").cast("date").alias("first_day"), "event_type", "n", rounded(F.col("hundredths") / (F.col("n") * 100.0), 4).alias("average"))


from tagwatch.plans import warehouse_queries  # noqa: E402, F401  (registers its queries here)
