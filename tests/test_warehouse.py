"""The warehouse, ingest, star joins, exports, page readers and the command line."""

import datetime as dt
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tagwatch import cli
from tagwatch.operators import anomaly, findings, inflation, ingest, pages, stars
from tagwatch.sources import synthetic, tables
from tagwatch.sources.warehouse import Conflict, Warehouse
from tagwatch.streaming import days

DAY = dt.date(2026, 6, 1)
SELLER = (1, "s", "S", None, 1)


def sellers(spark, n):
    return spark.createDataFrame([(k, "s", "S", None, 1) for k in range(n)], tables.schema_of("dim_seller"))


def test_commit_and_rollback(spark, tmp_path):
    root = str(tmp_path)
    assert Warehouse(spark, root).read("dim_seller").count() == 0
    with Warehouse(spark, root) as house:
        house.write("dim_seller", sellers(spark, 1))
        assert house.read("dim_seller").count() == 1 and Warehouse(spark, root).read("dim_seller").count() == 0  # not yet seen by others
    before = Warehouse(spark, root, readonly=True)
    with pytest.raises(ZeroDivisionError), Warehouse(spark, root) as house:
        house.write("dim_seller", sellers(spark, 5))
        raise ZeroDivisionError
    assert Warehouse(spark, root).read("dim_seller").count() == 1
    with Warehouse(spark, root) as house:  # reads itself while it is written
        house.write("dim_seller", house.read("dim_seller").union(sellers(spark, 2)))
    assert before.read("dim_seller").count() == 1 and Warehouse(spark, root).read("dim_seller").count() == 3
    with pytest.raises(PermissionError):
        before.write("dim_seller", sellers(spark, 1))
    one, other = Warehouse(spark, root), Warehouse(spark, root)
    for house in (one, other):
        house.write("dim_seller", sellers(spark, 4))
    one.commit()
    with pytest.raises(Conflict):
        other.commit()
    assert Warehouse(spark, root).counts()["dim_seller"] == 4 and Warehouse(spark, root).counts()["dim_date"] == -1


def test_query_file(spark, tmp_path):
    with Warehouse(spark, str(tmp_path / "w")) as house:
        house.write("dim_seller", sellers(spark, 3))
    (tmp_path / "q.sql").write_text("SELECT count(*) AS n FROM dim_seller WHERE seller_id >= :least;\n")
    assert Warehouse(spark, str(tmp_path / "w")).run_file(str(tmp_path / "q.sql"), {"least": 1}).first().n == 2


def item(seq, day=0, **given):
    told = {"seq": seq, "site_key": "shop", "url": "https://shop.example/p/1", "raw_title": "Samsung Galaxy S21 (8GB RAM, 128GB)", "selling_price": 100.0, "mrp": 200.0, "source": "live", "obs_date": DAY + dt.timedelta(days=day)} | given
    return tuple(told.get(c.split()[0]) for c in f"{ingest.ITEM}, obs_date date".replace("array<struct<kind:string,text:string,value:double>>", "claims").split(", "))


def stored(spark, root, *rows):
    with Warehouse(spark, root) as house:
        return ingest.store_items(house, spark.createDataFrame(list(rows), f"{ingest.ITEM}, obs_date date")).first().asDict()


def test_ingest(spark, tmp_path):
    root = str(tmp_path)
    claim = [("stock_claim", "only 3 left", 3.0)]
    told = stored(
        spark, root, item(1, dark_patterns=claim, rating=4.0), item(2, selling_price=90.0, mrp=None, rating=1.0), item(3, raw_title=""), item(4, url=None),
        item(5, url="https://shop.example/p/2", selling_price=None), item(6, site_key="mall", url="https://mall.example/x", seller_name="Bob", raw_title="samsung galaxy s21 8gb ram 128gb"),
    )
    assert told == {"stored": 3, "skipped": 2, "products_created": 1, "dark_patterns": 1, "discovered": 1}
    house = Warehouse(spark, root, readonly=True)
    assert house.counts() | {"dim_date": 1, "dim_product": 1, "dim_listing": 3, "dim_seller": 2, "fact_price_observation": 2, "fact_dark_pattern": 1} == house.counts()
    obs = {r.url: r for r in stars.observations(house).collect()}
    first = obs["https://shop.example/p/1"]
    # the second arrival's price, the first one's list price and rating
    assert (first.selling_price, first.mrp, first.rating, first.brand, first.obs_date) == (90.0, 200.0, 4.0, "samsung", DAY)
    assert stored(spark, root, item(1, dark_patterns=claim, rating=4.0), item(2, selling_price=90.0, mrp=None))["products_created"] == 0  # the same again changes nothing
    again = Warehouse(spark, root, readonly=True)
    assert again.counts() == house.counts() and stars.claims(again).first().title == "Samsung Galaxy S21 8Gb-128Gb"
    stored(spark, root, item(1, day=2, selling_price=80.0))
    house = Warehouse(spark, root, readonly=True)
    listing = house.read("dim_listing").where("url = 'https://shop.example/p/1'").first()
    assert (listing.first_seen_date, listing.last_seen_date, listing.is_active) == (DAY, DAY + dt.timedelta(days=2), 1)
    assert [r.selling_price for r in stars.latest_day(stars.observations(house)).collect()] == [80.0]
    with Warehouse(spark, root) as writer:
        writer.write("dim_listing", writer.read("dim_listing").withColumn("is_active", F.lit(0)))
        ingest.activate(writer, writer.read("dim_listing").where("site_key = 'mall'"))
    assert [r.site_key for r in stars.active_listings(Warehouse(spark, root)).collect()] == ["mall"]
    assert stored(spark, root)["stored"] == 0  # an empty batch


def test_long_numbers_tell_products_without_a_brand_apart(spark, tmp_path):
    named = {1: "item 10000", 2: "item 20000", 3: "Item 20000", 4: "Samsung Galaxy S21 10000", 5: "Samsung Galaxy S21 20000"}
    told = stored(spark, str(tmp_path), *(item(k, url=f"https://shop.example/p/{k}", raw_title=x, category=f"c{k}") for k, x in named.items()))
    assert told["products_created"] == 3
    obs = {r.url[-1]: (r.title, r.category) for r in stars.observations(Warehouse(spark, str(tmp_path))).collect()}
    assert obs == {"1": ("Item 10000", "c1"), "2": ("Item 20000", "c2"), "3": ("Item 20000", "c2"), "4": ("Samsung Galaxy S21", "c4"), "5": ("Samsung Galaxy S21", "c4")}


def test_a_batch_is_run_once_and_a_title_parsed_once(spark, tmp_path):
    made, schema = spark.sparkContext.accumulator(0), f"{ingest.ITEM}, obs_date date"

    def counted(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    rows = [item(k, day=k, url=f"https://shop.example/p/{k % 2}", raw_title=f"item {k % 2}") for k in range(6)]
    items = spark.createDataFrame([*rows, item(6, url="")], schema).mapInArrow(counted, schema)
    with Warehouse(spark, str(tmp_path)) as house:
        told = ingest.store_items(house, items).first()
    assert (told.stored, told.skipped, told.products_created, made.value) == (6, 1, 2, 7)
    plan = ingest.prepared(spark.createDataFrame(rows, schema).repartition(2))._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate(keys=[raw_title" in plan and "Broadcast" not in plan


def test_dates_keep_all_but_festivals(spark, tmp_path):
    with Warehouse(spark, str(tmp_path)) as house:
        house.write("dim_date", ingest.upsert_dates(house, "2026-06-01", "2026-06-03", []).withColumn("month_name", F.lit("mine")))
        house.write("dim_date", ingest.upsert_dates(house, "2026-06-02", "2026-06-05", [("Sale", "2026-06-03", "2026-06-04")]))
        rows = {r.day: r for r in house.read("dim_date").collect()}
    assert len(rows) == 5 and rows[3].festival_window == "Sale" and rows[3].month_name == "mine" and rows[1].days_to_festival is None and rows[5].month_name == "June"


def test_planted_events_are_found(spark):
    obs, truth = synthetic.generate(spark)
    found = {r.listing_id: r for r in inflation.events(obs, sources=None).collect()}
    planted = {r.listing_id: r for r in truth.collect()}
    assert planted and found.keys() == planted.keys()  # recall 1.0, no false positive
    errors = [abs(found[k].overstatement_pp - planted[k].true_overstatement_pp) for k in planted]
    assert sum(errors) / len(errors) <= 2.5


def test_detectors_on_planted_events(spark):
    from tagwatch.plans.queries import QUERIES

    rows = {r.detector: r for r in QUERIES["detector_benchmark"](spark, "").collect()}
    assert rows["rules"].f1 == 1.0 and rows["changepoint"].precision == 1.0 and rows["changepoint"].recall >= 0.8 and rows["forest"].recall >= 0.5
    assert rows["rules_AND_forest"].precision == 1.0


def test_rise_and_fall():
    assert anomaly.rise_and_fall([100, 130, 95]) == pytest.approx(min(30.0, (130 - 95) / 130 * 100))
    assert anomaly.rise_and_fall([100, 105, 90]) == 0 and anomaly.rise_and_fall([100, 130]) == 0 and anomaly.rise_and_fall([0, 10, 0]) == 0 and anomaly.rise_and_fall([130, 100, 90]) == 0
    rng = np.random.default_rng(1)
    for _ in range(200):
        x = rng.uniform(50, 150, rng.integers(3, 9)).tolist()
        want = max((min((p - a) / a, (p - b) / p) * 100 for k, p in enumerate(x) for a in x[:k] for b in x[k + 1 :] if (p - a) / a * 100 >= 10 and p > b), default=0.0)
        assert anomaly.rise_and_fall(x) == pytest.approx(want)


def test_archived_pages_and_links(spark):
    rows = [
        ("a", '<script type="application/ld+json">{"@type":"Product","name":"A","offers":{"price":"100"}}</script><script type="application/ld+json">{"@type":"Product","name":"B","offers":{"price":"50"}}</script>'),
        ("b", '<b class="t">Title</b><i class="p">Rs. 1,200</i>'),
        ("c", "<title>Third</title> ₹500 ₹700 ₹500"),
        ("d", "<p>no price"),
    ]
    df = spark.createDataFrame(rows, "url string, html string")
    got = {r.url: (r.raw_title, r.selling_price) for r in pages.archived(df, {"title": ".t", "price": ".p"}).collect()}
    assert got == {"a": ("A", 100.0), "b": ("Title", 1200.0), "c": ("Third", 500.0)}
    assert pages.parse_pages("json_ld", df).count() == 1
    with pytest.raises(ValueError, match="json_ld, json_state, static, wayback"):
        pages.parse_pages("nothing", df)
    assert [r.ok for r in pages.detail_probe(df).orderBy("url").collect()] == [True, False, False, False]
    from urllib.parse import urljoin

    cases = [(b, x) for b in ("https://a.example", "https://a.example/x/y?q=1#f", "http://a.example/x/") for x in ("b", "/c", "//d.example/e", "http://f.example/", "?g", "#h", "../i", "./j", "", "k/../l?m=../n", "../../..")]
    got = [r.u for r in spark.createDataFrame(cases, "b string, x string").select(pages.resolved(F.col("b"), F.col("x")).alias("u")).collect()]
    assert got == [urljoin(b, x) for b, x in cases]


def test_selector_health(spark):
    html = '<div class="item"><a class="t" href="/1">T</a><b class="p">Rs. 5</b></div><div class="item"><a class="t" href="/2">U</a></div>'
    df = spark.createDataFrame([("c1", "u1", html), ("c2", "u2", "<p>")], "category string, url string, html string")
    got = {r.category: (r.items_found, r.n_selling_price, r.ok) for r in pages.selector_health(df, "item", {"title": ".t", "href": "a.t@href", "price": ".p"}).collect()}
    assert got == {"c1": (2, 1, True), "c2": (0, 0, False)}


def test_backfill_and_page_archive(spark, tmp_path):
    index = spark.createDataFrame([(json.dumps([["k", "timestamp", "o", "m", "status"]] + [["a", f"2026060{d}010101", "u", "h", "200"] for d in (1, 2, 3)]),)], "json string")
    captured = spark.createDataFrame([("u", f"2026060{d}010101", f"<title>T</title> ₹{d}00 ₹{d}00") for d in (1, 2, 3)], "url string, timestamp string, html string")
    got = pages.backfill(captured, tables.archive_days(index), {}, 2).orderBy("obs_date").collect()
    assert [(r.url, str(r.obs_date), r.selling_price, r.source) for r in got] == [("u", "2026-06-01", 100.0, "wayback"), ("u", "2026-06-02", 200.0, "wayback")]
    rows = spark.createDataFrame([(DAY, "shop", "cat /a?b=" + "x" * 300, "<p>é\nü")], "obs_date date, site_key string, label string, html string")
    pages.page_archive(rows, str(tmp_path))
    back = spark.read.text(str(tmp_path)).first()
    assert json.loads(back.value) == {"html": "<p>é\nü"} and len(back.label) == 120


def test_day_merge_is_idempotent(spark, tmp_path):
    schema = "seq long, listing_id long, date_key int, source string, selling_price double, mrp double, discount_pct double, computed_discount_pct double, in_stock int"
    rows = [[(1, 1, 20260601, "live", 10.0, None, None, None, 1), (2, 1, 20260601, "live", 9.0, 20.0, None, None, 1)], [(3, 1, 20260601, "live", None, 30.0, None, None, None), (4, 2, 20260602, "wayback", 5.0, None, None, None, 1)]]
    kept = {}

    def read():
        return kept.get("rows") or spark.createDataFrame([], schema)

    def write(df):
        kept["rows"] = spark.createDataFrame(df.collect(), schema)

    for k, part in enumerate([rows[0], rows[1], rows[1]]):  # the last batch comes twice
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        days.day_merge(stream, read, write, f"{tmp_path}/state", ["seq"]).awaitTermination()
    got = sorted((r.listing_id, r.date_key, r.selling_price, r.mrp) for r in kept["rows"].collect())
    assert got == [(1, 20260601, 9.0, 30.0), (2, 20260602, 5.0, None)]


def test_streamed_runs_and_reversals(spark, tmp_path):
    values = {1: [3, 3, 3, 2, 2, 5, 5, 5, 5, 4], 2: [1, 2, 3, 2], 3: [7]}
    schema = "listing_id long, at timestamp, numeric_value double"
    rows = [(k, dt.datetime(2026, 6, 1) + dt.timedelta(hours=h), float(v)) for k, own in values.items() for h, v in enumerate(own)]
    folder = f"{tmp_path}/in"
    for part in (rows[:5], rows[5:12], rows[12:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
    out = days.to_table(days.static_runs(stream), f"{tmp_path}/out", "update")
    got = {r.listing_id: (r.run, r.turns) for r in out.groupBy("listing_id").agg(F.max("longest_static_run").alias("run"), F.max("n_reversals").alias("turns")).collect()}
    assert got == {1: (4, 2), 2: (1, 1), 3: (1, 0)}


def test_command_line(spark, tmp_path, capsys):
    root = str(tmp_path)
    run = lambda *args: cli.main(["--root", root, *args])
    assert run("init") == 0 and run("synth", "generate") == 0 and run("synth", "evaluate") == 0
    out = capsys.readouterr().out
    assert '"recall":1.0' in out and '"precision":1.0' in out
    assert run("analyse", "inflation", "--include-synthetic", "--write-findings", f"{root}/findings.md") == 0
    assert "rose before a sale" in (tmp_path / "findings.md").read_text()
    assert run("analyse", "mrp", "--include-synthetic") == 0 and run("analyse", "patterns") == 0 and run("analyse", "credibility") == 0
    capsys.readouterr()
    assert run("ml", "changepoint") == 0 and capsys.readouterr().out == ""  # synthetic rows stay out
    assert run("ml", "changepoint", "--include-synthetic") == 0 and "n_segments" in capsys.readouterr().out
    assert run("validate", "sample", "--n", "5") == 0
    review = spark.read.option("header", True).csv(f"{root}/review")
    assert review.count() == 5
    review.select("event_id", F.lit(" Confirmed ").alias("verdict"), F.lit("seen").alias("reviewer_note")).write.option("header", True).csv(f"{root}/done")
    assert run("validate", "load", "--file", f"{root}/done") == 0 and run("validate", "report") == 0
    assert Warehouse(spark, root).read("inflation_event").where("reviewer_verdict = 'confirmed'").count() == 5
    assert run("export", "--include-synthetic") == 0 and spark.read.parquet(f"{root}/export/fact_price_observation").count() > 0
    assert run("status") == 0 and run("doctor") in (0, 1) and run("snapshot", "--date", "2026-09-30") == 0
    assert cli.main(["--root", root, "collect", "--items", f"{root}/nothing"]) == 1


def test_snapshot_and_rebuild(spark, tmp_path):
    root = str(tmp_path / "w")
    stored(spark, root, item(1, rating_count=5), item(2, url="https://shop.example/p/2", selling_price=50.5, mrp=None))
    assert cli.main(["--root", root, "snapshot", "--date", str(DAY)]) == 0
    other = str(tmp_path / "again")
    assert cli.main(["--root", other, "rebuild", "--snapshots", f"{root}/snapshots"]) == 0
    keys = ["url", "obs_date", "selling_price", "mrp", "source", "title"]
    told = [sorted(map(tuple, stars.observations(Warehouse(spark, x)).select(*keys).collect())) for x in (root, other)]
    assert told[0] == told[1] and len(told[0]) == 2


def test_findings_of_an_empty_warehouse(spark, tmp_path):
    assert "_No list prices yet._" in findings.report(Warehouse(spark, str(tmp_path)))
