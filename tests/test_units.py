"""Operators on small hand-built inputs with known answers."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tagwatch.functions import titles
from tagwatch.functions.numbers import computed_discount, ends_in_99
from tagwatch.operators import anomaly, features, inflation, merge, mrp, pages, scarcity, validation
from tagwatch.sources import tables

DAY = dt.date(2026, 6, 1)


def series(spark, *price_lists, step=1):
    rows = [
        (k, 1, 1, "s", f"t{k}", "c", DAY + dt.timedelta(days=i * step), int((DAY + dt.timedelta(days=i * step)).strftime("%Y%m%d")), float(p), "live")
        for k, prices in enumerate(price_lists)
        for i, p in enumerate(prices)
    ]
    schema = "listing_id long, product_id long, seller_id long, site_key string, title string, category string, obs_date date, date_key int, selling_price double, source string"
    return spark.createDataFrame(rows, schema)


RAISED = [10_000] * 10 + [13_000] * 7 + [9_500]


def test_event_of_a_raised_price(spark):
    e = inflation.events(series(spark, RAISED)).first()
    assert (e.baseline_price, e.peak_price, e.sale_price, e.rise_pct, e.hold_days) == (10_000, 13_000, 9_500, 30.0, 7)
    assert (e.claimed_discount_pct, e.real_discount_pct, e.overstatement_pp, e.confidence) == (26.92, 5.0, 21.92, "high")
    assert e.rise_start == DAY + dt.timedelta(days=10) and e.days_between == 7 and len(e.evidence) == 18


def test_event_with_missing_days(spark):
    assert inflation.events(series(spark, [10_000] * 6 + [13_000] * 4 + [9_500], step=2)).count() == 1


@pytest.mark.parametrize(
    "prices",
    [
        [10_000] * 15 + [8_000],  # an honest cut
        [10_000] * 12 + [13_000] + [9_500] * 3,  # one day only
        [10_000] * 10 + [10_500] * 7 + [9_000],  # a rise too small
        [13_000] * 15 + [9_500],  # high from the start
        [10_000, 13_000, 9_500],
        [10_000 - 40 * k for k in range(30)],
    ],
)
def test_no_event(spark, prices):
    assert inflation.events(series(spark, prices)).count() == 0


def events_by_hand(prices, step=1):
    best = None
    for i in range(1, len(prices)):
        if (prices[i - 1] - prices[i]) / prices[i - 1] * 100 < 10 or len(prices) < 10:
            continue
        window = [(j * step, prices[j]) for j in range(i) if (i - j) * step <= 21]
        if len(window) < 4:
            continue
        top = max(p for _, p in window)
        high = [d for d, p in window if p >= top * 0.98]
        before = [p for d, p in window if d < high[0]]
        if len(before) < 2:
            continue
        base = float(np.median(before))
        if (top - base) / base * 100 < 10 or high[-1] - high[0] + 1 < 3:
            continue
        over = (top - prices[i]) / top * 100 - (base - prices[i]) / base * 100
        if best is None or round(over, 2) > best[0]:
            best = (round(over, 2), i)
    return best


def test_events_equal_plain_python(spark):
    rng = np.random.default_rng(3)
    lists = [np.round(1000 * np.exp(np.cumsum(rng.normal(0, 0.09, 60))), 2).tolist() for _ in range(40)]
    got = {e.listing_id: (e.overstatement_pp, (e.sale_start - DAY).days) for e in inflation.events(series(spark, *lists)).collect()}
    want = {k: v for k, x in enumerate(lists) if (v := events_by_hand(x))}
    assert got.keys() == want.keys() and len(want) > 5
    assert all(abs(got[k][0] - want[k][0]) <= 0.011 and got[k][1] == want[k][1] for k in want)


def test_figures_of_a_drop_are_worked_out_once(spark):
    # once in the filter, once for what it lets through
    plan = inflation.drops(series(spark, RAISED))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("array_sort(") == 2 and plan.count("collect_list(") == 1


@pytest.mark.parametrize(
    ("raw", "value"),
    [("₹1,29,999", 129999), ("Rs. 45,990", 45990), ("Rs 500", 500), ("₹1,299.00", 1299), ("MRP ₹59,999", 59999), ("M.R.P.: ₹79,900", 79900), ("from ₹999.50", 999.5), ("1.299.00", 1299), ("", None), ("N/A", None),
     ("Out of stock", None), (None, None), ("₹", None), ("0.5", None), ("99999999", None)],
)
def test_prices(spark, raw, value):
    assert spark.createDataFrame([(raw,)], "x string").select(titles.parse_price(F.col("x"))).first()[0] == value


@pytest.mark.parametrize(("raw", "value"), [("1,234 ratings", 1234), ("85% off", 85), ("(12)", 12), ("none", None), (None, None)])
def test_ints(spark, raw, value):
    assert spark.createDataFrame([(raw,)], "x string").select(titles.parse_int(F.col("x"))).first()[0] == value


@pytest.mark.parametrize(
    ("title", "variant", "brand"),
    [
        ("Acme Phone 8 GB RAM 128 GB Storage", "8gb-128gb", None),
        ("Samsung Galaxy (8GB, 256GB)", "8gb-256gb", "samsung"),
        ("Dell laptop 16GB RAM 1TB SSD", "16gb-1tb", "dell"),
        ("iPhone 15 128GB", "128gb", "apple"),
        ("Sony ULT WEAR Noise Cancelling", None, "sony"),
        ("OnePlus 12", None, "oneplus"),
    ],
)
def test_titles(spark, title, variant, brand):
    t = spark.createDataFrame([(title,)], "x string").select(titles.parse_title(F.col("x")).alias("t")).first().t
    assert (t.variant, t.brand) == (variant, brand)
    assert t.is_confident == (brand is not None)


def test_one_product_has_one_key(spark):
    same = ["Samsung Galaxy S24 5G (Onyx Black, 8GB RAM, 128GB Storage)", "SAMSUNG Galaxy S24 Smartphone (Marble Grey) 8GB RAM 128GB", "samsung galaxy s24 8GB/128GB"]
    keys = {r.k for r in spark.createDataFrame([(x,) for x in same], "x string").select(titles.parse_title(F.col("x"))["match_key"].alias("k")).collect()}
    assert keys == {"samsung|galaxy s24|8gb-128gb"}
    got = spark.createDataFrame([("Sony WH-1000XM5 Café",)], "x string").select(titles.parse_title(F.col("x")).alias("t")).first().t
    assert got.canonical_title == "Sony Wh-1000Xm5 Cafe"


def test_title_parts_are_worked_out_once():
    # what is named twice in an expression is run twice, in lambdas for each word
    assert repr(titles.parse_title(F.col("x"))).count("regexp") < 30 and repr(titles.brand_of(F.col("x"))).count("regexp") == 1


@pytest.mark.parametrize(
    ("title", "key", "brand"),
    [("Bose by Sony", "bose|by sony", "bose"), ("the iPhone by Samsung", "apple|iphone by samsung", "apple"), ("Boats HPx lg", "lg|boats hpx", "lg"), (None, "unknown|unknown", None), ("Thing 12345 8gb", "unknown|thing|8gb", None)],
)
def test_brands_and_keys(spark, title, key, brand):
    t = spark.createDataFrame([(title,)], "x string").select(titles.parse_title(F.col("x")).alias("t")).first().t
    assert (t.match_key, t.brand) == (key, brand)


def test_categories_of_the_same_products_collide(spark):
    rows = [("a", "x"), ("a", "x"), ("a", "y"), ("b", "y"), ("b", "x"), ("c", "x"), ("d", None), ("d", "z")]
    got = {r.category: (r.products_found, r.collides, r.ok) for r in pages.category_health(spark.createDataFrame(rows, "category string, url string")).collect()}
    assert got == {"a": (2, True, False), "b": (2, True, False), "c": (1, False, True), "d": (1, False, True)}


def test_features_are_scale_free(spark):
    base = [100.0] * 15 + [140.0] * 8 + [95.0] * 7
    rows = {r.listing_id: r for r in features.features(series(spark, base, [p * 1000 for p in base], [25.0] * 20, [200.0 - k for k in range(30)], [5.0, 6.0])).collect()}
    assert 4 not in rows
    for name in features.NAMES:
        assert math.isclose(rows[0][name], rows[1][name], rel_tol=1e-6, abs_tol=1e-6)
    assert rows[0].rise_then_fall_score > 30 and rows[2].rise_then_fall_score == rows[3].rise_then_fall_score == 0
    assert all(math.isfinite(rows[k][n]) for k in rows for n in features.NAMES)


def claims(spark, *values):
    rows = [(k, "s", "stock", i, i, None if v is None else float(v)) for k, own in enumerate(values) for i, v in enumerate(own)]
    return spark.createDataFrame(rows, "listing_id long, site_key string, pattern_type string, at int, seq int, numeric_value double")


def test_scarcity_verdicts(spark):
    got = {r.listing_id: r for r in scarcity.claims(claims(spark, [3.0] * 8, [9.0, 8, 7, 6, 5, 4, 3], [1.0, 5, 2, 6, 1, 7, 2], [None] * 9, [2.0] * 3, [5.0, 5, 4, 4, 4, None, 3])).collect()}
    assert [got[k].verdict for k in range(6)] == ["static", "plausible", "erratic", "static", "insufficient", "plausible"]
    assert got[0].longest_static_run == 8 and got[2].changed_direction_count == 5 and got[3].longest_static_run == 9
    assert got[5].longest_static_run == 3 and got[5].modal_value == 4.0


def test_credibility(spark):
    def rows(site, mrps):
        return [(k + hash(site) % 1000 * 1000, site, 20260601, float(m), float(m) / 2, 50.0, "live") for k, m in enumerate(mrps)]

    data = rows("menu", [999] * 14 + [1499] * 10 + [1999] * 8 + [2499] * 4 + [2999] * 2) + rows("own", range(1000, 1022)) + rows("few", [1, 2, 3, 4, 5])
    obs = spark.createDataFrame(data, "listing_id long, site_key string, date_key int, mrp double, selling_price double, computed_discount_pct double, source string")
    got = {r.site_key: r for r in mrp.credibility(obs).collect()}
    assert got["menu"].verdict == "inconsistent with product-specific pricing" and got["menu"].n_distinct_mrp == 5
    assert got["own"].verdict == "consistent with product-specific pricing" and got["few"].verdict == "insufficient"
    both = mrp.compare(mrp.credibility(obs)).first()
    assert both.least_credible == "menu" and both.n_retailers == 3
    assert mrp.compare(mrp.credibility(obs.where("site_key = 'own'"))).first().note


def test_small_expressions(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert [one(ends_in_99(F.lit(float(v)))) for v in (99, 999, 23999, 2000, 89600)] == [True, True, True, False, False]
    assert one(computed_discount(F.lit(75.0), F.lit(100.0))) == 25.0 and one(computed_discount(F.lit(120.0), F.lit(100.0))) is None
    assert validation.required_sample_size() == 49 and validation.required_sample_size(0.05) == 196


def test_same_day_merge(spark):
    schema = "listing_id long, date_key int, source string, selling_price double, mrp double, rating string, seq int"
    first = spark.createDataFrame([(1, 20260601, "live", 100.0, 200.0, "a", 1)], schema)
    second = spark.createDataFrame([(1, 20260601, "live", 90.0, None, "b", 2), (2, 20260601, "live", None, None, None, 3)], schema)
    once = merge.merge_observations(first, merge.merge_batch(second, ["seq"]))
    row = once.where("listing_id = 1").first()
    assert (row.selling_price, row.mrp, row.rating) == (90.0, 200.0, "a") and once.count() == 2
    twice = merge.merge_observations(once, merge.merge_batch(second, ["seq"]))
    assert sorted(map(tuple, twice.collect()), key=repr) == sorted(map(tuple, once.collect()), key=repr)
    assert merge.duplicate_keys(once, ["listing_id"]).count() == 0


def test_claims_are_appended_once(spark):
    schema = "listing_id long, date_key int, pattern_type string, raw_text string"
    batch = spark.createDataFrame([(1, 1, "stock", "only 3 left"), (1, 1, "stock", "only 3 left")], schema)
    once = merge.append_claims(spark.createDataFrame([], schema), batch)
    assert once.count() == merge.append_claims(once, batch).count() == 1


def test_verdicts(spark):
    events = spark.createDataFrame([(1, 0, None, None), (2, 0, None, None)], "event_id long, manually_reviewed int, reviewer_verdict string, reviewer_note string")
    verdicts = spark.createDataFrame([(1, " Confirmed ", "x"), (2, "maybe", "y")], "event_id long, verdict string, reviewer_note string")
    got = {r.event_id: r for r in merge.update_verdicts(events, verdicts).collect()}
    assert got[1].reviewer_verdict == "confirmed" and got[1].manually_reviewed == 1 and got[2].reviewer_verdict is None


def test_wilson(spark):
    none = validation.precision_report(spark.createDataFrame([], "reviewer_verdict string")).first()
    assert (none.precision, none.ci_low, none.ci_high) == (0.0, 0.0, 0.0)
    all_ = validation.precision_report(spark.createDataFrame([("confirmed",)] * 50, "reviewer_verdict string")).first()
    assert all_.precision == 1.0 and 0.9 < all_.ci_low < 1 and all_.ci_high == 1.0


def test_pelt_finds_the_levels():
    y = np.array([10.0] * 12 + [14.0] * 8 + [9.0] * 10)
    assert anomaly.pelt(y, 3.0 * float(np.var(y))) == [12, 20, 30]
    assert anomaly.rise_and_fall([10.0, 14.0, 9.0]) == pytest.approx(min(40.0, 500 / 14))
    assert anomaly.pelt(np.full(20, 5.0), 1.0) == [20]


def test_forest_flags_its_share(spark):
    rng = np.random.default_rng(0)
    calm = [np.round(1000 + rng.normal(0, 2, 30), 2).tolist() for _ in range(38)]
    scored = anomaly.isolation_scores(features.features(series(spark, *calm, RAISED + [9_500] * 12, [100.0 + 50 * (k % 2) for k in range(30)])))
    flagged = anomaly.isolation_forest(scored, 0.05)
    assert {r.listing_id for r in flagged.collect()} == {38, 39}
    assert anomaly.isolation_scores(features.features(series(spark, RAISED))).count() == 0


def test_snapshots(spark, tmp_path):
    rows = [(DAY, "s", f"u{k}", f"t{k}", None, 10.0 + k, None, None, 1, 5, "live") for k in range(3)]
    items = spark.createDataFrame(rows, "obs_date date, site_key string, url string, raw_title string, category string, selling_price double, mrp double, discount_pct double, in_stock int, rating_count int, source string")
    assert tables.write_snapshot(items, f"{tmp_path}/snap", "2026-06-01") and not tables.write_snapshot(items, f"{tmp_path}/snap", "2026-06-02")
    back = tables.read_snapshots(spark, f"{tmp_path}/snap").orderBy("url").collect()
    assert [(r.obs_date, r.url, r.selling_price, r.mrp, r.category, r.rating_count) for r in back] == [(DAY, f"u{k}", 10.0 + k, None, "unknown", 5) for k in range(3)]
    assert tables.read_snapshots(spark, f"{tmp_path}/snap", since="2026-06-02").count() == 0


def test_tables(spark, tmp_path):
    root = str(tmp_path)
    assert tables.export({"a": spark.range(2), "b": spark.range(1)}, f"{root}/out") == {"a": "ok", "b": "ok"}
    sites = tables.sites({"defaults": {"strategy": "static", "delay": 4}, "sites": {"x": {"base_url": "http://x", "categories": ["a"]}}})
    assert sites["x"].strategy == "static" and sites["x"].extra == {"delay": 4} and tables.sweep_plan(sites, [{"id": "a", "sites": ["x", "y"]}]) == [("x", "a")]
    run = tables.run_row(spark, "inflation", {"b": 1, "a": 2}, 5, 1, "2026-06-01 00:00:00").first()
    assert run.params_json == '{"a": 2, "b": 1}'
    index = spark.createDataFrame([('[["k","timestamp","original","m","status"],["a","20260601010101","u","h","200"],["a","20260601020202","u","h","200"],["a","20260602","u","h","404"]]',)], "json string")
    assert [(r.url, str(r.day), r.timestamp) for r in tables.archive_days(index).collect()] == [("u", "2026-06-01", "20260601010101")]


def test_balanced_braces():
    assert pages.balanced('x = {"a": "}{", "b": {"c": 1}}; y', "x") == '{"a": "}{", "b": {"c": 1}}'
    assert pages.balanced("x = 3", "x") is None and pages.balanced("x = {", "x") is None
