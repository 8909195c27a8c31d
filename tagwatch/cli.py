"""Command line over a warehouse folder: python -m tagwatch.cli --root FOLDER VERB ..."""

from __future__ import annotations

import argparse
import datetime as dt
import logging
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagwatch.operators import anomaly, features, findings, inflation, ingest, marts, merge, mrp, pages, scarcity, stars, validation
from tagwatch.sources import synthetic, tables
from tagwatch.sources.warehouse import Warehouse

# Defaults of the command surface: fixed values.
REVIEW_SEED, CONTAMINATION, SAMPLE, TOP = 20260816, 0.25, 100, 10


def sources(args: argparse.Namespace) -> tuple[str, ...] | None:
    """Provenance by the flags: live alone, with backfill, or all."""
    if args.include_synthetic:
        return None
    return ("live", "wayback") if getattr(args, "include_backfill", False) else ("live",)


def show(df: DataFrame, top: int) -> None:
    for row in df.limit(top).toJSON().collect():
        print(row)


def opened(spark: SparkSession, args: argparse.Namespace) -> Warehouse:
    return Warehouse(spark, args.root, readonly=True)


def init(spark: SparkSession, args: argparse.Namespace) -> int:
    """Empty tables, and the days of the years around today."""
    today = dt.date.today()
    with Warehouse(spark, args.root) as house:
        for name in tables.SCHEMAS:
            house.write(name, house.read(name))
        house.write("dim_date", ingest.upsert_dates(house, f"{today.year - 1}-01-01", f"{today.year + 1}-12-31", []))
    return 0


def collect(spark: SparkSession, args: argparse.Namespace) -> int:
    """Ingest a folder of items (JSON lines, a day in obs_date)."""
    items = spark.read.schema(f"{ingest.ITEM}, obs_date date").json(args.items)
    items = items.withColumn("source", F.coalesce("source", F.lit("live"))).withColumn("seq", F.coalesce("seq", F.monotonically_increasing_id()))
    with Warehouse(spark, args.root) as house:
        show(ingest.store_items(house, items), 1)
    return 0


def backfill(spark: SparkSession, args: argparse.Namespace) -> int:
    """Ingest archived pages (url, timestamp, html) by a capture index."""
    captures = tables.archive_days(spark.read.text(args.index, wholetext=True).withColumnRenamed("value", "json"))
    found = pages.backfill(spark.read.parquet(args.pages), captures, {}, args.most)
    names = {c.split()[0]: c.split(" ", 1)[1] for c in ingest.ITEM.replace(", ", "\n").splitlines()}
    rows = found.withColumn("site_key", F.lit(args.site)).withColumn("category", F.lit("unknown")).withColumn("seq", F.xxhash64("url", "obs_date"))
    rows = rows.withColumns({c: F.lit(None).cast(kind) for c, kind in names.items() if c not in rows.columns})
    with Warehouse(spark, args.root) as house:
        show(ingest.store_items(house, rows.select(*names, "obs_date")), 1)
    return 0


def analyse(spark: SparkSession, args: argparse.Namespace) -> int:
    house, what, own = opened(spark, args), args.what, sources(args)
    obs = stars.observations(house)
    if what in ("inflation", "all"):
        found = inflation.events(obs, sources=own)
        show(inflation.summary(found, obs.agg(F.count_distinct("listing_id"))), 1)
        show(inflation.headline(found).orderBy(F.desc("overstatement_pp"), "listing_id").select("listing_id", "confidence", "headline"), args.top)
        store_events(spark, args.root, found, obs)
    if what in ("credibility", "all"):
        show(mrp.credibility(obs, own).orderBy("diversity_ratio", "site_key"), args.top)
    if what in ("mrp", "all"):
        quotes = obs if own is None else obs.where(F.col("source").isin(*own))
        day = stars.latest_day(quotes, None) if args.date is None else quotes.where(F.col("obs_date") == F.lit(args.date).cast("date"))
        show(mrp.contradictions(day).orderBy(F.desc("spread_pct"), "product_id"), args.top)
    if what in ("patterns", "all"):
        show(scarcity.claims(stars.claims(house)).orderBy(F.desc("longest_static_run"), "listing_id"), args.top)
    if args.write_findings:
        print(findings.write(house, args.write_findings, own))
    return 0


def store_events(spark: SparkSession, root: str, found: DataFrame, obs: DataFrame) -> None:
    """The events with a run of their own, in one commit."""
    rows = found.drop("evidence", "hold_days", "n_observations", "site_key", "title")
    rows = rows.withColumnsRenamed({"overstatement_pp": "discount_overstatement_pp", "rise_start": "rise_start_date", "sale_start": "sale_start_date"})
    run = tables.run_row(spark, "inflation", {}, obs.count(), rows.count(), dt.datetime.now().isoformat(timespec="seconds"))
    with Warehouse(spark, root) as house:
        ingest.append_run(house, run, inflation_event=rows)


def learn(spark: SparkSession, args: argparse.Namespace) -> int:
    obs, own = stars.observations(opened(spark, args)), sources(args)
    if args.what == "changepoint":
        show(anomaly.changepoints(obs, sources=own).orderBy(F.desc("score"), "listing_id"), args.top)
        return 0
    scored = anomaly.isolation_scores(features.features(timeline_of(obs, own)))
    if args.what == "detect":
        show(anomaly.isolation_forest(scored, args.contamination).orderBy(F.desc("score"), "listing_id").select("listing_id", "score", "top_features"), args.top)
        return 0
    truth = spark.read.parquet(f"{args.root}/truth")
    if args.what == "sensitivity":
        sweep = anomaly.contamination_sweep(scored, truth)
        show(sweep.orderBy("contamination"), 20)
        show(anomaly.best_and_worst(sweep), 1)
    else:
        sets = {"rules": inflation.events(obs, sources=own), "forest": anomaly.isolation_forest(scored, args.contamination), "changepoint": anomaly.changepoints(obs, sources=own)}
        show(validation.benchmark(sets, truth), 20)
    return 0


def timeline_of(obs: DataFrame, own: tuple[str, ...] | None) -> DataFrame:
    """Observations of the sources asked for, as the features take them."""
    return (obs if own is None else obs.where(F.col("source").isin(*own))).withColumn("source", F.lit("live"))


def synth(spark: SparkSession, args: argparse.Namespace) -> int:
    if args.what == "generate":
        items, truth = synthetic.items(spark, args.days, args.seed)
        with Warehouse(spark, args.root) as house:
            show(ingest.store_items(house, items), 1)
        truth.write.mode("overwrite").parquet(f"{args.root}/truth")
        truth.coalesce(1).write.mode("overwrite").json(f"{args.root}/truth_json")
        return 0
    found, truth = inflation.events(stars.observations(opened(spark, args)), sources=None), spark.read.parquet(f"{args.root}/truth")
    show(validation.confusion(found, truth, "rules"), 1)
    show(validation.overstatement_error(found, truth), 1)
    return 0


def validate(spark: SparkSession, args: argparse.Namespace) -> int:
    review = f"{args.root}/review"
    if args.what == "sample":
        chosen = validation.draw_sample(stars.events(opened(spark, args)), args.n, args.seed, "event_id")
        chosen.coalesce(1).write.mode("overwrite").option("header", True).csv(review)  # at most args.n rows
    elif args.what == "load":
        verdicts = spark.read.option("header", True).csv(args.file or review).select(F.col("event_id").cast("long"), "verdict", "reviewer_note")
        with Warehouse(spark, args.root) as house:
            house.write("inflation_event", merge.update_verdicts(house.read("inflation_event"), verdicts))
    else:
        show(validation.precision_report(opened(spark, args).read("inflation_event").where("reviewer_verdict is not null")), 1)
    return 0


def snapshot(spark: SparkSession, args: argparse.Namespace) -> int:
    told = tables.write_snapshot(stars.observations(opened(spark, args)), f"{args.root}/snapshots", args.date)
    print("written" if told else "nothing to write")
    return 0


def rebuild(spark: SparkSession, args: argparse.Namespace) -> int:
    """Replay snapshots through ingest: the day is that of the folder's name."""
    rows = tables.read_snapshots(spark, args.snapshots or f"{args.root}/snapshots", args.since)
    names = {c.split()[0]: c.split(" ", 1)[1] for c in ingest.ITEM.replace(", ", "\n").splitlines()}
    rows = rows.withColumn("seq", F.xxhash64("obs_date", "site_key", "url"))
    rows = rows.withColumns({c: F.lit(None).cast(kind) for c, kind in names.items() if c not in rows.columns})
    with Warehouse(spark, args.root) as house:
        show(ingest.store_items(house, rows.select(*names, "obs_date")), 1)
    return 0


def doctor(spark: SparkSession, args: argparse.Namespace) -> int:
    """Whether categories hold distinct products; 1 if any does not."""
    obs = stars.observations(opened(spark, args))
    health = pages.category_health(obs.select("category", "url"))
    show(health.orderBy("category"), 100)
    return int(not health.where("not ok").isEmpty())


def export(spark: SparkSession, args: argparse.Namespace) -> int:
    found = stars.exports(opened(spark, args), args.date or dt.date.today().isoformat(), args.include_synthetic)
    print(tables.export(found, f"{args.root}/export", args.format, include_synthetic=True))
    return 0


def status(spark: SparkSession, args: argparse.Namespace) -> int:
    house = opened(spark, args)
    print(house.counts())
    obs = stars.observations(house)
    show(marts.status_by_source(obs), 20)
    show(marts.last_days(obs), 14)
    return 0


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="tagwatch")
    top.add_argument("--root", required=True, help="warehouse folder")
    top.add_argument("--verbose", action="store_true")
    verbs = top.add_subparsers(dest="verb", required=True)

    def verb(name: str, run, *options: tuple[str, dict]) -> None:
        one = verbs.add_parser(name)
        for flag, how in options:
            one.add_argument(flag, **how)
        one.set_defaults(run=run)

    flag = {"action": "store_true"}
    synthetic_too, backfill_too, top_n = ("--include-synthetic", flag), ("--include-backfill", flag), ("--top", {"type": int, "default": TOP})
    what = lambda *names: ("what", {"choices": list(names)})
    verb("init", init)
    verb("collect", collect, ("--items", {"required": True}))
    verb("backfill", backfill, ("--pages", {"required": True}), ("--index", {"required": True}), ("--site", {"required": True}), ("--most", {"type": int, "default": 20}))
    verb("doctor", doctor)
    verb("analyse", analyse, what("mrp", "credibility", "inflation", "patterns", "all"), ("--date", {}), backfill_too, synthetic_too, top_n, ("--write-findings", {"metavar": "FILE"}))
    verb("ml", learn, what("detect", "changepoint", "benchmark", "sensitivity"), ("--contamination", {"type": float, "default": CONTAMINATION}), synthetic_too, top_n)
    verb("validate", validate, what("sample", "load", "report"), ("--n", {"type": int, "default": SAMPLE}), ("--seed", {"type": int, "default": REVIEW_SEED}), ("--file", {}))
    verb("synth", synth, what("generate", "evaluate"), ("--days", {"type": int, "default": 90}), ("--seed", {"type": int, "default": 42}))
    verb("snapshot", snapshot, ("--date", {"default": dt.date.today().isoformat()}))
    verb("rebuild", rebuild, ("--since", {}), ("--snapshots", {}))
    verb("export", export, ("--format", {"choices": ["parquet", "csv"], "default": "parquet"}), ("--date", {}), synthetic_too)
    verb("status", status)
    return top


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    logging.basicConfig(level=logging.DEBUG if args.verbose else logging.WARNING)
    spark = SparkSession.builder.appName("tagwatch").getOrCreate()
    try:
        return args.run(spark, args)
    except KeyboardInterrupt:
        return 130
    except Exception as error:  # noqa: BLE001
        logging.getLogger(__name__).debug("failed", exc_info=True)
        print(str(error).splitlines()[0], file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
