"""Wall times of the headline queries: prints one JSON line.

Environment: BENCH_SF_DIR (tables), BENCH_CPUS (threads).
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from tagwatch.plans.queries import QUERIES

HEADLINE = [
    "price_timeline",
    "inflation_candidates_sql",
    "inflation_events",
    "mrp_dispersion_latest",
    "mrp_contradictions",
    "mrp_credibility",
    "scarcity_claims",
    "features_matrix",
    "mart_daily_prices",
    "mart_category_summary",
    "same_day_merge",
    "panel_seed",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf}/events.parquet").count()  # the JVM is up
    times = {}
    for name in HEADLINE:
        began = time.time()
        QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - began, 3)
    warm = {}
    for name in HEADLINE:  # once more, when code is compiled and files are cached
        began = time.time()
        QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        warm[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "headline queries, cold", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "warm": warm, "sf": sf.rstrip("/").rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
