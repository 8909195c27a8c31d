"""Schemas, snapshots, exports and configuration."""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Columns of the model's tables as DDL.
SCHEMAS = {
    "dim_product": "product_id long, match_key string, brand string, model string, variant string, category string, canonical_title string, first_seen_date date, created_at timestamp",
    "dim_seller": "seller_id long, site_key string, site_name string, seller_name string, is_first_party int",
    "dim_listing": "listing_id long, product_id long, seller_id long, site_key string, site_product_id string, url string, raw_title string, first_seen_date date, last_seen_date date, is_active int",
    "dim_date": "date_key int, date date, year int, quarter int, month int, month_name string, day int, day_of_week int, day_name string, is_weekend int, festival_window string, is_festival int, days_to_festival int",
    "fact_price_observation": "observation_id long, listing_id long, date_key int, product_id long, seller_id long, selling_price double, mrp double, discount_pct double, computed_discount_pct double, in_stock int, rating double, rating_count int, scraped_at timestamp, source string, raw_snapshot string",
    "fact_dark_pattern": "pattern_id long, listing_id long, date_key int, pattern_type string, raw_text string, numeric_value double, scraped_at timestamp, source string",
    "analysis_run": "run_id long, run_type string, run_at timestamp, params_json string, n_input long, n_flagged long, notes string",
    "inflation_event": "event_id long, run_id long, listing_id long, product_id long, baseline_price double, peak_price double, sale_price double, rise_pct double, claimed_discount_pct double, real_discount_pct double, discount_overstatement_pp double, rise_start_date date, sale_start_date date, days_between int, confidence string, manually_reviewed int, reviewer_verdict string, reviewer_note string",
    "mrp_contradiction": "contradiction_id long, run_id long, product_id long, date_key int, n_sellers int, min_mrp double, max_mrp double, median_mrp double, spread_pct double, worst_listing_id long, worst_site_key string, inflation_vs_median_pct double",
}
SNAPSHOT = ["obs_date", "site_key", "url", "raw_title", "category", "selling_price", "mrp", "discount_pct", "in_stock", "rating_count", "source"]


def schema_of(name: str) -> T.StructType:
    return T._parse_datatype_string(SCHEMAS[name])


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; a temporary one only where none is named and all runs in this process."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return (named or f"file://{tempfile.gettempdir()}").rstrip("/")


def held(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again, so that it is worked out once; it goes when the driver's JVM ends."""
    spark = df.sparkSession
    target = f"{shared_folder(spark)}/tagwatch-{name}-{uuid.uuid4().hex}"
    df.write.parquet(target)
    path = spark._jvm.org.apache.hadoop.fs.Path(target)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return spark.read.schema(df.schema).parquet(target)


def query(spark: SparkSession, sql: str, *params) -> DataFrame:
    """A query with positional ? parameters."""
    return spark.sql(sql, args=list(params)) if params else spark.sql(sql)


def lenient_double(text):
    return F.nullif(F.nullif(F.trim(text), F.lit("")), F.lit("None")).try_cast("double")


def lenient_int(text):
    """Through a double, so that '3.0' is 3; null where that fails."""
    return lenient_double(text).try_cast("int")


def write_snapshot(items: DataFrame, root: str, day: str) -> bool:
    """A day's live items as gzip CSV below ``root/YYYY-MM-DD``, ordered by site and link; False where there are none."""
    rows = items.where((F.col("obs_date") == F.lit(day).cast("date")) & (F.col("source") == "live")).select(*SNAPSHOT)
    if rows.isEmpty():
        return False
    rows.orderBy("site_key", "url").write.mode("overwrite").option("header", True).option("compression", "gzip").csv(f"{root}/{day}")
    return True


def read_snapshots(spark: SparkSession, root: str, since: str | None = None) -> DataFrame:
    """Items of all snapshots; the day is that of the folder's name, bad numbers are null."""
    text = T.StructType([T.StructField(c, T.StringType()) for c in SNAPSHOT])
    rows = spark.read.schema(text).option("header", True).csv(f"{root}/*/")
    day = F.regexp_extract(F.col("_metadata.file_path"), r"(\d{4}-\d{2}-\d{2})/[^/]*$", 1).try_cast("date")
    out = rows.select(
        day.alias("obs_date"),
        "site_key",
        "url",
        "raw_title",
        F.coalesce("category", F.lit("unknown")).alias("category"),
        *[lenient_double(F.col(c)).alias(c) for c in ("selling_price", "mrp", "discount_pct")],
        *[lenient_int(F.col(c)).alias(c) for c in ("in_stock", "rating_count")],
        F.coalesce("source", F.lit("live")).alias("source"),
    )
    return out if since is None else out.where(F.col("obs_date") >= F.lit(since).cast("date"))


def export(tables: Mapping[str, DataFrame], out: str, fmt: str = "parquet", include_synthetic: bool = False) -> dict[str, str]:
    """Each table below out; a table that fails is reported and does not stop the others."""
    told = {}
    for name, df in tables.items():
        try:
            rows = df if include_synthetic or "source" not in df.columns else df.where(F.col("source") != "synthetic")
            writer = rows.write.mode("overwrite")
            writer.option("header", True).csv(f"{out}/{name}") if fmt == "csv" else writer.parquet(f"{out}/{name}")
            told[name] = "ok"
        except Exception as error:  # noqa: BLE001
            told[name] = str(error).splitlines()[0]
    return told


def run_row(spark: SparkSession, run_type: str, params: Mapping[str, object], n_input: int, n_flagged: int, at: str, notes: str = "") -> DataFrame:
    """An analysis_run of one row; the id follows from what was run and when."""
    text = json.dumps(dict(params), sort_keys=True)
    row = spark.createDataFrame([(run_type, text, n_input, n_flagged, notes)], "run_type string, params_json string, n_input long, n_flagged long, notes string")
    return row.select(F.xxhash64(F.lit(at), "run_type", "params_json").alias("run_id"), "run_type", F.lit(at).cast("timestamp").alias("run_at"), "params_json", "n_input", "n_flagged", "notes")


def read_truth(spark: SparkSession, path: str) -> DataFrame:
    """The planted events of a ground-truth file."""
    return spark.read.option("multiLine", True).json(path).select(F.explode("planted").alias("p")).select("p.*")


@dataclass(frozen=True)
class Site:
    key: str
    name: str = ""
    base_url: str = ""
    strategy: str = "static"
    categories: tuple[str, ...] = ()
    extra: Mapping[str, object] = field(default_factory=dict)


def sites(config: Mapping[str, Mapping[str, object]]) -> dict[str, Site]:
    """Sites of a configuration: defaults merged under each, unknown keys kept in extra."""
    defaults = dict(config.get("defaults", {}))
    known = set(Site.__dataclass_fields__) - {"key", "extra"}
    out = {}
    for key, own in dict(config.get("sites", {})).items():
        merged = {**defaults, **dict(own)}
        out[key] = Site(key, **{k: tuple(v) if isinstance(v, list) else v for k, v in merged.items() if k in known}, extra={k: v for k, v in merged.items() if k not in known})
    return out


def load_yaml(path: str) -> dict:
    import yaml

    with open(path, encoding="utf-8") as file:
        return yaml.safe_load(file) or {}


def sweep_plan(site_table: Mapping[str, Site], categories: list[Mapping[str, object]]) -> list[tuple[str, str]]:
    """(site, category) pairs from categories that name their sites."""
    return sorted((str(s), str(c["id"])) for c in categories for s in c.get("sites", []) if s in site_table)


def archive_days(listing: DataFrame) -> DataFrame:
    """Archive index rows, a JSON array of arrays under a header, as one capture per link and day with status 200."""
    rows = listing.select(F.posexplode(F.from_json("json", "array<array<string>>")).alias("k", "r")).where("k > 0")
    named = rows.select(F.col("r")[1].alias("timestamp"), F.col("r")[2].alias("url"), F.col("r")[4].alias("status")).where("status = '200'")
    return named.groupBy("url", F.to_date(F.substring("timestamp", 1, 8), "yyyyMMdd").alias("day")).agg(F.min("timestamp").alias("timestamp"))
