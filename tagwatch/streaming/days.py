"""The daily batch as a stream: each micro-batch is merged, late rows keep their own source."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupStateTimeout

from tagwatch.operators.merge import merge_batch, merge_observations
from tagwatch.sources.tables import shared_folder


#: Milliseconds after which an idle listing's state goes.
IDLE = 30 * 24 * 3600 * 1000


def checkpoint_folder(spark: SparkSession) -> str:
    """A new folder in the cluster's shared one."""
    return f"{shared_folder(spark)}/tagwatch-stream-{uuid.uuid4().hex}"


def day_merge(stream: DataFrame, read_store: Callable[[], DataFrame], write_store: Callable[[DataFrame], None], checkpoint: str, order: list[str]) -> StreamingQuery:
    """Merge every micro-batch into the store by its key; a replayed batch changes nothing."""

    def merge(batch: DataFrame, _: int) -> None:
        write_store(merge_observations(read_store(), merge_batch(batch, order)))

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def daily_windows(stream: DataFrame, lateness: str = "7 days") -> DataFrame:
    """Average value by day and kind; a day closes when the watermark has passed it."""
    return stream.withWatermark("ts", lateness).groupBy(F.window("ts", "1 day"), "event_type").agg(F.count("*").alias("n"), F.sum(F.round(F.col("value") * 100).cast("long")).alias("hundredths"))


def sliding_average(stream: DataFrame, days: int = 7, lateness: str = "7 days") -> DataFrame:
    """Average value by kind over windows of ``days`` days that start every day, in hundredths and their count."""
    return stream.withWatermark("ts", lateness).groupBy(F.window("ts", f"{days} days", "1 day"), "event_type").agg(F.count("value").alias("n"), F.sum(F.round(F.col("value") * 100).cast("long")).alias("hundredths"))


def static_runs(stream: DataFrame, lateness: str = "30 days") -> DataFrame:
    """Running longest static run and number of reversals of each listing's counter, kept as state.

    stream: (listing_id, at, numeric_value); within a micro-batch rows are taken by time.  A reversal is a rise after a
    fall or a fall after a rise.  A listing of which nothing comes for IDLE of event time is forgotten.
    """

    def update(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        value, run, longest, sign, turns = state.get if state.exists else (None, 0, 0, 0, 0)
        new = pd.concat(list(frames)).sort_values("at", kind="stable")
        x, last = new["numeric_value"].to_numpy(float), int(new["at"].iloc[-1].timestamp() * 1000)
        x = x if value is None else np.concatenate(([value], x))
        edge = np.flatnonzero(np.diff(x) != 0)
        runs = np.diff(np.concatenate(([-1], edge, [len(x) - 1])))
        runs[0] += run - 1 if value is not None else 0
        signs = np.sign(np.diff(x)[edge]).astype(int)
        signs = signs if not sign else np.concatenate(([sign], signs))
        turns += int((signs[1:] != signs[:-1]).sum())
        longest = max(longest, int(runs.max()))
        state.update((float(x[-1]), int(runs[-1]), longest, int(signs[-1]) if len(signs) else 0, turns))
        state.setTimeoutTimestamp(max(last, state.getCurrentWatermarkMs()) + IDLE)
        yield pd.DataFrame({"listing_id": [key[0]], "longest_static_run": [longest], "n_reversals": [turns]})

    rows = stream.withWatermark("at", lateness).where(F.col("numeric_value").isNotNull()).select("listing_id", "at", "numeric_value")
    state = "value double, run long, longest long, sign long, turns long"
    return rows.groupBy("listing_id").applyInPandasWithState(update, "listing_id long, longest_static_run long, n_reversals long", state, "update", GroupStateTimeout.EventTimeTimeout)


def to_table(stream: DataFrame, folder: str, mode: str) -> DataFrame:
    """Run what is available to its end, each batch written below folder, and return the rows; a batch done again replaces its own."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/rows/batch={number}")

    query = stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    rows = stream.sparkSession.read.schema(T.StructType([*stream.schema.fields, T.StructField("batch", T.LongType())])).parquet(f"{folder}/rows")
    if mode == "complete":  # the last batch holds all
        rows = rows.join(F.broadcast(rows.agg(F.max("batch").alias("batch"))), "batch")
    return rows.drop("batch")
