"""Tables written to the shared folder, column names that cannot clash, and Arrow helpers."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tagwatch.plans.shipping import ship

#: Rows in an Arrow batch: bounds a worker's memory when texts are long.
BATCH_ROWS = 500


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (spark.checkpoint.dir); a temporary one only where none is named and all runs in this process."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return (named or f"file://{tempfile.gettempdir()}/tagwatch-shared").rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/tagwatch/{name}-{uuid.uuid4().hex}"


def _folder(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def passing(spark: SparkSession, path: str) -> None:
    """What is written at path goes when the driver's JVM ends."""
    at, files = _folder(spark, path)
    files.deleteOnExit(at)


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it again: lost executors cost no recomputation of what came before."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    passing(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def drop(df: DataFrame) -> None:
    """Delete a table that cut() wrote."""
    spark = df.sparkSession
    for file in df.inputFiles():
        at, files = _folder(spark, file)
        files.delete(at.getParent(), True)
        break


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names for columns of our own that no column of df has."""
    taken, mark = {c.lower() for c in df.columns}, "own"
    while any(f"{mark}_{n}" in taken for n in names):
        mark += "_"
    return [f"{mark}_{n}" for n in names]


def quoted(column: str) -> str:
    """The column's name as select() takes it, dots and back-ticks included."""
    return "`" + column.replace("`", "``") + "`"


def small_batches(spark: SparkSession) -> None:
    """Before any Python kernel: the package on the workers, and batches of BATCH_ROWS."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def map_arrow(
    df: DataFrame, kernel: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: T.StructType | str
) -> DataFrame:
    """df.mapInArrow(kernel, schema); kernels take columns by place, so their names do not matter."""
    small_batches(df.sparkSession)
    return df.toDF(*[f"c{k}" for k in range(len(df.columns))]).mapInArrow(kernel, schema)


def as_binary(column: pa.Array) -> list[bytes | None]:
    return column.cast(pa.binary()).to_pylist()


def blocks(batches: Iterator[pa.RecordBatch], limit: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Batches cut so that one holds about ``limit`` bytes, or a single row."""
    for batch in batches:
        rows = max(1, batch.num_rows * limit // max(1, batch.nbytes))
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
