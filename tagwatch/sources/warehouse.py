"""A warehouse folder: versions of tables, committed together.

Every table lives below ``root/data/<name>-<version>``.  A commit writes new
versions first and then one head file, ``root/heads/<number>.json``, that names
the version of each table; the file appears by a rename onto a name that must
not exist.  So readers see all of a commit or nothing of it, a failed one leaves
the last head as it was, and of two writers that began alike the second fails.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Mapping
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagwatch.sources.tables import SCHEMAS, schema_of

#: Commits whose tables are kept, so that readers of the one before can finish.
KEPT = 2


class Conflict(RuntimeError):
    """Another commit came first."""


class Warehouse:
    """The tables below a folder; as a context manager it commits what was written, unless the block failed."""

    def __init__(self, spark: SparkSession, root: str, readonly: bool = False):
        self.spark, self.root, self.readonly = spark, root.rstrip("/"), readonly
        self._staged: dict[str, str] = {}
        self._scratch: list[str] = []
        self._number, self._versions = self._head()

    def _path(self, at: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{at}")
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _numbers(self) -> list[int]:
        path, files = self._path("heads")
        if not files.exists(path):
            return []
        names = [x.getPath().getName() for x in files.listStatus(path)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n[0] != ".")

    def _head(self, number: int | None = None) -> tuple[int, dict[str, str]]:
        numbers = self._numbers()
        if not numbers:
            return 0, {}
        number = numbers[-1] if number is None else number
        return number, json.loads(self.spark.read.text(f"{self.root}/heads/{number:012d}.json", wholetext=True).first()[0])

    def names(self) -> list[str]:
        return sorted(self._versions)

    def read(self, name: str) -> DataFrame:
        """The table as this block sees it: its own writes, else the head's; a table that is not there yet is empty."""
        version = self._staged.get(name) or self._versions.get(name)
        if version is None:
            return self.spark.createDataFrame([], schema_of(name))
        frame = self.spark.read.schema(schema_of(name)) if name in SCHEMAS else self.spark.read
        return frame.parquet(f"{self.root}/data/{version}")

    def write(self, name: str, df: DataFrame) -> DataFrame:
        """Stage a new version of a table."""
        if self.readonly:
            raise PermissionError(f"{self.root} was opened for reading")
        version = f"{name}-{uuid.uuid4().hex}"
        rows = df.select(*[F.col(f.name).cast(f.dataType) for f in schema_of(name)]) if name in SCHEMAS else df
        rows.write.parquet(f"{self.root}/data/{version}")
        self._drop(self._staged.pop(name, None))
        self._staged[name] = version
        return self.read(name)

    def scratch(self, df: DataFrame) -> DataFrame:
        """df written beside the tables and read again, until clear()."""
        version = f"scratch-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.root}/data/{version}")
        self._scratch.append(version)
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/data/{version}")

    def clear(self) -> None:
        for version in self._scratch:
            self._drop(version)
        self._scratch = []

    def _drop(self, version: str | None) -> None:
        if version:
            path, files = self._path(f"data/{version}")
            files.delete(path, True)

    def commit(self) -> None:
        if not self._staged:
            return
        number, versions = self._number + 1, {**self._versions, **self._staged}
        path, files = self._path(f"heads/{number:012d}.json")
        if files.exists(path):
            raise Conflict(f"{self.root}: commit {number} is another's")
        staged, _ = self._path(f"heads/.{uuid.uuid4().hex}")
        out = files.create(staged)
        out.write(bytearray(json.dumps(versions, sort_keys=True).encode()))
        out.close()
        if not files.rename(staged, path):
            files.delete(staged, False)
            raise Conflict(f"{self.root}: commit {number} is another's")
        self._number, self._versions, self._staged = number, versions, {}
        self._forget()

    def _forget(self) -> None:
        """Drop versions that no kept head names."""
        numbers = self._numbers()
        old, kept = numbers[:-KEPT], {v for n in numbers[-KEPT:] for v in self._head(n)[1].values()}
        for number in old:
            for version in set(self._head(number)[1].values()) - kept:
                self._drop(version)
            path, files = self._path(f"heads/{number:012d}.json")
            files.delete(path, False)

    def rollback(self) -> None:
        for version in self._staged.values():
            self._drop(version)
        self._staged = {}
        self.clear()

    def __enter__(self) -> Warehouse:
        return self

    def __exit__(self, kind, value, trace) -> None:
        if kind is None:
            try:
                self.commit()
            except BaseException:
                self.rollback()
                raise
        else:
            self.rollback()

    def counts(self) -> dict[str, int]:
        """Rows of each table of the model; -1 where it is not there."""
        return {name: self.read(name).count() if name in self._versions or name in self._staged else -1 for name in SCHEMAS}

    def views(self, prefix: str = "") -> list[str]:
        """Every table as a temporary view, for SQL."""
        for name in self.names():
            self.read(name).createOrReplaceTempView(f"{prefix}{name}")
        return [f"{prefix}{name}" for name in self.names()]

    def run_file(self, path: str, params: Mapping[str, object] | None = None) -> DataFrame:
        """The query of a file over the tables' views, with :named parameters."""
        self.views()
        sql = "".join(r[0] for r in self.spark.read.text(path, wholetext=True).collect())
        return self.spark.sql(sql.strip().rstrip(";"), args=dict(params or {}))


def update(spark: SparkSession, root: str, change: Callable[[Warehouse], object]) -> object:
    """change(warehouse) in one commit."""
    with Warehouse(spark, root) as house:
        return change(house)


def table_name(path: str) -> str:
    """The table of a version's folder."""
    return PurePosixPath(path).name.rpartition("-")[0]
