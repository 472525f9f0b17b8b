"""Versioned tables: each commit writes new versions first and then one pointer batch, so readers see all of it or none.

A commit first claims its batch by creating a file that must not exist, which the file system lets one writer do; another
one that began from the same state is told so before it writes.
"""

from __future__ import annotations

import threading
from contextlib import contextmanager

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_POINTERS = "batch long, name string, version long"


class Conflict(RuntimeError):
    """Another writer is committing, or has committed, from the same state. A claim left by one that ended is let go by ``release``."""


class Store:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self._lock = spark, path.rstrip("/"), threading.Lock()

    def _pointers(self) -> list:
        try:
            df = self.spark.read.schema(_POINTERS).parquet(f"{self.path}/_pointers")
            return df.groupBy("name").agg(F.max("version").alias("version")).collect()  # a row per table
        except AnalysisException:
            return []

    def version(self, name: str) -> int | None:
        return next((r["version"] for r in self._pointers() if r["name"] == name), None)

    def read(self, name: str, schema: str | None = None) -> DataFrame:
        """The current version; an empty table of ``schema`` if there is none."""
        v = self.version(name)
        if v is None:
            if schema is None:
                raise KeyError(name)
            return self.spark.createDataFrame([], schema)
        return self.spark.read.parquet(f"{self.path}/{name}/v{v}")

    @contextmanager
    def writing(self):
        """One writer at a time in this process."""
        with self._lock:
            yield self

    def _claim(self, batch: int):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/_claims/{batch}")
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def release(self, batch: int) -> None:
        path, fs = self._claim(batch)
        fs.delete(path, False)

    def commit(self, tables: dict[str, DataFrame]) -> int:
        """Writes the tables as versions named by the batch and points to them in one step."""
        batch = max((r["version"] for r in self._pointers()), default=0) + 1
        path, fs = self._claim(batch)
        try:
            fs.create(path, False).close()
        except Py4JJavaError as e:
            if "AlreadyExists" in str(e.java_exception):
                raise Conflict(f"batch {batch}") from None
            raise
        try:
            for name, df in tables.items():
                df.write.mode("overwrite").parquet(f"{self.path}/{name}/v{batch}")
            rows = [(batch, name, batch) for name in tables]
            self.spark.createDataFrame(rows, _POINTERS).coalesce(1).write.mode("append").parquet(f"{self.path}/_pointers")
        except BaseException:
            self.release(batch)
            raise
        return batch
