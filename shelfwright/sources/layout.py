"""How the catalogue's tables lie on disk: by root and shelf where scans write them, by series where questions read them.

A shelf is a share of a root's folders by hash. A scan of a root reads and rewrites the partitions of that root alone, a scan
of one folder those of its shelf; all other files stay as they are. For questions the tables are bucketed and sorted by
series, so that what is grouped by series or joined on it is not shuffled again.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch

SHELVES = 64
_PLACE = "root_id string, shelf int"


def shelf_of(folder: Column, shelves: int = SHELVES) -> Column:
    return F.pmod(F.xxhash64(folder), F.lit(shelves)).cast("int")


class Rooted:
    """Tables partitioned by root_id and shelf, and tables that only grow."""

    def __init__(self, spark: SparkSession, path: str, shelves: int = SHELVES):
        self.spark, self.path, self.shelves = spark, path.rstrip("/"), shelves

    def _read(self, name: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")
        except AnalysisException:  # nothing has been written yet
            return self.spark.createDataFrame([], schema)

    def read(self, name: str, schema: str, root_id: str | None = None, folder: str | None = None) -> DataFrame:
        """A table with ``root_id`` and ``shelf``, pruned to a root's partitions or to those of a folder's shelf."""
        columns = ", ".join(c for c in schema.split(", ") if not c.startswith("root_id "))
        d = self._read(name, f"{columns}, {_PLACE}")
        if root_id is not None:
            d = d.where(F.col("root_id") == root_id)
        return d if folder is None else d.where(F.col("shelf") == shelf_of(F.lit(folder), self.shelves))

    def log(self, name: str, schema: str) -> DataFrame:
        return self._read(name, schema)

    def append(self, name: str, rows: DataFrame) -> None:
        rows.write.mode("append").parquet(f"{self.path}/{name}")

    def replace(self, tables: dict[str, DataFrame]) -> None:
        """Overwrites the partitions that the tables have rows in. All are written aside first, as they were made from what they replace."""
        aside = f"{scratch(self.spark)}/aside-{uuid.uuid4().hex}"
        for name, df in tables.items():
            df.write.parquet(f"{aside}/{name}")
        for name, df in tables.items():
            own = self.spark.read.schema(df.schema).parquet(f"{aside}/{name}").repartition("root_id", "shelf")
            own.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("root_id", "shelf").parquet(f"{self.path}/{name}")


def save_by_series(tables: dict[str, DataFrame], folder: str, buckets: int, keys: dict[str, str]) -> dict[str, DataFrame]:
    """Writes tables below a folder in as many buckets of their key (``keys``, else series_id), sorted by it, and gives them to read.

    The tables are known to this session under new names; what is on disk can be registered again with the same buckets.
    """
    out = {}
    for name, df in tables.items():
        key, known = keys.get(name, "series_id"), f"shelf_{uuid.uuid4().hex}"
        df.repartition(buckets, key).write.format("parquet").bucketBy(buckets, key).sortBy(key).option("path", f"{folder}/{name}").saveAsTable(known)
        out[name] = df.sparkSession.table(known)
    return out
