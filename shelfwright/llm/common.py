"""Helpers shared by the corpus operators."""

from __future__ import annotations

import os
import tempfile
import uuid
import zlib
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Deletes nothing and maps A-Z to a-z: what ``bytes.translate`` needs to lower ASCII only.
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or one of our own where it is unset and Spark runs on one machine."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        top = spark.sparkContext.getCheckpointDir()
    if not top:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        os.makedirs("/tmp/checkpoints", exist_ok=True)  # one machine, as in tests
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(dir="/tmp/checkpoints"))
        top = spark.sparkContext.getCheckpointDir()
    return top.rstrip("/")


#: Spark's switch that removes a query's shuffle files when the query is over.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


#: The tables that ``materialize`` wrote and that are still there, one list for each scope that is open.
_WRITTEN: ContextVar[tuple[list[str], ...]] = ContextVar("written", default=([],))


def _write(df: DataFrame, name: str) -> str:
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _WRITTEN.get()[-1].append(path)
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    return path


def materialize(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back: lineage is cut and lost executors lose nothing.

    The shuffle files of the write are not needed afterwards and go at once. The table stays until the ``scope`` that it
    was written in ends; outside of all scopes, until ``discard``.
    """
    return df.sparkSession.read.schema(df.schema).parquet(_write(df, name))


def _folders(df: DataFrame) -> set[str]:
    return {f.rpartition("/")[0].rpartition("/")[2] for f in df.inputFiles()}


def _file_system(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark._jsc.hadoopConfiguration())


def _delete(spark: SparkSession, written: list[str], paths: list[str]) -> None:
    for path in paths:
        target, fs = _file_system(spark, path)
        fs.delete(target, True)
        written.remove(path)


def discard(df: DataFrame) -> None:
    """Delete what ``materialize`` wrote for ``df``, once nothing that is still to run reads it."""
    own = _folders(df)
    for written in _WRITTEN.get():
        _delete(df.sparkSession, written, [p for p in written if p.rpartition("/")[2] in own])


@contextmanager
def scope(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Deletes at its end the tables that ``materialize`` wrote inside it, and no others, but for those read by the tables
    that were handed to the function it gives: they belong to the scope around it. Lazy results of one scope must be
    written before it ends. Scopes of other threads and queries are not touched.
    """
    outer, written, kept = _WRITTEN.get(), [], set()

    def keep(df: DataFrame) -> DataFrame:
        kept.update(_folders(df))
        return df

    token = _WRITTEN.set((*outer, written))
    try:
        yield keep
    finally:
        _WRITTEN.reset(token)
        outer[-1].extend(p for p in written if p.rpartition("/")[2] in kept)
        _delete(spark, written, [p for p in written if p.rpartition("/")[2] not in kept])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id and text, null text as the empty one, and further columns."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"), *more)


def fold(doc_id: int | None, k: int = 5) -> int:
    """crc32 of the decimal doc_id modulo ``k`` (a null id counts as empty text)."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % k


def fold_col(column: str = "doc_id", k: int = 5):
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % k


def small(df: DataFrame, rows: int, room: int = 32 << 20) -> DataFrame:
    """``df`` written once and, if it has no more than ``rows`` rows and ``room`` bytes of files, marked for broadcasting; beyond that joins shuffle."""
    spark, path = df.sparkSession, _write(df, "small")
    target, fs = _file_system(spark, path)
    df = spark.read.schema(df.schema).parquet(path)
    return F.broadcast(df) if fs.getContentSummary(target).getLength() <= room and df.count() <= rows else df


def draw(df: DataFrame, n: int, *key: str, seed: int) -> DataFrame:
    """At most ``n`` rows, those with the smallest hash of the key columns. Rows that cannot be among them are filtered
    out by the hash first, so that no task hands on more than its share."""
    h = F.xxhash64(*key, F.lit(seed))
    total = df.count()
    if total > 2 * n:
        df = df.where(F.shiftright(h, 1) + (1 << 62) < min((1 << 63) - 1, int((1 << 63) * (1.5 * (n + 50) / total))))
    return df.orderBy(h, *key).limit(n)


def free(columns: list[str], *names: str) -> list[str]:
    """The names, lengthened until none is a column's (Spark's names ignore case)."""
    taken, out = {c.lower() for c in columns}, []
    for n in names:
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return out


def rows(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[tuple]:
    """The named columns of Arrow batches as Python tuples, one batch in memory at a time."""
    for b in batches:
        yield from zip(*(b.column(b.schema.get_field_index(n)).to_pylist() for n in names), strict=True)


def batch(schema: pa.Schema, columns: dict[str, object]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)
