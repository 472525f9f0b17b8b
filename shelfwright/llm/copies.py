"""Exact duplicates by progressive refinement: length, then a hash of the beginning, then a hash of the whole text.

1. One pass over the documents, in the JVM, writes the length in bytes and a hash of the first ``HEAD`` characters of each:
   a few bytes a row. Lengths that one row alone has are done, and so are beginnings that one row of a length alone has.
2. What is left is told to the tasks as one bit for each of ``bits`` buckets of (length, beginning): 8 MB, whatever the
   corpus. The second pass hashes whole texts only where the bit is set. Two keys in one bucket cost a hash in vain and no
   more: rows are grouped by the keys themselves.
3. Rows with a whole hash (SHA-256) are grouped by length, beginning and whole hash, partial counts first, so that a
   group that holds a third of all rows is one row for each task. The way back to the rows is a join whose large keys
   Spark splits (adaptive skew joins); rows that were unique before take no part in it.

Texts are equal when they are identical after lower-casing A-Z. The row with the largest doc_id stays.

Defined cases: null text is empty, and all empty texts are one group; a null doc_id is smaller than all others (a group of
null ids alone has a null keep_id, and one of its rows stays); of rows that repeat both doc_id and text exactly one stays;
texts of any length are hashed as they stream by; an empty table gives an empty one; other columns do not matter.
"""

from __future__ import annotations

import hashlib
import string
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, materialize, table, texts

#: Characters of the beginning that are hashed, and buckets of the surviving keys.
HEAD, BITS = 64, 1 << 26

_SCHEMA = "doc_id long, length int, head long, whole binary, digest binary"
_ARROW = pa.schema([("doc_id", pa.int64()), ("length", pa.int32()), ("head", pa.int64()), ("whole", pa.binary()), ("digest", pa.binary())])


def lowered(text: Column | str) -> Column:
    """A-Z in lower case, all else as it is."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text, length in bytes and the hash of the beginning."""
    head = F.xxhash64(lowered(F.substring("text", 1, HEAD)))
    return texts(docs).select("doc_id", "text", F.octet_length("text").alias("length"), head.alias("head"))


def _bucket(bits: int) -> Column:
    return F.pmod(F.xxhash64("length", "head"), F.lit(bits))


def surviving(sketch: DataFrame) -> DataFrame:
    """(length, head) that more than one row has, of the lengths that more than one row has."""
    met = sketch.groupBy("length", "head").agg(F.count("*").alias("n"))  # copies are one row before anything meets by length
    lengths = met.groupBy("length").agg(F.sum("n").alias("rows")).where("rows > 1")
    return met.join(lengths, "length", "left_semi").where("n > 1").select("length", "head")


def marks(keys: DataFrame, bits: int = BITS) -> np.ndarray:
    """A bit for each bucket that a key falls in, 64 to a word; at most ``bits`` / 64 words reach the driver."""
    b = _bucket(bits)
    words = keys.groupBy(F.shiftright(b, 6).alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (b % 64).cast("int"))).alias("set"))
    got, out = words.toArrow(), np.zeros(-(-bits // 64), np.int64)
    out[got["word"].to_numpy()] = got["set"].to_numpy()
    return out


def _hashed(batches: Iterator[pa.RecordBatch], told: Broadcast, every: bool) -> Iterator[pa.RecordBatch]:
    for b in batches:
        at = b.column(3).to_numpy()
        left = (told.value[at >> 6] >> (at & 63)) & 1 == 1
        whole: list[bytes | None] = [None] * len(at)
        digest = list(whole)
        for i in range(len(at)) if every else np.flatnonzero(left).tolist():
            d = hashlib.sha256(b.column(4)[i].as_buffer().to_pybytes().translate(LOWER)).digest()
            digest[i] = d
            if left[i]:
                whole[i] = d
        yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(whole, pa.binary()), pa.array(digest, pa.binary())], schema=_ARROW)


def deduplicate(docs: DataFrame, every_digest: bool = False, bits: int = BITS) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, digest) of every row.

    ``digest`` is the SHA-256 of the lower-cased text: of rows that were compared as a whole, or with ``every_digest`` of all.
    """
    spark = docs.sparkSession
    sketch = materialize(_keyed(docs).select("length", "head"), "sketch")
    told = spark.sparkContext.broadcast(marks(surviving(sketch), bits))
    read = _keyed(docs).select("doc_id", "length", "head", _bucket(bits).alias("bucket"), F.col("text").cast("binary").alias("text"))
    hashed = read.mapInArrow(partial(_hashed, told=told, every=every_digest), _SCHEMA)
    rows = materialize(hashed.withColumn("row", F.monotonically_increasing_id()), "hashed")
    compared = rows.where("whole is not null")
    key = ["length", "head", "whole"]
    # written, so that the way back is a join of two tables, whose large keys can be split
    groups = materialize(compared.groupBy(*key).agg(F.count("*").alias("group_size"), F.max(F.struct("doc_id", "row")).alias("last")), "groups")
    met = compared.join(groups, key).select("doc_id", F.col("last.doc_id").alias("keep_id"), "group_size", (F.col("row") == F.col("last.row")).alias("kept"), "digest")
    alone = rows.where("whole is null").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "digest")
    return alone.union(met)


def drop(docs: DataFrame) -> DataFrame:
    """The documents without copies; needs a doc_id that is unique where it is not null. Rows of null ids stay."""
    gone = deduplicate(docs).where("not kept").select("doc_id")
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)


def op12_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Group of equal texts and the one that stays, of every document."""
    d = deduplicate(table(spark, sf_dir, "documents"), every_digest=True)
    return d.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


OP12_SQL = f"""
WITH n AS (SELECT doc_id, translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}') AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM n JOIN g USING (t)
"""
