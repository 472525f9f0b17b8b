"""Folding of records into series for searches of any size: buckets of equal keys are rows, and no query is one task.

The three steps of ``candidates.fold``, each over all buckets of all queries at once:

1. Keys that differ by a number alone: each key meets the others by what is left without one of its numbers.
2. A single record whose key begins with a larger bucket's: beginnings of keys meet whole keys.
3. Keys that differ by an inserted subtitle: a key meets the others by what deletions in its middle leave, and what meets is
   looked at closely.

A step judges all moves by the buckets as they are when it begins. A bucket that moves into one that moves as well goes along:
pointers are followed to their ends, twice as far in each round. They go to shorter keys in the second step, and to larger
or later buckets in the third, so there is no cycle.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.registry import series_key
from ..functions.schema import ddl
from ..functions.titles import strip_volume_digits
from ..session import scratch
from .candidates import END_LEAST, FOLDED, INNER_LEAST, ITEM_NAMES, OTHER_BOOK, inner_cut, runs_in

_BUCKET = ["query_id", "key"]


def _written(df: DataFrame) -> DataFrame:
    path = f"{scratch(df.sparkSession)}/fold-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _each(batches: Iterator[pa.RecordBatch], schema: pa.Schema, rows) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = [x for row in zip(*(c.to_pylist() for c in b.columns)) for x in rows(*row)]
        yield pa.RecordBatch.from_pylist([dict(zip(schema.names, x)) for x in out], schema=schema)


_BONES = pa.schema([("query_id", pa.int64()), ("key", pa.string()), ("at", pa.int32()), ("number", pa.int32()), ("bone", pa.string())])
_CUTS = pa.schema([("query_id", pa.int64()), ("long", pa.string()), ("key", pa.string())])


def _bones(query_id: int, key: str, lo: int | None, hi: int | None) -> Iterator[tuple]:
    """The key without each of its numbers that its records' own volumes allow."""
    for at, (number, bone) in enumerate(runs_in(key)):
        if lo is None or lo == hi == number:
            yield query_id, key, at, number, bone


def _cuts(query_id: int, key: str, lengths: list[int]) -> Iterator[tuple]:
    """What deletions that leave one of the lengths leave of a key; both ends stay."""
    n = len(key)
    left = {key[:head] + key[head + n - m :] for m in lengths for head in range(END_LEAST, m - END_LEAST + 1)}
    return ((query_id, key, x) for x in left)


def _allowed(query_id: int, long: str, key: str) -> Iterator[tuple]:
    cut = inner_cut(key, long)
    if cut and not OTHER_BOOK.search(cut):
        yield query_id, long, key


@F.pandas_udf(ddl("string"))
def _without(title: pd.Series, number: pd.Series) -> pd.Series:
    return pd.Series([t if t is None or n is None or n != n else strip_volume_digits(t, int(n)) for t, n in zip(title, number)], dtype="object")


def _ends(moves: DataFrame) -> DataFrame:
    """(query_id, key, to) with ``to`` followed to where nothing moves on."""
    while True:
        moves = _written(moves)
        on = moves.select("query_id", F.col("key").alias("to"), F.col("to").alias("_on"))
        longer = moves.join(on, ["query_id", "to"], "left")
        if longer.where("_on is not null").isEmpty():
            return moves
        moves = longer.select("query_id", "key", F.coalesce("_on", "to").alias("to"))


def _moved(buckets: DataFrame, ends: DataFrame) -> DataFrame:
    """The buckets after moves: those that stay, with the sizes of what has come, and in their own order."""
    d = buckets.join(ends, _BUCKET, "left").withColumn("_to", F.coalesce("to", "key"))
    own = F.when(F.col("to").isNull(), F.struct("born", "first"))
    d = d.groupBy("query_id", F.col("_to").alias("key")).agg(F.sum("size").alias("size"), F.max(own).alias("_o"))
    return d.select(*_BUCKET, "size", "_o.born", "_o.first")


def _numbered(buckets: DataFrame) -> DataFrame:
    """(query_id, key, to, number): a number's key goes to a bucket of two or more records without it, else where others go that differ by it alone."""
    some = buckets.where(F.col("key").rlike("[0-9]")).select(*_BUCKET, "lo", "hi")
    runs = some.mapInArrow(lambda b: _each(b, _BONES, _bones), "query_id long, key string, at int, number int, bone string")
    kin = runs.groupBy("query_id", "bone").agg(F.count_distinct("key").alias("kin"))
    there = buckets.select("query_id", F.col("key").alias("bone"), "size")
    d = runs.join(kin, ["query_id", "bone"]).join(there, ["query_id", "bone"], "left")
    grown = F.coalesce(F.col("size") >= 2, F.lit(False))
    best = F.min(F.struct((~grown).alias("a"), F.col("at").alias("b"), F.col("bone").alias("to"), F.col("number").alias("number")))
    return d.where(grown | (F.col("kin") >= 2)).groupBy(*_BUCKET).agg(best.alias("x")).select(*_BUCKET, "x.to", "x.number")


def _singles(buckets: DataFrame) -> DataFrame:
    """(query_id, key, to): single records and new buckets go to the bucket of several with the longest key that begins theirs."""
    parents = buckets.where("size > 1").select("query_id", F.col("key").alias("to"))
    lengths = parents.select(F.length("to").alias("_n")).distinct()
    small = buckets.where("size = 1 or born").where(F.length("key") > 1)
    heads = small.select(*_BUCKET, F.explode(F.sequence(F.lit(1), F.length("key") - 1)).alias("_n")).join(F.broadcast(lengths), "_n")  # no more lengths than a key has letters
    met = heads.withColumn("to", F.substr("key", F.lit(1), F.col("_n"))).join(parents, ["query_id", "to"])
    return met.groupBy(*_BUCKET).agg(F.max_by("to", "_n").alias("to"))


def _subtitles(buckets: DataFrame) -> DataFrame:
    """(query_id, key, to): smaller buckets go to the first larger one (of equal ones the later) that differs by an inserted subtitle."""
    ends = F.concat(F.substr("key", F.lit(1), F.lit(END_LEAST)), F.right("key", F.lit(END_LEAST)))
    keys = buckets.where(F.length("key") >= INNER_LEAST).select(*_BUCKET, ends.alias("ends"), F.length("key").alias("n"))
    lengths = keys.groupBy("query_id", "ends").agg(F.collect_set("n").alias("lengths"))  # no more than a key has letters
    shorter = keys.join(lengths, ["query_id", "ends"]).select(*_BUCKET, F.filter("lengths", lambda x: x < F.col("n")).alias("lengths"))
    cuts = shorter.where(F.size("lengths") > 0).mapInArrow(lambda b: _each(b, _CUTS, _cuts), "query_id long, long string, key string")
    met = cuts.join(buckets.select(*_BUCKET), _BUCKET).select("query_id", "long", "key")
    near = met.mapInArrow(lambda b: _each(b, _CUTS, _allowed), "query_id long, long string, key string")
    both = near.select("query_id", F.col("long").alias("key"), F.col("key").alias("to")).union(near.select("query_id", "key", F.col("long").alias("to")))
    order = F.struct("size", "born", "first").alias("o")
    d = both.join(buckets.select(*_BUCKET, order), _BUCKET).join(buckets.select("query_id", F.col("key").alias("to"), order.alias("p")), ["query_id", "to"])
    return d.where("p > o").groupBy(*_BUCKET).agg(F.min(F.struct("p.born", "p.first", "to")).alias("x")).select(*_BUCKET, "x.to")


def fold_candidates(items: DataFrame) -> DataFrame:
    """The items of each query with the key of their group; items without a key are left out. ``group_no`` orders the groups of
    a query: by their first record, those that no record's own key made last."""
    d = _written(items.select(*ITEM_NAMES).withColumn("key", series_key("base_title")).where("key <> ''"))
    buckets = d.groupBy(*_BUCKET).agg(F.count("*").alias("size"), F.min("ordinal").alias("first"), F.min("volume").alias("lo"), F.max("volume").alias("hi"))
    each = _written(buckets.join(_numbered(buckets), _BUCKET, "left").withColumn("_to", F.coalesce("to", "key")))
    one = each.groupBy("query_id", F.col("_to").alias("key")).agg(F.sum("size").alias("size"), F.min(F.col("to").isNotNull()).alias("born"), F.min(F.when(F.col("to").isNull(), F.col("first"))).alias("_own"), F.min("first").alias("_any")).select(*_BUCKET, "size", "born", F.coalesce("_own", "_any").alias("first"))
    singles = _ends(_singles(one))
    two = _written(_moved(one, singles))
    subtitles = _ends(_subtitles(two))

    step = lambda m, a, b: m.select("query_id", F.col("key").alias(a), F.col("to").alias(b))
    final = each.select(*_BUCKET, "number", F.col("_to").alias("k1")).join(step(singles, "k1", "k2"), ["query_id", "k1"], "left").withColumn("k2", F.coalesce("k2", "k1"))
    final = final.join(step(subtitles, "k2", "k3"), ["query_id", "k2"], "left").withColumn("group_key", F.coalesce("k3", "k2"))
    order = two.select("query_id", F.col("key").alias("group_key"), (F.col("first") + F.when(F.col("born"), F.lit(1 << 30)).otherwise(0)).cast("int").alias("group_no"))
    final = final.join(order, ["query_id", "group_key"]).select(*_BUCKET, "number", "group_key", "group_no")
    out = d.join(final, _BUCKET).withColumn("base_title", F.when(F.col("number").isNull(), F.col("base_title")).otherwise(_without("base_title", "number"))).withColumn("volume", F.coalesce("volume", "number"))
    return out.select(*(x.split(" ")[0] for x in FOLDED.split(", ")))
