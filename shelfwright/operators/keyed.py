"""Choices per key: latest, first, majority, election, pins, and values that outlive errors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key; the order should end in a unique column. Null keys are a key.

    A ranking of one row keeps only one row per key and task before the shuffle (window group limit), so hot keys are cheap.
    """
    return df.withColumn("_rn", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_rn = 1").drop("_rn")


def latest_per_key(df: DataFrame, keys: Sequence[str], at: str, tie: str) -> DataFrame:
    return first_per_key(df, keys, [F.desc_nulls_last(at), F.desc(tie)])


def top_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """At most ``n`` rows of each key: a budget per series."""
    return df.withColumn("_rn", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("_rn") <= n).drop("_rn")


def majority(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """keys, value, votes: the value most rows have; ties go to the shorter one, then to the smaller."""
    n = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("votes"))
    return first_per_key(n, keys, [F.desc("votes"), F.length(value), F.col(value)])


def elect_lowest(df: DataFrame, keys: Sequence[str], number: str, *tie: str) -> DataFrame:
    """The row with the smallest number; rows without a number come last."""
    return first_per_key(df, keys, [F.asc_nulls_last(number), *map(F.col, tie)])


def dedupe_pinned(df: DataFrame, keys: Sequence[str], pinned: str = "pinned", newest: str = "id") -> DataFrame:
    """Of each key the pinned row, else the newest."""
    return first_per_key(df, keys, [F.desc(pinned), F.desc(newest)])


def merge_pinned(old: DataFrame, new: DataFrame, keys: Sequence[str], pinned: str = "pinned") -> DataFrame:
    """old overwritten by new, except where old is pinned and new is not. Both have the same columns, one row per key."""
    rest = [c for c in old.columns if c not in keys]
    o = old.select(*keys, F.struct(*rest).alias("_old"))
    n = new.select(*keys, F.struct(*rest).alias("_new"))
    keep = F.col("_new").isNull() | (F.coalesce(F.col(f"_old.{pinned}"), F.lit(False)) & ~F.coalesce(F.col(f"_new.{pinned}"), F.lit(False)))
    d = o.join(n, list(keys), "full").withColumn("_row", F.when(keep, F.col("_old")).otherwise(F.col("_new")))
    return d.select(*keys, *(F.col(f"_row.{c}").alias(c) for c in rest))


def stale_if_error(df: DataFrame, keys: Sequence[str], ok: Column, at: str, tie: str) -> DataFrame:
    """The latest good row of each key, the latest of any kind where none is good; ``stale`` tells that a later one was not."""
    d = df.withColumn("_ok", F.coalesce(ok, F.lit(False)))
    d = d.withColumn("_latest", F.row_number().over(W.partitionBy(*keys).orderBy(F.desc_nulls_last(at), F.desc(tie))))
    d = first_per_key(d, keys, [F.desc("_ok"), F.desc_nulls_last(at), F.desc(tie)])
    return d.withColumn("stale", F.col("_latest") > 1).drop("_ok", "_latest")


def _numbered(name: Column, kind: str) -> list[Column]:
    """Of a lower-case name that ends in `` (n)`` before its ``kind`` of ending: the name without it as ``_key``, and n."""
    parts = [F.regexp_extract(name, rf"^(.*) \(([1-9][0-9]{{0,8}})\)({kind})$", k) for k in (1, 2, 3)]
    return [F.concat(parts[0], parts[2]).alias("_key"), F.nullif(parts[1], F.lit("")).cast("long").alias("_n")]


def unique_names(df: DataFrame, folder: str, stem: str, suffix: str, taken: DataFrame | None = None, tie: str = "id") -> DataFrame:
    """Adds ``name``: stem + suffix where that is free, else with the first of `` (2)``, `` (3)`` ... that is, regardless of case.

    A name is free to the first row (by ``tie``) that asks for it as it is, also if it looks numbered, unless it exists
    (``taken``: folder, name). So ``a``, ``a``, ``a (2)`` become ``a``, ``a (3)``, ``a (2)``, and no name is given twice. Rows that
    get a number are counted past the numbers that are held, in one order with them: no row waits for another.
    """
    own = W.partitionBy(folder, "_key")
    of_stem, n = _numbered(F.lower(stem), "")
    # a row for the name, and one for the number that it holds if it looks numbered, so that names are made once
    both = F.array(F.struct(F.lit(0).alias("mark"), F.lower(F.concat(stem, suffix)).alias("key"), F.lit(None).cast("long").alias("n")), F.struct(F.lit(1).alias("mark"), F.concat(of_stem, F.lower(suffix)).alias("key"), n.alias("n")))
    d = df.withColumn("_m", F.explode(F.filter(both, lambda m: (m["mark"] == 0) | (m["n"] > 1))))
    d = d.select("*", F.col("_m.mark").alias("_mark"), F.col("_m.key").alias("_key"), F.col("_m.n").alias("_n")).drop("_m").withColumn("_held", F.lit(0))
    if taken is not None:
        names = taken.select(folder, F.lower("name").alias("_name"))
        there = names.select(folder, F.col("_name").alias("_key"), F.lit(1).alias("_there")).distinct()
        d = d.join(there, [folder, "_key"], "left").withColumn("_held", F.coalesce("_there", F.lit(0))).drop("_there")
        d = d.unionByName(names.select(folder, *_numbered(F.col("_name"), r"(?:\.[^.\s()]+)*"), F.lit(1).alias("_mark")).where("_n > 1"), allowMissingColumns=True)
    # place 0 is the name itself, place k the k-th number that is not held; a held number comes before the place that it moves on
    d = d.repartition(folder, "_key")  # for all windows
    kind = W.partitionBy(folder, "_key", "_mark")
    d = d.withColumn("_row", F.row_number().over(kind.orderBy("_n", tie)).cast("long")).withColumn("_again", F.lag("_n").over(kind.orderBy("_n", tie)) == F.col("_n"))
    d = d.withColumn("_place", F.when(F.col("_mark") == 0, F.col("_row") - 1 + F.col("_held")).otherwise(F.col("_n") - F.dense_rank().over(kind.orderBy("_n"))))
    d = d.where((F.col("_mark") == 0) | ~F.coalesce("_again", F.lit(False)))
    passed = F.sum("_mark").over(own.orderBy("_place", F.desc("_mark")).rowsBetween(W.unboundedPreceding, 0))
    d = d.withColumn("_number", F.col("_place") + 1 + passed).where("_mark = 0")
    name = F.when(F.col("_place") == 0, F.concat(stem, suffix)).otherwise(F.concat(F.col(stem), F.lit(" ("), F.col("_number"), F.lit(")"), F.col(suffix)))
    return d.withColumn("name", name).drop("_key", "_held", "_place", "_mark", "_number", "_n", "_row", "_again")
