"""Semi, anti, range and prefix joins. Each has an equality to hash on; none is a nested loop."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def in_some_range(df: DataFrame, ranges: DataFrame, keys: Sequence[str], value: str, lo: str, hi: str) -> DataFrame:
    """Rows of df whose value lies in a range with the same keys (a range semi join, the residual beside the equality)."""
    r = ranges.select(*(F.col(k).alias(f"_{k}") for k in keys), F.col(lo).alias("_lo"), F.col(hi).alias("_hi"))
    on = F.col(value).between(F.col("_lo"), F.col("_hi"))
    for k in keys:
        on = on & (F.col(k) == F.col(f"_{k}"))
    return df.join(r, on, "left_semi")


def without(df: DataFrame, other: DataFrame, on: Sequence[str]) -> DataFrame:
    return df.join(other.select(*on).distinct(), list(on), "left_anti")


def having(df: DataFrame, other: DataFrame, on: Sequence[str]) -> DataFrame:
    return df.join(other.select(*on).distinct(), list(on), "left_semi")


def _beginnings(long: DataFrame, short: DataFrame, a: str, b: str, least: int) -> DataFrame:
    """Pairs in which the key b of ``short`` begins the key a of ``long``: equal to a itself or to one of its beginnings.

    A key goes to one row for each of its beginnings whose length some key of the other side has, so what meets is hashed on
    whole keys and no row is compared with one that does not match.
    """
    lengths = short.select(F.length(b).alias("_n")).distinct()
    heads = long.withColumn("_n", F.explode(F.sequence(F.lit(least), F.length(a)))).join(lengths, "_n", "left_semi")
    heads = heads.withColumn("_head", F.substr(F.col(a), F.lit(1), F.col("_n"))).drop("_n")
    return heads.join(short, F.col("_head") == F.col(b)).drop("_head")


def prefix_pairs(left: DataFrame, right: DataFrame, a: str, b: str, least: int) -> DataFrame:
    """Pairs of rows one of whose keys begins with the other, both at least ``least`` (1 at least) long."""
    left, right = left.where(F.length(a) >= least), right.where(F.length(b) >= least)
    longer = _beginnings(right, left, b, a, least).where(F.length(b) > F.length(a))
    return _beginnings(left, right, a, b, least).unionByName(longer)


def match_by_prefix(left: DataFrame, right: DataFrame, id_: str, a: str, b: str, ordinal: str, least: int = 8, exact: int = 4) -> DataFrame:
    """For each row of left the row of right with an equal key (``exact`` long at least), else the first one whose key is a prefix either way.

    ``ordinal`` orders right; equal keys count as one, the first.
    """
    r = right.where(F.length(b) >= exact)
    r = r.withColumn("_rn", F.row_number().over(W.partitionBy(b).orderBy(ordinal))).where("_rn = 1").drop("_rn")
    same = left.join(r, (F.col(a) == F.col(b)) & (F.length(a) >= exact))
    rest = left.join(same.select(id_), id_, "left_anti")
    near = prefix_pairs(rest, right, a, b, least)
    near = near.withColumn("_rn", F.row_number().over(W.partitionBy(id_).orderBy(ordinal))).where("_rn = 1").drop("_rn")
    return same.unionByName(near)


def keys_compatible(a: Column, b: Column) -> Column:
    """Whether some key of array a and some key of array b are prefixes of one another."""
    return F.exists(a, lambda x: F.exists(b, lambda y: (x != "") & (y != "") & (F.startswith(x, y) | F.startswith(y, x))))


def folded_author(c: Column) -> Column:
    """The author without white space and case; empty if there is none."""
    return F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[\\s　]+", "")


def authors_compatible(a: Column, b: Column) -> Column:
    """Equal or contained either way once white space is gone and case is folded; an empty side passes."""
    x, y = folded_author(a), folded_author(b)
    return (x == "") | (y == "") | F.contains(x, y) | F.contains(y, x)


def union_sources(parts: dict[str, DataFrame], tag: str = "provider") -> DataFrame:
    """All rows of all sources with the source's name; sources without a column have null there."""
    out = None
    for name, df in parts.items():
        d = df.withColumn(tag, F.lit(name))
        out = d if out is None else out.unionByName(d, allowMissingColumns=True)
    return out
