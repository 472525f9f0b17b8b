"""Ranges on number lines: holdings, gaps, coverage, what is published beyond what is owned.

Ranges stay ranges: their union, differences and depth come from sorted beginnings and ends, and numbers are written out only
where they are the answer.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VOLUME, CHAPTER = "巻", "話"
#: The widest range that counts as one (fixed value).
MAX_SPAN = 300


_RANGES = "array<struct<lo:bigint,hi:bigint>>"


def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is computed once, however often it is used."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def span(lo: Column | str, hi: Column | str) -> Column:
    """A range as a struct; null unless lo <= hi."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (lo, hi))
    return F.when(a <= b, F.struct(a.cast("long").alias("lo"), b.cast("long").alias("hi")))


def _between(ends: Column, begins: Column) -> Column:
    """The ranges that lie between each end and the beginning beside it."""
    return F.filter(F.zip_with(ends, begins, lambda e, b: F.struct((e + 1).alias("lo"), (b - 1).alias("hi"))), lambda r: r["lo"] <= r["hi"])


def _islands(lo: Column, hi: Column) -> Column:
    """The union of n ranges whose sorted beginnings and sorted ends these are. After the k-th end there is a gap exactly where
    the next beginning lies beyond it: then k ranges have begun and all of them are over."""
    n = F.size(lo)

    def cut(gaps: Column) -> Column:
        begins = F.concat(F.slice(lo, 1, 1), F.transform(gaps, lambda g: g["hi"] + 1))
        ends = F.concat(F.transform(gaps, lambda g: g["lo"] - 1), F.slice(hi, n, 1))
        return F.zip_with(begins, ends, lambda b, e: F.struct(b.alias("lo"), e.alias("hi")))

    return F.when(n > 0, _let(_between(F.slice(hi, 1, n - 1), F.slice(lo, 2, n - 1)), cut)).otherwise(F.array().cast(_RANGES))


def _ends(ranges: Column) -> Column:
    """Beginnings and ends of ranges, each sorted."""
    return F.struct(F.array_sort(F.transform(ranges, lambda r: r["lo"])).alias("lo"), F.array_sort(F.transform(ranges, lambda r: r["hi"])).alias("hi"))


def islands(ranges: Column) -> Column:
    """As few disjoint ranges, in order, as hold the numbers of an array of ranges; neighbours are one."""
    return _let(_ends(ranges), lambda x: _islands(x["lo"], x["hi"]))


def islands_twice(ranges: Column) -> Column:
    """The numbers that two ranges of the array have at least: between the next beginning and an end that comes after it."""

    def twice(x: Column) -> Column:
        n = F.greatest(F.size(x["lo"]) - 1, F.lit(0))
        both = F.filter(F.zip_with(F.slice(x["lo"], 2, n), F.slice(x["hi"], 1, n), lambda b, e: F.struct(b.alias("lo"), e.alias("hi"))), lambda r: r["lo"] <= r["hi"])
        return islands(both)

    return _let(_ends(ranges), twice)


def gaps_in(held: Column) -> Column:
    """The ranges from 1 to the largest number that islands leave."""
    n = F.greatest(F.size(held) - 1, F.lit(0))
    ends = F.concat(F.array(F.lit(0).cast("long")), F.transform(F.slice(held, 1, n), lambda r: F.greatest(r["hi"], F.lit(0).cast("long"))))
    return _between(ends, F.transform(held, lambda r: r["lo"]))


def minus(lo: Column, hi: Column, held: Column) -> Column:
    """What islands leave of the range lo..hi, as ranges."""

    def rest(x: Column) -> Column:
        ends = F.concat(F.array(lo.cast("long") - 1), F.transform(x, lambda r: r["hi"]))
        begins = F.concat(F.transform(x, lambda r: r["lo"]), F.array(hi.cast("long") + 1))
        inside = F.zip_with(ends, begins, lambda e, b: F.struct(F.greatest(e + 1, lo.cast("long")).alias("lo"), F.least(b - 1, hi.cast("long")).alias("hi")))
        return F.filter(inside, lambda r: r["lo"] <= r["hi"])

    return _let(F.coalesce(held, F.array().cast(_RANGES)), rest)


def numbers_in(ranges: Column) -> Column:
    """The numbers of disjoint ranges, in their order."""
    return F.flatten(F.transform(ranges, lambda r: F.sequence(r["lo"], r["hi"])))


def explode_ranges(df: DataFrame, keys: Sequence[str], lo: str, hi: str, number: str = "number") -> DataFrame:
    """One row per distinct (keys, number) of the ranges lo..hi; reversed and null ranges give none."""
    return spans(df, keys, lo, hi).select(*keys, F.explode(numbers_in(F.col("spans"))).alias(number))


def spans(df: DataFrame, keys: Sequence[str], lo: str, hi: str) -> DataFrame:
    """keys, spans: the islands that the ranges lo..hi of a key make. Each key is a number line of its own.

    The distinct ranges of a key are one array: a series' volumes, never its rows nor its numbers, so a key with very many
    files stays small (sets are merged in each task first). One shuffle, on the keys.
    """
    d = df.where(F.col(lo) <= F.col(hi)).groupBy(*keys).agg(F.collect_set(span(lo, hi)).alias("_r"))
    return d.select(*keys, islands(F.col("_r")).alias("spans"))


def _line(held: Column) -> list[Column]:
    return [numbers_in(held).alias("owned"), numbers_in(gaps_in(held)).alias("missing"), F.element_at(held, -1)["hi"].alias("max")]


def holdings(df: DataFrame, keys: Sequence[str], lo: str, hi: str) -> DataFrame:
    """keys, owned (ascending), missing (1..max without owned), max."""
    return spans(df, keys, lo, hi).select(*keys, *_line(F.col("spans")))


def gaps(df: DataFrame, keys: Sequence[str], lo: str, hi: str) -> DataFrame:
    """keys, missing: one row per number that is missing below the largest."""
    return holdings(df, keys, lo, hi).select(*keys, F.explode("missing").alias("missing"))


def by_unit(ranges: Column) -> Column:
    """Array of (unit, owned, missing, max) of an array of (unit, span), the volume line first."""
    units = F.array_sort(F.array_distinct(F.transform(ranges, lambda x: F.struct((x["unit"] != VOLUME).alias("o"), x["unit"].alias("u")))))

    def line(u: Column) -> Column:
        own = F.transform(F.filter(ranges, lambda x: x["unit"] == u["u"]), lambda x: x["span"])
        return _let(islands(own), lambda held: F.struct(u["u"].alias("unit"), *_line(held)))

    return F.transform(units, line)


def volumes_by_series(volumes: DataFrame) -> DataFrame:
    """series_id, holdings, volume_ids, added (the last first_seen_at) of the present volumes, in one aggregate."""
    own = span("volume_from", "volume_to")
    one = F.when(own.isNotNull(), F.struct("unit", own.alias("span")))
    d = volumes.where("present").groupBy("series_id").agg(F.collect_set(one).alias("_n"), F.collect_set("id").alias("volume_ids"), F.max("first_seen_at").alias("added"))
    return d.select("series_id", by_unit(F.col("_n")).alias("holdings"), "volume_ids", "added")


def holdings_by_series(volumes: DataFrame) -> DataFrame:
    """series_id, holdings: array of (unit, owned, missing, max) of the present volumes, the volume line first."""
    return volumes_by_series(volumes).where(F.size("holdings") > 0).select("series_id", "holdings")


def published(known: DataFrame, owned: DataFrame, keys: Sequence[str], number: str, owned_number: str, also: Sequence[Column] = ()) -> DataFrame:
    """keys, known, published_max, missing, ahead, owned_max of every key of ``known``, and further aggregates of its rows.

    A known number that is not owned is missing; one beyond the largest owned is ahead. What is not known is not
    published as far as anyone can tell: published_max is a lower bound.
    """
    k = known.where(F.col(number).isNotNull()).groupBy(*keys).agg(F.array_sort(F.collect_set(F.col(number).cast("long"))).alias("known"), *also)
    more = [c for c in k.columns if c not in keys and c != "known"]
    o = owned.groupBy(*keys).agg(F.collect_set(F.col(owned_number).cast("long")).alias("_owned"), F.max(F.col(owned_number).cast("long")).alias("owned_max"))
    d = k.join(o, list(keys), "left")
    none = F.array().cast("array<bigint>")
    d = d.withColumn("owned_max", F.coalesce("owned_max", F.lit(0).cast("long")))
    return d.select(
        *keys,
        "known",
        F.array_max("known").alias("published_max"),
        F.array_except("known", F.coalesce("_owned", none)).alias("missing"),
        F.filter("known", lambda v: v > F.col("owned_max")).alias("ahead"),
        "owned_max",
        *more,
    )


def uncovered_ranges(ranges: DataFrame, cover: DataFrame, keys: Sequence[str], lo: str, hi: str, cover_lo: str, cover_hi: str) -> DataFrame:
    """The rows of ``ranges`` with ``uncovered``: what the ranges of ``cover`` with the same keys leave of lo..hi, as ranges."""
    held = spans(cover, keys, cover_lo, cover_hi).withColumnRenamed("spans", "_held")
    return ranges.where(F.col(lo) <= F.col(hi)).join(held, list(keys), "left").withColumn("uncovered", minus(F.col(lo), F.col(hi), F.col("_held"))).drop("_held")


def uncovered(ranges: DataFrame, cover: DataFrame, keys: Sequence[str], lo: str, hi: str, number: str) -> DataFrame:
    """The numbers of the ranges that no row of ``cover`` (keys, number) has, each once."""
    want = spans(ranges, keys, lo, hi)
    held = spans(cover, keys, number, number).withColumnRenamed("spans", "_held")
    left = F.flatten(F.transform("spans", lambda r: minus(r["lo"], r["hi"], F.col("_held"))))
    return want.join(held, list(keys), "left").select(*keys, F.explode(numbers_in(left)).alias("number"))


def covered_ranges(ranges: DataFrame, id_: str, keys: Sequence[str], lo: str, hi: str) -> DataFrame:
    """The ranges all of whose numbers other rows with the same keys have: they lie within what two ranges cover.

    Rows with one range count twice at most, so that no key holds more than its distinct ranges.
    """
    ok = ranges.where(F.col(lo) <= F.col(hi))
    few = ok.groupBy(*keys, span(lo, hi).alias("_r")).agg(F.count("*").alias("_rows"))
    twice = few.groupBy(*keys).agg(F.flatten(F.collect_list(F.when(F.col("_rows") > 1, F.array("_r", "_r")).otherwise(F.array("_r")))).alias("_all"))
    held = twice.select(*keys, islands_twice(F.col("_all")).alias("_held"))
    return ok.join(held, list(keys)).where(F.exists("_held", lambda r: (r["lo"] <= F.col(lo)) & (F.col(hi) <= r["hi"]))).select(*ranges.columns)


def exact_cover(numbers: Column, lo: Column, hi: Column) -> Column:
    """Whether the numbers are lo..hi exactly, without repeats: as many as the range has, all different, its ends the least and the largest."""
    n = F.size(numbers)
    return (lo <= hi) & (n == hi - lo + 1) & (F.size(F.array_distinct(numbers)) == n) & (F.array_min(numbers) == lo) & (F.array_max(numbers) == hi)


def missing_of_request(want_lo: Column, want_hi: Column, held: Column) -> Column:
    """The requested numbers that islands do not hold, ascending; null without a readable request."""
    return F.when(want_lo.isNotNull() & (want_lo <= want_hi), numbers_in(minus(want_lo, want_hi, held)))
