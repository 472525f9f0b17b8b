"""Grouped figures, ordered texts, searches, pages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def counts_of(parts: dict[str, DataFrame]) -> DataFrame:
    """(name, n): the rows of each table, one aggregate per table."""
    out = None
    for name, df in parts.items():
        one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
        out = one if out is None else out.union(one)
    return out


def conditional_sums(df: DataFrame, keys: Sequence[str], value: Column, cases: dict[str, Column]) -> DataFrame:
    """One pass: per key the sum of value where each condition holds (0 where none does)."""
    zero = F.lit(0)
    return df.groupBy(*keys).agg(*(F.sum(F.when(c, value).otherwise(zero)).alias(n) for n, c in cases.items()))


def joined_text(df: DataFrame, keys: Sequence[str], order: Sequence[str], text: str, sep: str = " / ") -> DataFrame:
    """keys, text: a key's texts joined in the order of the columns ``order``."""
    each = F.array_sort(F.collect_list(F.struct(*order, F.col(text).alias("_t"))))
    return df.groupBy(*keys).agg(F.array_join(F.transform(each, lambda x: x["_t"]), sep).alias("text"))


def collisions(df: DataFrame, key: str, value: str) -> DataFrame:
    """key, n: the keys that more than one distinct value has."""
    return df.groupBy(key).agg(F.count_distinct(value).alias("n")).where("n > 1")


def upper_median(values: Column) -> Column:
    """The element at n div 2 of the sorted values."""
    return F.element_at(F.sort_array(values), (F.floor(F.size(values) / 2) + 1).cast("int"))


def spread(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """keys, median, largest: exact, by sorting in the aggregate."""
    return df.groupBy(*keys).agg(F.percentile(value, F.lit(0.5)).alias("median"), F.max(value).alias("largest"))


def search(df: DataFrame, columns: Sequence[str], q: str, key: str | None = None, key_q: str | None = None) -> DataFrame:
    """Rows one of whose columns contains q regardless of case, or whose key contains the normalised q. % and _ are plain characters."""
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.contains(F.lower(c), F.lit(q.lower()))
    if key is not None and key_q:
        hit = hit | F.contains(F.col(key), F.lit(key_q))
    return df.where(F.coalesce(hit, F.lit(False)))


def page(df: DataFrame, order: Sequence[Column], limit: int | str = 60, offset: int = 0, most: int = 500) -> DataFrame:
    """A page in a total order; ``'all'`` is unbounded. Filters belong before it."""
    d = df.orderBy(*order)
    if offset > 0:
        d = d.offset(offset)
    return d if limit == "all" else d.limit(max(1, min(int(limit), most)))


def _literal(df: DataFrame, column: str, value: object) -> Column:
    """A value as ``collect`` gave it, in the type of its column."""
    kind = df.schema[column].dataType
    return F.lit(str(value)).cast(kind) if kind.typeName() == "timestamp_ntz" else F.lit(value).cast(kind)


def _beyond(column: str, down: bool, value: Column | None) -> Column | None:
    """Rows that come after a value in the order of one column: ascending with nulls first, descending with nulls last."""
    c = F.col(column)
    if value is None:
        return None if down else c.isNotNull()
    return (c < value) | c.isNull() if down else c > value


def page_after(df: DataFrame, order: Sequence[tuple[str, bool]], last: Sequence | None = None, limit: int = 60, most: int = 500) -> DataFrame:
    """The page that follows the row whose values of the order's columns are ``last`` (none: the first page).

    ``order`` names columns, each with whether it descends; the last one must be unique. The place is a condition on the columns,
    which goes to the scan, and the page the first rows of what is left: the thousandth costs what the first does, and rows that
    come or go before it shift nothing.
    """
    if last is not None:
        at = [None if v is None else _literal(df, c, v) for (c, _), v in zip(order, last, strict=True)]
        after, same = F.lit(False), F.lit(True)
        for (column, down), value in zip(order, at):
            if (more := _beyond(column, down, value)) is not None:
                after = after | (same & more)
            same = same & (F.col(column).isNull() if value is None else F.col(column) == value)
        first, down = order[0]
        if at[0] is not None:  # said once more for the first column alone, as scans prune by conditions on one column
            df = df.where((F.col(first) <= at[0]) | F.col(first).isNull() if down else F.col(first) >= at[0])
        df = df.where(after)
    return df.orderBy(*(F.desc_nulls_last(c) if down else F.asc_nulls_first(c) for c, down in order)).limit(max(1, min(limit, most)))


def place_of(page: DataFrame, order: Sequence[tuple[str, bool]]) -> tuple | None:
    """What ``page_after`` needs to go on behind a page; none if it is empty. At most a page reaches the driver."""
    rows = page.select(*(c for c, _ in order)).collect()
    return tuple(rows[-1]) if rows else None


#: Size of the KLL sketches, and the error of the ranks they answer, twice what it is in 99 of 100 cases.
SKETCH_K, SKETCH_ERROR = 800, 0.01


def sketches(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """keys, sketch, n: a mergeable quantile sketch of a number for each key, some kilobytes however many rows it stands for.

    Each task makes its own and they are merged, so no key holds its values. Sketches can be kept, by day or source, and put
    together by ``merge_sketches``. Null and NaN count for nothing.
    """
    v = F.col(value).cast("double")
    return df.where(v.isNotNull() & ~F.isnan(v)).groupBy(*keys).agg(F.kll_sketch_agg_double(v, F.lit(SKETCH_K)).alias("sketch"), F.count("*").alias("n"))


def merge_sketches(kept: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, sketch, n of tables of sketches with finer keys."""
    return kept.groupBy(*keys).agg(F.kll_merge_agg_double("sketch", F.lit(SKETCH_K)).alias("sketch"), F.sum("n").alias("n"))


def quantile(sketch: Column | str, share: float) -> Column:
    """The value below which about ``share`` of the values lie: its rank is within ``SKETCH_ERROR`` of it."""
    return F.kll_sketch_get_quantile_double(sketch, F.lit(share))


def sample(df: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """n rows that look random, the same in every run: those with the smallest hashes of seed and key."""
    return df.orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"))), key).limit(n)


def natural_order(text: Column, language: str = "ja") -> list[Column]:
    """Order of names as people read them: digit runs as numbers, letters by the language regardless of case and marks, the spelling itself last."""
    return [F.collate(natural_key(text), f"{language}_CI_AI"), text]


def natural_key(text: Column) -> Column:
    """A key that sorts digit runs as numbers: 2 before 010."""
    runs = F.regexp_extract_all(text, F.lit(r"([0-9]+|[^0-9]+)"))
    return F.array_join(F.transform(runs, lambda x: F.when(x.rlike("^[0-9]"), F.lpad(x, F.greatest(F.lit(12), F.length(x)), F.lit("0"))).otherwise(F.lower(x))), "")
