"""Entity resolution of bibliographic records: buckets by title key, folded into series, summarised and ranked.

``folding.fold_candidates`` folds tables of records, whatever a query's size. ``fold`` does the same to the records of one
query in their order, for the table function ``group_candidates``: a query's records there are what providers return at
once, some hundred at most.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, replace

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn, SelectedColumn

from ..functions.registry import ndl_volume, split_title
from ..functions.scalars import date_key, year_of
from ..functions.schema import ddl
from ..functions.titles import strip_volume_digits, tidy_author
from ..functions.volumes import series_key
from .keyed import first_per_key

#: Which provider is believed first.
RANK = {"ndl": 0, "rakuten": 1, "google": 2}
#: Words that name another book, so that a title with one is no spelling of one without.
OTHER_BOOK = re.compile(
    "完全版|新装版|分冊版|文庫版|愛蔵版|豪華版|特装版|限定版|合本版|新版|旧版|改訂版|増補版|復刻版|カラー版|モノクロ版|電子版|廉価版|総集編|短編集|外伝|番外編|アンソロジー|画集|資料集|newedition|completeedition|deluxe"
)
INNER_LEAST, END_LEAST, DIGITS_MOST = 6, 2, 3

ITEM = "query_id long, ordinal int, provider string, title string, base_title string, volume int, author string, publisher string, date string, year int, isbn string, image_url string, link string"
FOLDED = ITEM + ", group_key string, group_no int"
ITEM_NAMES = [x.split(" ")[0] for x in ITEM.split(", ")]


def normalise(records: DataFrame) -> DataFrame:
    """Adds base_title, volume (a volume field wins over the title's) and year to provider records."""
    d = records.withColumn("_t", split_title("title"))
    own = F.col("volume") if "volume" in records.columns else F.lit(None).cast("int")
    if "volume_raw" in records.columns:
        own = F.coalesce(own, F.when(F.col("provider") == "ndl", ndl_volume("volume_raw", F.lit(""))))
    base = F.coalesce(F.nullif(F.col("_t.base"), F.lit("")), F.col("title"))
    return d.withColumn("base_title", base).withColumn("volume", F.coalesce(own, F.col("_t.volume"))).withColumn("year", year_of(F.col("date"))).drop("_t")


@dataclass(frozen=True)
class Record:
    ordinal: int
    title: str
    volume: int | None


class Buckets(dict):
    """Key to records, in the order keys came up; folding moves whole buckets."""

    def move(self, key: str, to: str, records: Iterable[Record] | None = None) -> None:
        own = self.pop(key)
        self.setdefault(to, []).extend(own if records is None else records)

    def size(self, key: str) -> int:
        return len(self.get(key, ()))


def runs_in(key: str) -> list[tuple[int, str]]:
    """Numbers in a key that may be volumes, each with the key without it: not at the start, short, not zero."""
    out = []
    for m in re.finditer("[0-9]+", key):
        if m.start() and len(m[0]) <= DIGITS_MOST and int(m[0]):
            out.append((int(m[0]), key[: m.start()] + key[m.end() :]))
    return out


def fold_numbers(b: Buckets) -> set[str]:
    """Keys that differ by a number alone are one line of volumes. Buckets with volumes of their own stay. Returns new keys."""
    runs = {k: [r for r in runs_in(k) if all(x.volume in (None, r[0]) for x in own)] for k, own in b.items()}
    family: dict[str, int] = {}
    for own in runs.values():
        for bone in {bone for _, bone in own}:
            family[bone] = family.get(bone, 0) + 1
    born = set()
    for key, own in runs.items():
        grown = [r for r in own if r[1] != key and b.size(r[1]) >= 2]
        kin = [r for r in own if family[r[1]] >= 2]
        if key in b and (chosen := (grown or kin)[:1]):
            number, bone = chosen[0]
            if bone not in b or bone == key:
                born.add(bone)
            b.move(key, bone, [replace(x, volume=number if x.volume is None else x.volume, title=strip_volume_digits(x.title, number)) for x in b[key]])
    return born


def fold_singles(b: Buckets, born: set[str]) -> None:
    """A single record whose key begins with a larger bucket's is that bucket's: a volume's own subtitle."""
    parents = sorted((k for k, own in b.items() if len(own) > 1), key=len, reverse=True)
    for key in list(b):
        if b.size(key) == 1 or key in born and key in b:
            parent = next((p for p in parents if p != key and key.startswith(p) and p in b), None)
            if parent is not None:
                b.move(key, parent)


def inner_cut(short: str, long: str) -> str | None:
    """What stands in the middle of ``long`` if ``short`` is the rest of it, with something left at both ends."""
    if not INNER_LEAST <= len(short) < len(long):
        return None
    head = next((i for i, (x, y) in enumerate(zip(short, long)) if x != y), len(short))
    back = list(zip(reversed(short), reversed(long)))[: len(short) - head]
    tail = next((i for i, (x, y) in enumerate(back) if x != y), len(back))
    if min(head, tail) < END_LEAST or head + tail != len(short):
        return None
    return long[head : len(long) - tail]


def fold_subtitles(b: Buckets) -> None:
    """Small buckets first, into the first larger one that differs by an inserted subtitle, unless that names another book."""
    for key in sorted(b, key=b.size):
        if key not in b:
            continue
        for p in b:
            if p != key and b.size(p) >= b.size(key):
                cut = inner_cut(p, key) or inner_cut(key, p)
                if cut and not OTHER_BOOK.search(cut):
                    b.move(key, p)
                    break


def fold(records: list[Record]) -> Buckets:
    b = Buckets()
    for r in records:
        if key := series_key(r.title):
            b.setdefault(key, []).append(r)
    born = fold_numbers(b)
    fold_singles(b, born)
    fold_subtitles(b)
    return b


def _rank() -> F.Column:
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in RANK.items() for x in kv)), F.col("provider")), F.lit(len(RANK)))


@F.pandas_udf(ddl("string"))
def _tidy(s: pd.Series) -> pd.Series:
    return s.map(tidy_author, na_action=None)


def _majority(values: str) -> F.Column:
    """Of an array: the commonest text, ties to the shorter, then to the one that came first."""
    own = F.filter(F.transform(F.col(values), F.trim), lambda x: x.isNotNull() & (x != ""))
    votes = F.transform(F.array_distinct(own), lambda x: F.struct(F.negative(F.size(F.filter(own, lambda y: y == x))).alias("n"), F.length(x).alias("l"), F.array_position(own, x).alias("at"), x.alias("v")))
    return F.array_min(votes)["v"]


def groups(folded: DataFrame) -> DataFrame:
    """One row per group: providers by rank, title and author by majority, volumes, years, first publisher and cover, items.

    Items stand by volume (unknown last), then date, then provider. Groups with more volumes come first; ``place`` says where.
    """
    order = F.struct(F.col("volume").isNull().alias("a"), F.col("volume").alias("b"), date_key(F.col("date")).alias("c"), _rank().alias("d"), F.col("ordinal").alias("e"))
    item = F.struct(order.alias("o"), F.struct("provider", "title", "base_title", "volume", "author", "publisher", "date", "year", "isbn", "image_url", "link", _rank().alias("rank")).alias("i"))
    d = folded.groupBy("query_id", "group_key", "group_no").agg(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["i"]).alias("items"))
    first = lambda c: F.get(F.filter(F.transform("items", lambda x: x[c]), lambda x: x.isNotNull() & (x != "")), F.lit(0))
    own = lambda c: F.filter(F.transform("items", lambda x: x[c]), lambda x: x.isNotNull())
    d = d.withColumn("_titles", F.transform("items", lambda x: x["base_title"])).withColumn("_authors", F.transform("items", lambda x: x["author"]))
    d = d.select(
        "query_id",
        "group_key",
        F.transform(F.array_sort(F.array_distinct(F.transform("items", lambda x: F.struct(x["rank"], x["provider"])))), lambda x: x["provider"]).alias("providers"),
        _majority("_titles").alias("title"),
        _majority("_authors").alias("author"),
        F.size("items").alias("n_items"),
        F.array_sort(F.array_distinct(own("volume"))).alias("volumes"),
        F.array_min(own("year")).alias("first_year"),
        F.array_max(own("year")).alias("last_year"),
        first("publisher").alias("publisher"),
        first("image_url").alias("cover_url"),
        "items",
        "group_no",
    )
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.size("volumes")), F.desc("n_items"), "group_no"))
    return d.withColumn("author_name", _tidy("author")).withColumn("place", place).orderBy("query_id", "place").drop("group_no")


def volume_map(groups_: DataFrame) -> DataFrame:
    """One row per (query_id, group_key, volume): the item that stands for it, the oldest edition."""
    each = groups_.select("query_id", "group_key", F.posexplode("items").alias("at", "item")).where("item.volume is not null")
    return first_per_key(each.withColumn("volume", F.col("item.volume")), ["query_id", "group_key", "volume"], [F.col("at")]).drop("at")


def image_candidates(groups_: DataFrame, volume: int | None = None) -> DataFrame:
    """All items with an image, of one volume or of all, in the order to try them."""
    each = groups_.select("query_id", "group_key", F.posexplode("items").alias("at", "item")).where("item.image_url is not null")
    return each if volume is None else each.where(F.col("item.volume") == volume)


class GroupCandidates:
    """``group_candidates(TABLE(items))`` in SQL: the rows of ``fold_candidates``, for a table with the columns of ITEM."""

    @staticmethod
    def analyze(items: AnalyzeArgument) -> AnalyzeResult:
        if not items.isTable:
            raise ValueError("group_candidates takes a table: group_candidates(TABLE(items))")
        have = {f.name.lower() for f in items.dataType.fields}
        if missing := [n for n in ITEM_NAMES if n not in have]:
            raise ValueError(f"group_candidates needs the columns {', '.join(missing)}")
        return AnalyzeResult(ddl(FOLDED), partitionBy=[PartitioningColumn("query_id")], orderBy=[OrderingColumn("ordinal")], select=[SelectedColumn(n) for n in ITEM_NAMES])

    def __init__(self):
        self.rows: list[tuple] = []

    def eval(self, row: Row) -> None:
        self.rows.append(tuple(row[n] for n in ITEM_NAMES))

    def terminate(self) -> Iterator[tuple]:
        title, volume = ITEM_NAMES.index("base_title"), ITEM_NAMES.index("volume")
        records = [Record(i, r[title] or "", r[volume]) for i, r in enumerate(self.rows)]
        for number, (key, own) in enumerate(fold(records).items()):
            for x in own:
                row = list(self.rows[x.ordinal])
                row[title], row[volume] = x.title, x.volume
                yield (*row, key, number)


def register(spark: SparkSession) -> None:
    spark.udtf.register("group_candidates", F.udtf(GroupCandidates))
