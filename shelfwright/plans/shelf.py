"""What a user asks of the shelf: the list, one series, what is missing, what is owned. One plan each, no query per row."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.registry import parse_item
from ..functions.scalars import series_label, year_of
from ..functions.volumes import series_key
from ..operators import covers as C
from ..operators import issues, numbers, shelf, summaries


@dataclass
class Tables:
    """The catalogue's tables."""

    series: DataFrame
    volumes: DataFrame
    files: DataFrame
    bib: DataFrame
    covers: DataFrame


@dataclass
class Options:
    q: str | None = None
    root_id: str | None = None
    completed: bool | None = None
    needs_cover: bool = False
    issues: str | None = None  # any, dup or loose
    care: bool = False
    gaps: bool = False
    behind: bool = False
    missing: bool = False
    sort: str = "title"
    limit: int | str = 60
    offset: int = 0


def published(bib: DataFrame) -> DataFrame:
    """series_id, known, published_max, providers, latest_date: what the bibliography of each series knows, in one aggregate."""
    k = bib.where(F.col("volume_no").isNotNull())
    dated = F.when(F.col("pubdate") != "", F.struct(F.col("volume_no").cast("long").alias("volume_no"), "provider", "pubdate"))
    d = k.groupBy("series_id").agg(F.array_sort(F.collect_set(F.col("volume_no").cast("long"))).alias("known"), F.array_sort(F.collect_set("provider")).alias("providers"), F.max(dated).alias("_d"))
    d = d.withColumn("published_max", F.array_max("known"))
    return d.withColumn("latest_date", F.when(F.col("_d.volume_no") == F.col("published_max"), F.col("_d.pubdate"))).drop("_d")


def selected(t: Tables, o: Options) -> Tables:
    """The tables cut down to the series that the conditions on series alone leave, so that the rest is never aggregated."""
    s = t.series.where("present")
    if o.root_id is not None:
        s = s.where(F.col("root_id") == o.root_id)
    if o.completed is not None:
        s = s.where(shelf.effective_completion(F.col("completed_user"), F.col("completed")) == o.completed)
    if o.q:
        s = summaries.search(s, ["title", "author"], o.q, "series_key", series_key(o.q))
    if o.needs_cover:
        s = s.join(t.covers.where("slot = ''").select(F.col("series_id").alias("id")), "id", "left_anti")
    if o.root_id is None and o.completed is None and not o.q and not o.needs_cover:
        return Tables(s, t.volumes, t.files, t.bib, t.covers)
    ids = s.select(F.col("id").alias("series_id"))
    return Tables(s, *(x.join(ids, "series_id", "left_semi") for x in (t.volumes, t.files, t.bib, t.covers)))


def with_missing(d: DataFrame) -> DataFrame:
    """Adds owned_max, missing and ahead (of the volume line), and has_gap (of any), to what is known and held of each series."""
    none = F.array().cast("array<bigint>")
    line = F.get(F.filter("holdings", lambda h: h["unit"] == numbers.VOLUME), F.lit(0))
    d = d.withColumn("owned_max", F.coalesce(line["max"], F.lit(0).cast("long")))
    d = d.withColumn("missing", F.coalesce(F.array_except("known", F.coalesce(line["owned"], none)), none))
    d = d.withColumn("ahead", F.coalesce(F.filter("known", lambda n: n > F.col("owned_max")), none))
    d = d.withColumn("holdings", F.when(F.size("holdings") > 0, F.col("holdings")))
    return d.withColumn("has_gap", F.coalesce(F.exists("holdings", lambda h: F.size(h["missing"]) > 0), F.lit(False)))


def summaries_of(t: Tables) -> DataFrame:
    """Every present series with counts, holdings, gaps, issues, shelf status and cover: each table aggregated once, then joined on series_id."""
    v = numbers.volumes_by_series(t.volumes).withColumnRenamed("added", "_added")
    d = t.series.where("present").withColumnRenamed("id", "series_id")
    for part in (issues.by_series(issues.files_by_volume(t.files)), v, published(t.bib), C.elect(t.covers).select("series_id", F.col("file").alias("cover"))):
        d = d.join(part, "series_id", "left")
    d = issues.with_duplicates(d).na.fill(0, ["file_count", "bytes", "loose_files", "care_files"])
    d = d.withColumn("unreadable_files", F.col("loose_files")).withColumn("any_issue", issues.any_issue())
    d = d.withColumn("effective_completed", shelf.effective_completion(F.col("completed_user"), F.col("completed")))
    d = d.withColumn("completed_by", shelf.completed_by(F.col("completed_user"), F.col("completed")))
    d = with_missing(d)
    d = d.withColumn("latest_year", year_of(F.col("latest_date")))
    d = d.withColumn("status", shelf.shelf_status(F.col("completed_by").isNotNull(), F.col("enriched_at").isNull(), F.col("published_max"), F.size("ahead")))
    d = d.withColumn("status_label", shelf.shelf_label(F.col("status"), F.col("owned_max"), F.col("published_max"), F.size("missing"), F.col("latest_year")))
    return d.withColumn("label", series_label(F.col("author"), F.col("title"))).withColumn("volume_added_at", F.coalesce("_added", "first_seen_at")).drop("_added")


def filtered(d: DataFrame, o: Options) -> DataFrame:
    """The conditions on what was counted. All hold together with those of ``selected``, and all come before paging, so that a count of this is the total."""
    if o.issues:
        d = d.where({"any": F.col("any_issue"), "dup": F.col("duplicate_volumes") > 0, "loose": F.col("unreadable_files") > 0}[o.issues])
    for wanted, cond in ((o.care, F.col("care_files") > 0), (o.gaps, F.col("has_gap")), (o.behind, F.col("status") == "behind"), (o.missing, F.size("missing") > 0)):
        if wanted:
            d = d.where(cond)
    return d


def order_of(sort: str) -> list[Column]:
    first = {
        "title": [F.lower("title")],
        "author": [F.lower(F.coalesce("author", F.lit(""))), F.lower("title")],
        "added": [F.desc("first_seen_at")],
        "volumes": [F.desc("file_count")],
        "updated": [F.desc("volume_added_at")],
    }[sort]
    return [*first, F.desc("series_id") if sort in ("added", "updated") else F.col("series_id")]


def series_list(t: Tables, o: Options) -> tuple[DataFrame, DataFrame]:
    """(the page, one row with the total of the filtered list). Nothing is kept between the two; ``series_page`` gives both in one."""
    d = filtered(summaries_of(selected(t, o)), o)
    return summaries.page(d, order_of(o.sort), o.limit, o.offset), d.agg(F.count("*").alias("total"))


def series_page(t: Tables, o: Options) -> DataFrame:
    """The page with ``total`` in each row: the count is a subquery of the same plan, which reuses what both shuffle."""
    page, total = series_list(t, o)
    return page.withColumn("total", total.scalar())


def series_detail(t: Tables, series_id: int) -> DataFrame:
    """One row: the summary with volumes (files and cover of each), side volumes, loose files and bibliography."""
    own = Tables(*(x.where(F.col("id" if x is t.series else "series_id") == series_id) for x in (t.series, t.volumes, t.files, t.bib, t.covers)))
    f = own.files.where("present").withColumn("base", issues.file_base(F.col("rel_path"), F.col("part"), F.col("ext")))
    of = f.groupBy("volume_id").agg(F.sort_array(F.collect_list(F.struct("rel_path", "id", "size", "base", "care"))).alias("files"), (F.count_distinct("base") > 1).alias("duplicate"))
    v = C.for_volumes(own.volumes.where("present"), own.covers).join(of.withColumnRenamed("volume_id", "id"), "id", "left")
    v = v.groupBy("series_id").agg(F.array_sort(F.collect_list(F.struct("unit", "volume_from", "volume_to", "id", "files", "duplicate", "cover", "borrowed"))).alias("volumes"))
    side = issues.side_volumes(own.files).groupBy("series_id").agg(F.sort_array(F.collect_list(F.struct((F.col("side_label") != "").alias("o"), "side_label", "files"))).alias("side"))
    loose = f.where("volume_id is null and side_label is null").groupBy("series_id").agg(F.sort_array(F.collect_list("rel_path")).alias("loose"))
    b = own.bib.groupBy("series_id").agg(F.sort_array(F.collect_list(F.struct("volume_no", "provider", "isbn", "title", "pubdate"))).alias("bib"))
    d = summaries_of(own)
    for part in (v, side, loose, b):
        d = d.join(part, "series_id", "left")
    return d


def find_files(t: Tables, q: str, limit: int = 60) -> DataFrame:
    """Present files of the works whose title or folder contains q, regardless of case."""
    s = summaries.search(t.series.where("present"), ["title", "folder"], q).select(F.col("id").alias("series_id"), "title", "folder")
    d = t.files.where("present").select("id", "series_id", "rel_path", "size").join(s, "series_id")
    return d.orderBy(F.lower("title"), "rel_path", "id").limit(limit)


def missing_list(t: Tables, kind: str = "all", limit: int = 200) -> DataFrame:
    """Series with something to get: later volumes (ahead), holes (gap), or either.

    Holdings and bibliography alone say which series these are and which of them are on the page; files, covers and the rest
    are read for the page's series.
    """
    cond = {"ahead": F.size("ahead") > 0, "gap": F.col("has_gap"), "all": (F.size("ahead") > 0) | F.col("has_gap")}[kind]
    d = t.series.where("present").select(F.col("id").alias("series_id"), "title")
    for part in (numbers.volumes_by_series(t.volumes).select("series_id", "holdings"), published(t.bib).select("series_id", "known")):
        d = d.join(part, "series_id", "left")
    ids = F.broadcast(summaries.page(with_missing(d).where(cond), order_of("title"), limit, 0, 1000).select("series_id"))  # a page
    series = t.series.join(ids.withColumnRenamed("series_id", "id"), "id", "left_semi")
    cut = Tables(series, *(x.join(ids, "series_id", "left_semi") for x in (t.volumes, t.files, t.bib, t.covers)))
    return summaries.page(summaries_of(cut), order_of("title"), limit, 0, 1000)


def check_owned(t: Tables, queries: DataFrame) -> DataFrame:
    """Answers to (query_id, title, volume, raw_text): owned, missing, unit, reason.

    Every series with the same key counts together; the author is never asked for. A request whose volume cannot be read
    is not owned, with missing unknown.
    """
    q = queries.withColumn("i", parse_item("title", "volume", "raw_text")).select("query_id", "i.*")
    s = t.series.where("present").select(F.col("id").alias("series_id"), "series_key")
    wanted = q.where("series_key <> ''").select("series_key").distinct()
    key = s.join(wanted, "series_key", "left_semi")  # nothing but what is asked for is gathered
    own = numbers.spans(t.volumes.where("present").join(key, "series_id"), ["series_key", "unit"], "volume_from", "volume_to").withColumnRenamed("spans", "_have")
    known = key.select("series_key").distinct().withColumn("_known", F.lit(True))
    d = q.join(known, "series_key", "left").join(own, ["series_key", "unit"], "left")
    d = d.withColumn("missing", F.when(F.col("_known"), numbers.missing_of_request(F.col("volume_from"), F.col("volume_to"), F.col("_have"))))
    reason = F.when(F.col("_known").isNull(), "no such series").when(F.col("volume_from").isNull(), "no volume could be read").when(F.size("missing") > 0, "some are missing").otherwise("owned")
    return d.select("query_id", F.coalesce(F.size("missing") == 0, F.lit(False)).alias("owned"), "missing", "unit", reason.alias("reason"))
