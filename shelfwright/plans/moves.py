"""Plans of changes to files, to be looked at before anything is touched: inbox moves, renames, duplicates, splits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.registry import folder_name, inbox_key, move_name, new_stem, parse_filename, parse_inbox_name, romaji
from ..operators import joins
from ..operators.keyed import unique_names


def inbox_works(names: DataFrame) -> DataFrame:
    """A row per file (name): key, label, title, author, numbers; names without a key are left out."""
    return names.select("name", parse_inbox_name("name").alias("i")).select("name", "i.*").where("key <> ''")


def fold_inbox(works: DataFrame) -> DataFrame:
    """A row per work: only files with equal keys belong together."""
    one = F.struct("name", "volume_from", "volume_to", "unit")
    return works.groupBy("key").agg(F.min_by("label", "name").alias("label"), F.min_by("title", "name").alias("title"), F.min_by("author", "name").alias("author"), F.sort_array(F.collect_list(one)).alias("files"))


def shelf_with_readings(series: DataFrame, readings: DataFrame) -> DataFrame:
    """series (id, title, author, folder) with the reading of the same title, else of the first title that is a prefix either way."""
    r = readings.withColumnRenamed("title", "_title")
    found = joins.match_by_prefix(series.select("id", "title"), r, "id", "title", "_title", "_title", least=2, exact=1).select("id", "reading")
    return series.join(found, "id", "left").withColumn("reading_key", inbox_key(romaji("reading")))


def match_by_reading(works: DataFrame, shelf: DataFrame) -> DataFrame:
    """key with the id of the shelf's series of the same reading: equal, or prefixes of one another if both are long."""
    s = shelf.where("reading is not null").select(F.col("id").alias("series_id"), F.col("title").alias("shelf_title"), F.col("author").alias("shelf_author"), "reading_key")
    return joins.match_by_prefix(works.select("key").distinct(), s, "key", "key", "reading_key", "series_id")


def plan_moves(works: DataFrame, answers: DataFrame, matches: DataFrame, base: str) -> DataFrame:
    """from, to, work, author, numbers, keep_name, via of every inbox file; ``skipped`` where no title is known.

    What the name itself says beats an answer, an answer beats the shelf's reading.
    """
    a = answers.select("key", F.col("title").alias("a_title"), F.col("author").alias("a_author"))
    m = matches.select("key", "shelf_title", "shelf_author")
    d = works.join(a, "key", "left").join(m, "key", "left")
    via = F.when(F.col("title").isNotNull(), "name").when(F.col("a_title").isNotNull(), "answer").when(F.col("shelf_title").isNotNull(), "shelf").otherwise("skipped")
    d = d.withColumn("via", via).withColumn("work", F.coalesce("title", "a_title", "shelf_title"))
    d = d.withColumn("writer", F.when(F.col("via") == "name", F.col("author")).when(F.col("via") == "answer", F.col("a_author")).otherwise(F.col("shelf_author")))
    d = d.withColumn("p", move_name("name", "writer", "work", "volume_from", "volume_to", "unit", F.lit(base)))
    ext = F.regexp_extract("p.file", r"((?:\.part[0-9]+)?\.[^.]*)$", 1)
    d = d.select("name", "key", "work", F.col("writer").alias("author"), "volume_from", "volume_to", "unit", "via", F.coalesce("p.folder", F.lit("")).alias("folder"), F.col("p.file").alias("file"), F.col("p.keep_name").alias("keep_name"), ext.alias("suffix"))
    d = d.withColumn("stem", F.substr(F.col("file"), F.lit(1), F.length("file") - F.length("suffix")))
    moved = unique_names(d.where("via <> 'skipped'"), "folder", "stem", "suffix", tie="key" if "id" not in d.columns else "id")
    return moved.select(F.col("name").alias("to_name"), "folder", "key", "work", "author", "volume_from", "volume_to", "unit", "keep_name", "via", "file").union(
        d.where("via = 'skipped'").select(F.lit(None).cast("string"), F.lit(None).cast("string"), "key", "work", "author", "volume_from", "volume_to", "unit", "keep_name", "via", "file")
    )


def bucket(via: F.Column, unit: F.Column, keep: F.Column) -> F.Column:
    """The heap a move is shown in."""
    return F.when(via == "skipped", "unknown").when(keep, "kept name").when(unit == "話", "chapters").otherwise(via)


def bucket_counts(moves: DataFrame) -> DataFrame:
    return moves.groupBy(bucket(F.col("via"), F.col("unit"), F.col("keep_name")).alias("bucket")).agg(F.count("*").alias("files"), F.count_distinct("work").alias("works"))


def suspect_answers(answers: DataFrame, in_use: DataFrame, share: float = 0.6) -> DataFrame:
    """title, keys: titles that were given to keys too unlike to be one work: their common head is under ``share`` of the shortest."""
    d = answers.join(in_use.select("key").distinct(), "key", "left_semi").groupBy("title").agg(F.array_sort(F.collect_set("key")).alias("keys")).where("size(keys) > 1")
    low, high = F.get("keys", F.lit(0)), F.element_at("keys", -1)
    # the common head of sorted texts is that of the first and the last
    head = F.size(F.filter(F.sequence(F.lit(1), F.least(F.length(low), F.length(high))), lambda n: F.substr(low, F.lit(1), n) == F.substr(high, F.lit(1), n)))
    return d.where(head < share * F.array_min(F.transform("keys", F.length)))


def plan_renames(files: DataFrame, series: DataFrame, requests: DataFrame) -> DataFrame:
    """A row per file of the series that are to be renamed: series_id, id, from, to, stuck, loses_volume.

    requests (series_id, title, author, completed). Volumes get their new name with what stood behind the number, side
    stories their own rest behind the new title; a file whose rest cannot be told stays (``stuck``).
    """
    s = series.select(F.col("id").alias("series_id"), "folder", F.col("title").alias("old_title"))
    asked = requests.withColumn("to_folder", folder_name("author", "title", "completed"))
    d = files.where("present").join(asked.join(s, "series_id"), "series_id")
    d = d.withColumn("base", F.regexp_extract("rel_path", r"([^\\/]*)$", 1))
    d = d.withColumn("_new", new_stem("base", "author", "title", "old_title", "volume_from", "volume_to", "unit")).select("*", "_new.stem", "_new.suffix").drop("_new")
    ready = unique_names(d, "to_folder", "stem", "suffix")  # files without a stem are a name of their own there, so that no row is made twice
    stuck, is_volume = F.col("stem").isNull(), F.col("volume_from").isNotNull()
    ready = ready.withColumn("again", parse_filename(F.when(is_volume & ~stuck, F.col("name"))))
    loses = ~stuck & is_volume & ~F.col("again.volume_from").eqNullSafe(F.col("volume_from"))
    return ready.select("series_id", "id", F.col("folder").alias("from_folder"), "to_folder", F.col("base").alias("from_name"), F.when(stuck, F.col("base")).otherwise(F.col("name")).alias("to_name"), stuck.alias("stuck"), loses.alias("loses_volume"))


def rename_summary(plan: DataFrame) -> DataFrame:
    """Per series: moves that change something, files that stay, volumes that would be lost, and whether nothing changes."""
    changed = (F.col("from_name") != F.col("to_name")) | ~F.col("from_folder").eqNullSafe(F.col("to_folder"))
    return plan.groupBy("series_id").agg(F.count_if(changed & ~F.col("stuck")).alias("moves"), F.count_if("stuck").alias("stuck"), F.count_if("loses_volume").alias("loses_volume"), (F.count_if(changed) == 0).alias("noop"))


def keep_one(files: DataFrame, keep: DataFrame) -> DataFrame:
    """The other files of a volume whose one file (keep: volume_id, keep_base) stays: they go to the attic."""
    return files.where("present").join(keep, "volume_id").where("base <> keep_base").select("volume_id", "id", "rel_path")


def split_eligibility() -> F.Column:
    """Why a file cannot be split, null if it can: it must be a present ZIP of several volumes in one piece."""
    return (
        F.when(~F.col("present"), "not on the shelf")
        .when(F.col("unit") != "巻", "holds chapters")
        .when(F.col("volume_from").isNull(), "no volumes could be read")
        .when(F.col("volume_from") == F.col("volume_to"), "holds one volume")
        .when(F.col("part") != "", "is a part")
        .when(~F.lower("ext").isin(".zip", ".cbz"), "is no ZIP")
    )
