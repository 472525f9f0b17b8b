"""Data-quality counts per series: duplicate volumes, unreadable files, care marks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def file_base(rel_path: Column, part: Column, ext: Column) -> Column:
    """The path without part number and extension: what the pieces of one split archive share. Lengths are code points."""
    cut = F.length(F.coalesce(part, F.lit(""))) + F.length(F.coalesce(ext, F.lit("")))
    return F.substr(rel_path, F.lit(1), F.greatest(F.lit(0), F.length(rel_path) - cut))


def duplicates(files: DataFrame, volume: Sequence[str], base: str) -> DataFrame:
    """volume, bases: the volumes that more than one file base stands for."""
    return files.groupBy(*volume).agg(F.count_distinct(base).alias("bases")).where("bases > 1")


def duplicate_counts(files: DataFrame, series: Sequence[str], volume: Sequence[str], base: str) -> DataFrame:
    """series, duplicate_volumes, duplicate_files (files beyond one per volume) of the series that have any."""
    d = duplicates(files, [*series, *volume], base)
    return d.groupBy(*series).agg(F.count("*").alias("duplicate_volumes"), F.sum(F.col("bases") - 1).alias("duplicate_files"))


def files_by_volume(files: DataFrame) -> DataFrame:
    """Per (series_id, volume_id) of present files: bases, and the counts that ``file_counts`` adds up.

    Files are put together by their base first, so a series or a volume with very many files is no hot key.
    """
    f = files.where("present").withColumn("base", file_base(F.col("rel_path"), F.col("part"), F.col("ext")))
    loose = F.col("volume_id").isNull() & F.col("side_label").isNull()
    d = f.groupBy("series_id", "volume_id", "base").agg(F.count("*").alias("file_count"), F.sum("size").alias("bytes"), F.count_if(loose).alias("loose_files"), F.count_if("care").alias("care_files"))
    sums = [F.sum(c).alias(c) for c in ("file_count", "bytes", "loose_files", "care_files")]
    return d.groupBy("series_id", "volume_id").agg(F.count("base").alias("bases"), *sums)


def by_series(of_volumes: DataFrame) -> DataFrame:
    """Per series_id: file_count, bytes, loose_files, care_files, and ``twice``: (volume_id, bases) of the volumes that more than one base stands for."""
    twice = F.when(F.col("volume_id").isNotNull() & (F.col("bases") > 1), F.struct("volume_id", "bases"))
    return of_volumes.groupBy("series_id").agg(*(F.sum(c).alias(c) for c in ("file_count", "bytes", "loose_files", "care_files")), F.collect_list(twice).alias("twice"))


def with_duplicates(d: DataFrame) -> DataFrame:
    """Turns ``twice`` and ``volume_ids`` (the present volumes) into duplicate_volumes and duplicate_files (files beyond one per volume)."""
    own = F.filter("twice", lambda x: F.array_contains("volume_ids", x["volume_id"]))
    d = d.withColumn("duplicate_volumes", F.greatest(F.lit(0), F.coalesce(F.size(own), F.lit(0))).cast("long"))
    more = F.aggregate(own, F.lit(0).cast("long"), lambda n, x: n + x["bases"] - 1)
    return d.withColumn("duplicate_files", F.coalesce(more, F.lit(0).cast("long"))).drop("twice", "volume_ids")


def volume_duplicates(files: DataFrame, volumes: DataFrame) -> DataFrame:
    """series_id, duplicate_volumes, duplicate_files of the present files of present volumes; files without a volume take no part."""
    f = files.where("present and volume_id is not null").withColumn("base", file_base(F.col("rel_path"), F.col("part"), F.col("ext")))
    v = volumes.where("present").select("series_id", F.col("id").alias("volume_id"))
    return duplicate_counts(f.join(v, ["series_id", "volume_id"]), ["series_id"], ["volume_id"], "base")


def any_issue() -> Column:
    return (F.col("duplicate_volumes") > 0) | (F.col("unreadable_files") > 0)


def issues(files: DataFrame, volumes: DataFrame) -> DataFrame:
    """series_id, duplicate_volumes, duplicate_files, unreadable_files, any_issue of every series with files."""
    v = volumes.where("present").groupBy("series_id").agg(F.collect_set("id").alias("volume_ids"))
    d = with_duplicates(by_series(files_by_volume(files)).join(v, "series_id", "left"))
    d = d.select("series_id", F.col("loose_files").alias("unreadable_files"), "duplicate_volumes", "duplicate_files")
    return d.withColumn("any_issue", any_issue())


def side_volumes(files: DataFrame) -> DataFrame:
    """series_id, side_label, files: present files that are no volume by their label, the work itself ('') first."""
    side = files.where("present and volume_id is null and side_label is not null")
    d = side.groupBy("series_id", "side_label").agg(F.sort_array(F.collect_list(F.struct("rel_path", "id", "size"))).alias("files"))
    return d.orderBy("series_id", F.col("side_label") != "", F.collate("side_label", "ja"), "side_label")
