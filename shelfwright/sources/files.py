"""File listings as DataFrames, and small text inputs."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, field, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.registry import inbox_key, parse_library_entry, series_key
from ..functions.scalars import is_content_file


def list_files(spark: SparkSession, root: str, root_id: str, under: str | None = None, recursive: bool = True) -> DataFrame:
    """root_id, rel_path, size, mtime of the content files below a root (or one folder of it).

    Reads the listing only: the contents are pruned from the scan. An unreadable root raises before anything else runs.
    """
    top = f"{root.rstrip('/')}/{under.strip('/')}" if under else root
    scan = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(top)
    d = scan.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("mtime"))
    bare = F.url_decode(F.regexp_replace(F.regexp_replace("path", "^[a-z0-9]+:(//[^/]*)?(?=/)", ""), "[+]", "%2B"))
    head = root.rstrip("/").removeprefix("file://")
    d = d.withColumn("rel_path", F.substring(bare, len(head) + 2, 1 << 30))
    return d.where(is_content_file(F.col("rel_path"))).select(F.lit(root_id).alias("root_id"), "rel_path", "size", "mtime")


def list_roots(spark: SparkSession, roots: list[dict]) -> DataFrame:
    """The files of all shelf roots; an inbox is none."""
    out = None
    for r in roots:
        if r.get("kind") != "inbox":
            d = list_files(spark, r["path"], r["id"])
            out = d if out is None else out.unionByName(d)
    return out


def parse_files(files: DataFrame) -> DataFrame:
    """A listing with what its paths say, and the key of the work."""
    d = files.withColumn("e", parse_library_entry("rel_path"))
    return d.select(*files.columns, "e.*").withColumn("series_key", series_key("title"))


def read_answers(spark: SparkSession, path: str) -> DataFrame:
    """key, title, author of a tab-separated file; a mark at the start, carriage returns, a header and blank titles do not count; the last line of a key wins."""
    d = spark.read.text(path, wholetext=False).select(F.monotonically_increasing_id().alias("n"), F.regexp_replace("value", "^﻿|\r$", "").alias("v"))
    c = F.split("v", "\t")
    at = lambda i: F.trim(F.coalesce(F.get(c, F.lit(i)), F.lit("")))
    d = d.select("n", at(0).alias("key"), at(1).alias("title"), F.nullif(at(2), F.lit("")).alias("author")).where("key not in ('', 'key') and title <> ''")
    return d.withColumn("rn", F.row_number().over(W.partitionBy("key").orderBy(F.desc("n")))).where("rn = 1").select("key", "title", "author")


def questions(works: DataFrame) -> DataFrame:
    """What is asked about unknown works: key, label, range, files, most files first. Write with ``write.csv(sep='\\t')``."""
    d = works.groupBy("key").agg(F.min_by("label", "name").alias("label"), F.min("volume_from").alias("lo"), F.max("volume_to").alias("hi"), F.count("*").alias("files"))
    span = F.when(F.col("lo").isNotNull(), F.concat_ws("-", F.array_distinct(F.array(F.col("lo").cast("string"), F.col("hi").cast("string")))))
    return d.select("key", "label", span.alias("volumes"), "files").orderBy(F.desc("files"), "key")


def keyed_answers(answers: DataFrame) -> DataFrame:
    return answers.withColumn("key", inbox_key("key"))


@dataclass
class Config:
    """Settings from a JSON file; environment variables in upper case win."""

    data_dir: str = "data"
    roots: list = field(default_factory=list)
    providers: list = field(default_factory=lambda: ["ndl"])
    scan_minutes: int = 180
    min_interval_ms: int = 1200

    @classmethod
    def load(cls, path: str, prefix: str = "SHELF_") -> Config:
        raw = json.loads(open(path, encoding="utf-8").read()) if os.path.exists(path) else {}
        for f in fields(cls):
            if (v := os.environ.get(prefix + f.name.upper())) is not None:
                raw[f.name] = v if f.type == "str" else json.loads(v)
        return cls(**{f.name: raw[f.name] for f in fields(cls) if f.name in raw})

    def ready(self, provider: str) -> bool:
        """Every provider is asked only if it is listed."""
        return provider in self.providers
