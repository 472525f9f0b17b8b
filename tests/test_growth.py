"""What would take time with the square of a key's rows, or make the same names several times over."""

import re

from pyspark.sql import functions as F

from shelfwright.operators.keyed import unique_names
from shelfwright.plans import moves
from shelfwright.sources import requests


def test_names_are_made_once(spark):
    """the plan of renames reads each file once and runs its names once."""
    files = spark.range(6).select(F.col("id"), F.lit(1).cast("long").alias("series_id"), F.element_at(F.array(*map(F.lit, ("[A] Old 第1巻.zip", "[A] Old 第01巻 x.zip", "Old 外伝.zip", "other.zip", "[A] Old 第1巻.zip", "other.zip"))), (F.col("id") + 1).cast("int")).alias("rel_path"), F.lit("巻").alias("unit"), F.lit(True).alias("present"), F.when(F.col("id").isin(0, 1, 4), 1).alias("volume_from"), F.when(F.col("id").isin(0, 1, 4), 1).alias("volume_to"))
    series = spark.createDataFrame([(1, "[A] Old", "Old")], "id long, folder string, title string")
    plan = moves.plan_renames(files, series, spark.createDataFrame([(1, "New", "A", False)], "series_id long, title string, author string, completed boolean"))
    made = re.findall(r"ArrowEvalPython", plan._jdf.queryExecution().optimizedPlan().toString())
    assert len(made) == 3  # the folder's name, the file's, and what is read from it again
    got = {r.id: (r.to_name, r.stuck, r.loses_volume) for r in plan.collect()}
    assert got == {0: ("[A] New 第01巻.zip", False, False), 1: ("[A] New 第01巻 x.zip", False, False), 2: ("[A] New 外伝.zip", False, False), 3: ("other.zip", True, False), 4: ("[A] New 第01巻 (2).zip", False, False), 5: ("other.zip", True, False)}


def test_held_numbers_count_once(spark):
    rows = [(1, "a"), (2, "a"), (3, "a (2)"), (4, "A (2)"), (5, "a (4)"), (6, None), (7, "a")]
    d = spark.createDataFrame([(i, "f", s, ".zip") for i, s in rows], "id long, folder string, stem string, suffix string")
    got = {r.id: r.name for r in unique_names(d, "folder", "stem", "suffix").collect()}
    assert got[1] == "a.zip" and got[3] == "a (2).zip" and got[5] == "a (4).zip" and got[6] is None and got[2] == "a (3).zip" and got[7] == "a (5).zip" and got[4] == "A (2) (2).zip"


def test_equal_titles_and_authors_meet_once(spark):
    """works and records of one title, volume and author are not paired with one another."""
    n = 3000
    w = spark.range(n).select("id", F.lit("Title").alias("title"), F.when(F.col("id") % 3 > 0, F.concat(F.lit(" A"), F.col("id") % 3)).alias("author"), F.lit(1).alias("volume"))
    r = spark.range(n).select((F.lit(n) - F.col("id")).alias("ordinal"), F.lit("title 1").alias("title"), F.concat(F.lit("a "), F.col("id") % 2 + 1).alias("author"), F.when(F.col("id") > 5, "u").alias("image_url"))
    d = requests.by_title(w, r, "google")
    assert {(x.a, x.o) for x in d.groupBy((F.col("id") % 3).alias("a")).agg(F.min("ordinal").alias("o")).collect()} == {(0, 1), (1, 2), (2, 1)}
    assert d.count() == n
    plan = d._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"Aggregate \[[^\]]*_want#\d+", plan)  # the works' side of the comparison of authors
