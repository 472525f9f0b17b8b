"""Queries against their SQL in DuckDB, and the shapes of plans that matter at scale."""

import os
import re
import subprocess
import sys

import duckdb
import pytest

from shelfwright.plans import asked, named, parity, shelf
from shelfwright.sources import layout

SF = "/root/testdata/sf0.001"
QUERIES, ORACLE = parity.QUERIES | named.QUERIES | asked.QUERIES, parity.ORACLE | named.ORACLE | asked.ORACLE


@pytest.fixture(scope="module")
def duck():
    if not os.path.isdir(SF):
        pytest.skip("no tables here")
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    assert cols == sorted(duck.sql(ORACLE[name]).columns)
    want = duck.sql(f"SELECT {', '.join(cols)} FROM ({ORACLE[name]}) q").fetchall()
    assert sorted((tuple(r) for r in df.select(cols).collect()), key=repr) == sorted(want, key=repr)


def plan(spark, name):
    return plan_of(spark, lambda: QUERIES[name](spark, SF))


def plan_of(spark, query):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        return query()._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("name, shuffles", [("holdings_gaps", 1), ("published_ahead", 2), ("latest_per_key", 1), ("majority_vote", 2), ("snapshot_upsert", 2)])
def test_plan(spark, duck, name, shuffles):
    p = plan(spark, name)
    assert len(re.findall("Exchange hash", p)) <= shuffles
    assert not re.search("NestedLoop|Cartesian|PythonUDF|ArrowEval", p)


def test_first_of_a_key_is_cut_before_the_shuffle(spark, duck):
    assert plan(spark, "latest_per_key").count("WindowGroupLimit") == 2


def test_requests_are_joined_before_volumes_are_gathered(spark, duck):
    lines = plan(spark, "own_requests").splitlines()
    depth = lambda s: len(s) - len(s.lstrip(" :+-|"))
    at = [k for k, x in enumerate(lines) if "collect_set" in x]
    assert at and all(any("LeftSemi" in x and depth(x) > depth(lines[k]) for x in lines[k:]) for k in at)


@pytest.mark.parametrize("name", ["holdings_list", "range_coverage", "exact_covers", "own_check", "own_requests", "shelf_list", "shelf_page", "missing_list"])
def test_ranges_stay_ranges(spark, duck, name):
    assert "Generate explode" not in plan(spark, name)


def test_filters_on_series_reach_the_other_tables(spark, duck):
    assert plan(spark, "shelf_page").count("LeftSemi") >= 4


def test_summaries_shuffle_each_table_once_or_by_finer_keys(spark, duck, tmp_path):
    made = named._tables(spark, SF)
    for name, df in vars(made).items():
        df.write.parquet(f"{tmp_path}/{name}")
    t = shelf.Tables(**{name: spark.read.parquet(f"{tmp_path}/{name}") for name in vars(made)})
    p = plan_of(spark, lambda: shelf.summaries_of(t))
    assert len(re.findall("Exchange hash", p)) <= 7


def test_tables_bucketed_by_series_are_not_shuffled(spark, duck, tmp_path):
    made = layout.save_by_series(vars(named._tables(spark, SF)), str(tmp_path / "s"), 8, {"series": "id"})
    p = plan_of(spark, lambda: shelf.summaries_of(shelf.Tables(**made)))
    assert "Exchange" not in p and p.count("Bucketed: true") == 5


def test_entry_can_be_imported_without_a_session():
    code = "import __spark_entry__ as e; assert len(e.queries()) >= len(e.oracle_sql()) > 100"
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    subprocess.run([sys.executable, "-c", code], check=True, cwd=top, timeout=120)
