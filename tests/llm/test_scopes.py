"""Tables written on the way go with the scope they were written in, and no others do."""

import os

import pytest

import __spark_entry__ as entry
from shelfwright.llm import registry
from shelfwright.llm.common import discard, materialize, scope, small

SF = "/root/testdata/sf0.001"


def folder(df):
    return os.path.dirname(df.inputFiles()[0].removeprefix("file:").replace("///", "/"))


def test_scope(spark):
    before = materialize(spark.range(5), "before")
    with scope(spark) as keep:
        inside, kept = materialize(spark.range(6), "inside"), keep(materialize(spark.range(7), "kept"))
        with scope(spark):
            deeper = folder(small(spark.range(8), 100))
        assert not os.path.exists(deeper) and inside.count() == 6
        gone = folder(inside)
    assert not os.path.exists(gone) and before.count() == 5 and kept.count() == 7
    gone = folder(kept)
    discard(kept)
    assert not os.path.exists(gone) and before.count() == 5


def test_small(spark):
    hint = lambda df: "ResolvedHint" in df._jdf.queryExecution().analyzed().toString()
    assert hint(small(spark.range(10), 10)) and not hint(small(spark.range(11), 10)) and not hint(small(spark.range(10), 10, room=1))


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")
@pytest.mark.parametrize("last", [False, True])
def test_queries_beside_the_pipeline(spark, last):
    """Every query's lazy result can still be written when the pipeline has run, and the other way round."""
    known = entry.queries()
    names = [*registry.QUERIES, "pipeline"] if last else ["pipeline", *registry.QUERIES]
    made = {name: known[name](spark, SF) for name in names}
    n = spark.read.parquet(f"{SF}/documents.parquet").count()
    for name, df in made.items():
        rows = df.count()
        assert rows > 0 and (rows == n or name in ("pipeline", "op9_lattice", "op13_audit")), name
