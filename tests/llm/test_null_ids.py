"""Fingerprints that only rows without an id have link like others."""

from shelfwright.llm import simhash


def test_null_ids_bridge_classes(spark):
    prints = spark.createDataFrame([(1, 0), (None, 3), (2, 15), (None, 1 << 40), (3, (1 << 41) - 1), (None, -1), (None, -2)], "doc_id long, fp long")
    got = {r.fp: r.component_id for r in simhash.classes(prints).collect()}
    assert got == {0: 1, 3: 1, 15: 1, 1 << 40: 1, (1 << 41) - 1: 3, -1: None, -2: None}
