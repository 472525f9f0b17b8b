"""Exact duplicates by length, beginning and whole text."""

import hashlib
import re
from collections import defaultdict

import duckdb

from shelfwright.llm import copies

SF = "/root/testdata/sf0.001"


def plain(rows):
    """What each row gets: groups of equal lower-cased texts, the last row by doc_id."""
    groups = defaultdict(list)
    lower = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    for r in rows:
        groups[lower(r.text)].append(r.doc_id)
    least = -(1 << 63)
    return sorted(((i if i is not None else least), max((x for x in ids if x is not None), default=least), len(ids), hashlib.sha256(t.encode()).hexdigest()) for t, ids in groups.items() for i in ids)


def check(docs, **how):
    least = -(1 << 63)
    got = copies.deduplicate(docs, every_digest=True, **how).collect()
    short = lambda i: least if i is None else i
    assert sorted((short(r.doc_id), short(r.keep_id), r.group_size, r.digest.hex()) for r in got) == plain(docs.collect())
    kept = defaultdict(int)
    for r in got:
        assert not r.kept or r.doc_id == r.keep_id
        kept[r.digest] += r.kept
    assert set(kept.values()) <= {1}


def test_odd(odd, empty):
    check(odd)
    check(odd, bits=64)  # all keys share a few buckets: more is hashed, nothing else changes
    check(empty)


def test_beginnings_lengths_and_letters(spark):
    same = "A" * copies.HEAD
    rows = [(1, same + "x" * 40), (2, same.lower() + "X" * 40), (3, same + "x" * 39 + "y"), (4, same + "x" * 41), (5, "É"), (6, "é"), (7, "K"), (8, "K"), (9, "k"), (10, ""), (11, None), (None, None), (None, "only"), (None, "Only")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    check(docs)
    by = {r.doc_id: r for r in copies.deduplicate(docs).where("doc_id is not null").collect()}
    assert by[1].keep_id == 2 and by[2].kept and not by[1].kept and by[3].group_size == by[4].group_size == by[5].group_size == by[8].group_size == 1
    assert by[7].keep_id == 9 and by[10].keep_id == 11 and by[10].group_size == 3
    assert by[4].digest is None and by[3].digest is not None  # a length of its own is never read as a whole; an equal beginning is
    left = copies.drop(docs).collect()
    assert sorted(r.doc_id for r in left if r.doc_id is not None) == [2, 3, 4, 5, 6, 8, 9, 11]


def test_against_sql(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = con.sql(copies.OP12_SQL).fetchall()
    assert sorted(map(tuple, copies.op12_copies(spark, SF).collect())) == sorted(want)
