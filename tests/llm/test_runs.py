"""Runs of Kolpakov and Kucherov against all periods tried one by one."""

import hashlib
import random

import duckdb
import pytest

from shelfwright.llm import runs

SF = "/root/testdata/sf0.001"


def plain(w, times, least):
    """Every maximal stretch of every period; of equal stretches the smallest period."""
    found = {}
    for q in range(1, len(w) // times + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j > i and j - i + q >= max(least, times * q):
                found.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted((s, t - s, q) for (s, t), q in found.items())


def sequences(seed, count):
    rng = random.Random(seed)
    for _ in range(count):
        w = [rng.randrange(rng.choice((1, 2, 2, 3, 5))) for _ in range(rng.randint(0, 60))]
        for _ in range(rng.randint(0, 4) if w else 0):
            s, p = rng.randrange(len(w)), rng.randint(1, max(1, len(w) // 4))
            w = (w[:s] + w[s : s + p] * rng.randint(1, 6) + w[s + p :])[:150]
        yield w


@pytest.mark.parametrize("times, least", [(2, 2), (2, 6), (3, 2), (4, 6), (4, 20)])
def test_runs(times, least):
    for w in sequences(times * 31 + least, 1500):
        assert runs.runs(w, times, least) == plain(w, times, least)
        assert runs.runs_of_words([b"%d" % x for x in w], times, least) == plain(w, times, least)


def test_fibonacci_and_powers():
    a, b = [0], [0, 1]
    for _ in range(12):
        a, b = b, b + a
    assert runs.runs(b) == plain(b, 2, 2)
    assert runs.runs([7] * 5000, 4, 6) == [(0, 5000, 1)]
    assert runs.runs(list(range(40)) * 50, 4, 6) == [(0, 2000, 40)]


def test_factors():
    for w in sequences(5, 400):
        ends = 0
        for b, e, d in runs.factors(w):
            assert b == ends
            longest = max((next((k for k in range(len(w) - b) if w[s + k] != w[b + k]), len(w) - b) for s in range(b)), default=0)
            assert e - b == max(1, longest) and (d < 0) == (longest == 0)
            assert d < 0 or d < b and w[d : d + e - b] == w[b:e]
            ends = e
        assert ends == len(w)


def test_stretches_hold_all_runs():
    rng = random.Random(3)
    prose = [b"%d" % rng.randrange(300) for _ in range(20000)]
    text = prose[:9000] + prose[100:107] * 9 + prose[9000:]
    assert runs.runs_of_words(text) == plain(text, 4, 6)
    left = runs.stretches(__import__("numpy").fromiter(map(hash, text), "int64", len(text)), 4, 6)
    assert sum(e - s for s, e in left) < 500


def test_odd(odd, empty):
    got = runs.find(odd, change=runs.planted).collect()
    rows = odd.select("doc_id", "text").collect()
    want = []
    for r in rows:
        w = runs.planted(r.doc_id, (r.text or "").encode().split())
        found = plain(w, 4, 6) if len(w) < 5000 else runs.runs_of_words(w)
        gone = {i for s, n, p in found for i in range(s + p, s + n)}
        want.append((str(r.doc_id), len(w), found, b" ".join(x for i, x in enumerate(w) if i not in gone).decode()))
    assert sorted((str(r.doc_id), r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in got) == sorted(want)
    assert runs.find(empty).count() == 0


def test_long_text(spark):
    """A very long text of one word, one of a long period, and separators that are no ASCII white space."""
    docs = spark.createDataFrame([(1, "x " * 300000), (2, " ".join(str(i % 5000) for i in range(60000))), (3, "a b " * 5), (4, "q\x1cq " * 7)], "doc_id long, text string")
    got = {r.doc_id: r for r in runs.find(docs).collect()}
    assert [tuple(x) for x in got[1].runs] == [(0, 300000, 1)] and got[1].collapsed == "x"
    assert [tuple(x) for x in got[2].runs] == [(0, 60000, 5000)] and got[2].collapsed.endswith(" 4999")
    assert not got[3].runs and got[4].collapsed == "q\x1cq"


def test_against_sql(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want, got = con.sql(runs.OP11_SQL), runs.op11_runs(spark, SF)
    assert got.columns == want.columns and any(r.n_runs for r in got.collect())
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want.fetchall()))
    none = hashlib.sha256(b"").hexdigest()
    assert all((r.start is None) == (r.n_runs == 0) == (r.runs_sha256 == none) for r in got.collect())
