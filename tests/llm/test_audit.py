"""Divergence of sources against sums over plain dictionaries."""

import os
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from shelfwright.llm import audit

SF = "/root/testdata/sf0.001"


def plain(rows, least=10, top=10):
    counts, docs, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        groups[lang].add(source)
        words = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        counts[lang, source].update(words)
        docs[lang].update(set(words))
    out = []
    for lang, sources in groups.items():
        kept = sorted((t for t, n in docs[lang].items() if n >= least), key=str.encode)
        whole = sum((counts[lang, s] for s in sources), Counter())
        share = lambda c: {t: 1 + 10**9 * (c[t] + 2) // (sum(c[k] for k in kept) + 2 * len(kept)) for t in kept}
        p, q = {s: share(counts[lang, s]) for s in sources}, share(whole)
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pairs = sorted(((-sum(f(p[s][t], p[o][t]) for t in kept), o.encode()) for o in sources - {s}))
            terms = sorted(((-f(p[s][t], q[t]), t.encode()) for t in kept if counts[lang, s][t] and p[s][t] > q[t]))[:top]
            for part, items in (("pair", pairs), ("term", terms)):
                out += ((lang, s, part, i.decode(), -v, r + 1) for r, (v, i) in enumerate(items))
    return sorted(out)


def check(df, least=10, top=10, **cut):
    got = audit.divergence(df, least, top, **cut)
    assert dict(got.dtypes) == {"lang": "string", "source": "string", "part": "string", "item": "string", "value": "bigint", "rank": "int"}
    want = plain([(r.lang, r.source, r.text) for r in df.select("lang", "source", "text").collect()], least, top)
    assert sorted(map(tuple, got.collect())) == want
    return want


def test_trie():
    rng = random.Random(1)
    words = {bytes(rng.choices(b"abc\xc3\xa9", k=rng.randint(1, 7))) for _ in range(800)} | {b"a" * 3000, b"a" * 2999}
    trie, numbers = audit.Trie(), {}
    for w in [*words, *words]:
        assert numbers.setdefault(w, len(numbers)) == trie.leaf(w)
    assert [w for w, _ in trie.walk()] == sorted(words) and dict(trie.walk()) == numbers


def test_shares_do_not_overflow():
    n, size, kept = np.array([0, 1, 10**13, 3 * 10**14]), 4 * 10**14, 10**6
    assert audit._share(n, size, kept).tolist() == [1 + 10**9 * (x + 2) // (size + 2 * kept) for x in n.tolist()]


def test_odd(odd, empty):
    check(odd, least=1)
    check(odd, least=2)
    check(odd)
    assert audit.divergence(empty).count() == 0


@pytest.mark.parametrize("cut", [{}, {"depth": 1, "room": 20, "leaves": 40}])
def test_many_partitions(spark, cut):
    """Terms that are beginnings of others, cut deeper and deeper; ties; sources without terms; letters of several bytes."""
    rng = random.Random(2)
    words = ["a", "aa", "aaa", "aaaa" * 9, "aaaa" * 9 + "b", "Aab", "é", "éé", "漢字", "漢", "𝔘x", "zeta", "Zeta", "the"] + [f"{'common' * 3}{a}{b}" for a in "abcdef" for b in "xyz"]
    rows = [(rng.choice(["en", "fr", None]), rng.choice(["s1", "s2", "s2", "s3", "Ä", None]), "the the. " + " ".join(rng.choices(words, k=rng.randint(0, 30)))) for _ in range(400)]
    rows += [("en", "silent", "12 + 3"), ("en", "silent2", None), ("de", "alone", "das"), ("it", "one", "uno"), ("it", "two", "due")]
    want = check(spark.createDataFrame(rows, "lang string, source string, text string").repartition(7), **cut)
    assert ("it", "one", "pair", "two", 0, 1) in want and any(x[1] == "silent" for x in want) and not any(x[0] == "de" for x in want)


def test_sources_in_tiles_and_terms_in_steps(spark, monkeypatch):
    rows = [("en", f"s{i % 17:02}", " ".join(f"{'abcdefgh'[(i * k) % 8] * (k + 1)}" for k in range(9))) for i in range(300)]
    monkeypatch.setattr(audit, "TILE", 5)
    check(spark.createDataFrame(rows, "lang string, source string, text string"), top=3)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")
def test_against_sql(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want, got = con.sql(audit.OP13_SQL), audit.op13_audit(spark, SF)
    assert got.columns == want.columns
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())


def test_a_merge_asks_the_trie_once_for_each_term(monkeypatch):
    import random

    import pyarrow as pa

    from shelfwright.llm import audit

    rng = random.Random(3)
    words = ["".join(rng.choices("abé", k=rng.randrange(1, 6))) for _ in range(200)]
    docs = lambda: pa.RecordBatch.from_pydict({"lang": ["l"] * 9, "source": [rng.choice("st") for _ in range(9)], "text": [" ".join(rng.choices(words, k=50)).encode() for _ in range(9)]})
    seen = [docs() for _ in range(4)]
    cut = pa.concat_tables(pa.Table.from_batches(audit._tries(iter([b]), 1, 1 << 18)) for b in seen).sort_by([("lang", "ascending"), ("prefix", "ascending")])
    asked, leaf = [], audit.Trie.leaf
    monkeypatch.setattr(audit.Trie, "leaf", lambda self, term: asked.append(term) or leaf(self, term))
    rows = pa.Table.from_batches(audit._merge(iter(cut.to_batches()), 1))
    terms = [t for b in seen for x in b["text"].to_pylist() for t in x.decode().split()]
    assert len(asked) == len(set(terms)) and sum(rows["n"].to_pylist()) == len(terms)
    assert {(t, n) for t, n in zip(rows["term"].to_pylist(), rows["total"].to_pylist())} == {(t, terms.count(t)) for t in terms}


def test_few_leaves_are_one_table():
    """A trie makes a node for tables that grow, not for each term, and still numbers and orders every term."""
    rng = random.Random(4)
    words = list({bytes(rng.choices(b"abcdefghij\xc3\xa9", k=rng.randint(1, 9))) for _ in range(20000)} | {b"a" * k for k in range(1, 900)})
    trie = audit.Trie()
    numbers = {w: trie.leaf(w) for w in words}
    assert sorted(numbers.values()) == list(range(len(words))) and [trie.leaf(w) for w in words] == list(numbers.values())
    assert list(trie.walk()) == sorted(numbers.items())
    nodes, todo = 0, [trie.root]
    while todo:
        node = todo.pop()
        nodes += 1
        todo += [kid for kid in node[2].values() if isinstance(kid, list)]
    assert nodes < len(words) / 10


def test_terms_below_and_inside_a_label(monkeypatch):
    """Tables that grow beneath long labels, and later terms that end in or leave those labels."""
    rng = random.Random(5)
    for table in (1, 2, 5):
        monkeypatch.setattr(audit, "TABLE", table)
        words = [b"", *(b"common" * 4 + bytes(rng.choices(b"ab\xff", k=rng.randint(0, 5))) for _ in range(60)), *((b"common" * 4)[:k] + b"x" for k in range(24)), *((b"common" * 4)[:k] for k in range(24))]
        trie, numbers = audit.Trie(), {}
        for w in [*words, *words]:
            assert numbers.setdefault(w, len(numbers)) == trie.leaf(w)
        assert list(trie.walk()) == sorted(numbers.items()) and trie.size == len(numbers)
