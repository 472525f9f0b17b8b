"""The near-copy stage of the pipeline against all pairs."""

import numpy as np
import pytest

import corpus_pipeline
from shelfwright.llm import near, simhash

from .brute import similar
from .test_models import _labels


def corpus():
    rng = np.random.default_rng(8)
    word = lambda: f"w{rng.integers(0, 5000)}"
    rows = []
    for i in range(60):
        w = [word() for _ in range(int(rng.integers(30, 200)))]
        rows.append((i, " ".join(w)))
        for k in range(3):  # one to nine changed words: similarities on both sides of 0.8
            v = list(w)
            for _ in range(int(rng.integers(1, 10))):
                v[int(rng.integers(0, len(v)))] = word()
            rows.append((100 * (k + 1) + i, " ".join(v)))
    rows += [(None, rows[0][1]), (None, "alone " * 3), (5, "another text under a repeated number"), (900, None), (901, " "), (902, "A b"), (903, "a B")]
    return rows


def test_near_copies_against_all_pairs(spark):
    rows = corpus()
    label = _labels(len(rows), [(i, j) for i in range(len(rows)) for j in range(i) if similar(rows[i][1], rows[j][1]) >= 0.8])
    best = {}
    for (i, t), c in zip(rows, label):
        own = (i is None, i or 0, t or "")
        best[c] = min(best.get(c, own), own)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for got in (corpus_pipeline.near_duplicates(spark, docs, ""), near.keep_one(docs, large=2)):
        assert got.columns == docs.columns
        assert sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in got.collect()) == sorted(best.values())


def test_large_group_of_near_copies(spark):
    """A chain of small changes: most sets are near few others only, and all are one class."""
    rng = np.random.default_rng(4)
    w, rows = [f"w{rng.integers(0, 5000)}" for _ in range(120)], []
    for i in range(60):
        rows.append((i, " ".join(w)))
        w[int(rng.integers(0, 120))] = f"x{i}"
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert [r.doc_id for r in near.keep_one(docs, large=24).collect()] == [0]


def test_popcount_links_are_candidates(spark):
    """Sets whose fingerprints differ in 2 bits at most and that are near copies link without MinHash cells."""
    t = " ".join(f"w{i}" for i in range(400))
    a, b = (near.shingles(x) for x in (t, t + " end"))
    assert bin(simhash.of_hashes(a) ^ simhash.of_hashes(b)).count("1") <= 2
    reps = spark.createDataFrame([(int(np.uint64(simhash.of_hashes(x)).view(np.int64)), i) for i, x in enumerate((a, b))], "fp long, rep long")
    assert {frozenset(r) for r in simhash.links(reps).collect()} == {frozenset((0, 1))}


def test_near_copies_of_odd_tables(spark, odd, empty):
    kept = near.keep_one(odd)
    ids = sorted(r.doc_id or 0 for r in kept.collect())
    assert kept.dtypes == odd.dtypes and ids == [0, 1, 4, 6, 7, 10, 10, 11, 12]
    assert near.keep_one(empty).count() == 0
    with pytest.raises(ValueError):
        near.keep_one(odd, least=0.7)
