"""Supervised subword embeddings: documents are the average of their words' vectors, a word is the average of the hashed
vectors of itself and of its character n-grams, and a softmax layer tells the classes. Trained by numpy stochastic
gradient descent (Adagrad steps) on the driver, over whole documents: those of ``sample`` labels at most, drawn by a hash of
their ids, and of them, in that order, as many as ``room`` bytes of distinct words hold, but for documents whose distinct
words alone take over ``longest`` bytes; these bounds of the sample are parameters, and scoring has none.

A word that repeats the one before it adds the token ``REPEAT``, a bigram with a back reference, so that the average
sees repetition. Case and marks are kept.

As averaging and the layer before the softmax are linear, a trained model scores a word by one number (the difference of
the two classes' activations), and a document by the mean of its words' numbers; workers keep those in a bounded cache.

Defined cases: null and empty texts have a zero vector and get the bias's score; a label that is null or whose document
is missing is not learned from; repeated labels are separate examples; without both labels every score is the share of
label 1 (0.5 without any); repeated documents get rows of their own; words of any length are scored whole, in stretches.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import draw, fold_col, materialize, table, texts

BUCKETS, DIM, GRAMS = 1 << 17, 16, (3, 4, 5)
CACHE, REPEAT = 300_000, b"\n="
SAMPLE, ROOM, LONGEST, LONG = 6000, 64 << 20, 8 << 20, 1 << 16


def _rolling(flat: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Of each size in GRAMS, the hashes of the n-grams from each byte."""
    flat = flat.astype(np.uint64)
    h = np.zeros(len(flat), np.uint64)
    for n in range(1, max(GRAMS) + 1):
        m = len(flat) - n + 1
        if m <= 0:
            break
        h = h[:m] * np.uint64(0x100000001B3) + flat[n - 1 :] + np.uint64(1)
        if n in GRAMS:
            x = h * np.uint64(0x9E3779B97F4A7C15) + np.uint64(n)
            yield n, ((x ^ (x >> np.uint64(29))) % np.uint64(BUCKETS)).astype(np.int64)


def grams(flat: np.ndarray, starts: int) -> np.ndarray:
    """Rows of the n-grams that begin in the first ``starts`` bytes."""
    return np.concatenate([np.zeros(0, np.int64), *(rows[:starts] for _, rows in _rolling(flat))])


def subwords(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the words' own vectors and n-grams, concatenated, and where each word's begin."""
    lengths = np.array([len(w) + 2 for w in words], np.int64)
    flat = np.frombuffer(b"".join(b"<%b>" % w for w in words), np.uint8)
    start = np.append(0, np.cumsum(lengths))[:-1]
    owner = np.repeat(np.arange(len(words)), lengths)
    end = np.repeat(start + lengths, lengths)
    rows, own = [np.array([zlib.crc32(w) % BUCKETS for w in words], np.int64)], [np.arange(len(words))]
    for n, found in _rolling(flat):
        ok = np.flatnonzero(np.arange(len(found)) + n <= end[: len(found)])
        rows.append(found[ok])
        own.append(owner[ok])
    own = np.concatenate(own)
    order = np.argsort(own, kind="stable")
    return np.concatenate(rows)[order], np.append(0, np.cumsum(np.bincount(own, minlength=len(words))))[:-1]


def tokens(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").split()


@dataclass
class Model:
    """The numbers that scoring needs: of each hashed vector, and of the bias."""

    activation: np.ndarray
    bias: float

    def word_scores(self, words: list[bytes]) -> np.ndarray:
        """Of words of ``LONG`` bytes at most."""
        rows, start = subwords(words)
        n = np.diff(np.append(start, len(rows)))
        return np.add.reduceat(self.activation[rows], start, dtype=np.float64) / n

    def long_score(self, word: bytes) -> float:
        """Of a word of any length, whose n-grams are taken stretch by stretch."""
        total, n = float(self.activation[zlib.crc32(word) % BUCKETS]), 1
        for at in range(0, len(word) + 2, LONG):
            rows = grams(np.frombuffer(b"<%b>" % word, np.uint8)[at : at + LONG + max(GRAMS) - 1], LONG)
            total, n = total + float(self.activation[rows].sum(dtype=np.float64)), n + len(rows)
        return total / n


def _sparse(bags: list[tuple[list[bytes], np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a batch of bags (words, how often): its distinct rows, and per entry the document, the row's place and its share."""
    words = [w for own, _ in bags for w in own]
    if not words:
        return np.zeros(0, np.int32), np.zeros(0, np.uint16), np.zeros(0, np.uint16), np.zeros(0, np.float32)
    index = {w: i for i, w in enumerate(dict.fromkeys(words))}
    rows, start = subwords(list(index))
    n = np.diff(np.append(start, len(rows)))
    word = np.fromiter(map(index.__getitem__, words), np.int64, len(words))
    share = np.concatenate([c / c.sum() for _, c in bags if len(c)]) / n[word]
    doc = np.repeat(np.arange(len(bags)), [len(c) for _, c in bags])
    entry = np.repeat(start[word] - (np.cumsum(n[word]) - n[word]), n[word]) + np.arange(int(n[word].sum()))
    used, place = np.unique(rows, return_inverse=True)
    key, back = np.unique(np.repeat(doc, n[word]) * len(used) + place[entry], return_inverse=True)
    weight = np.bincount(back, np.repeat(share, n[word]))
    narrow = np.uint16 if len(used) < 1 << 16 else np.int32
    return used.astype(np.int32), (key // len(used)).astype(np.uint16), (key % len(used)).astype(narrow), weight.astype(np.float32)


def _unpacked(words: bytes, times: bytes) -> tuple[list[bytes], np.ndarray]:
    return words.split(b"\t") if times else [], np.frombuffer(times, np.int32).astype(np.float64)


def train(examples: list[tuple[bytes, bytes, int]], epochs: int = 6, rate: float = 0.3, size: int = 16, seed: int = 7) -> Model:
    """Two classes, labels 0 and 1; an example is its distinct words, how often each occurs (both packed), and the label."""
    labels = np.array([y for *_, y in examples], np.int64)
    if len(set(labels.tolist())) < 2:
        p = (labels.sum() + 0.5) / (len(labels) + 1)
        return Model(np.zeros(BUCKETS, np.float32), float(np.log(p / (1 - p))))
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    layer, bias = rng.normal(0, 0.5, (DIM, 2)).astype(np.float32), np.zeros(2, np.float32)
    sums = [np.full(BUCKETS, 1e-4, np.float32), np.full((DIM, 2), 1e-4, np.float32), np.full(2, 1e-4, np.float32)]
    order = rng.permutation(len(examples))
    batches = [order[at : at + size] for at in range(0, len(order), size)]
    ready = [(labels[some], *_sparse([_unpacked(*examples[i][:2]) for i in some])) for some in batches]
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        for k in rng.permutation(len(ready)):
            y, rows, doc, place, weight = ready[k]
            share = np.zeros((len(y), len(rows)), np.float32)
            share[doc, place] = weight
            own = vectors[rows]
            means = share @ own
            z = means @ layer + bias
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(y)), y] -= 1
            p /= len(y)
            g_rows, g_layer, g_bias = share.T @ (p @ layer.T), means.T @ p, p.sum(axis=0)
            for param, g, s in ((layer, g_layer, sums[1]), (bias, g_bias, sums[2])):
                s += g * g
                param -= step * 0.2 * g / np.sqrt(s)
            if len(rows):
                sums[0][rows] += (g_rows * g_rows).mean(axis=1)
                vectors[rows] = own - step * g_rows / np.sqrt(sums[0][rows])[:, None]
    return Model((vectors @ (layer[:, 1] - layer[:, 0])).astype(np.float32), float(bias[1] - bias[0]))


def bag(text: str) -> dict[bytes, int]:
    """The distinct tokens and how often each occurs, the marks of repetition among them."""
    w = tokens(text)
    out = dict(Counter(w))
    if again := sum(map(eq, w, w[1:])):
        out[REPEAT] = again
    return out


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for label, text, h in zip(*(c.to_pylist() for c in b.columns)):
            own = bag(text)
            words = b"\t".join(own)
            yield pa.RecordBatch.from_arrays([pa.array([label]), pa.array([words], pa.binary()), pa.array([np.fromiter(own.values(), np.int32).tobytes()], pa.binary()), pa.array([len(words) + 8 * len(own)]), pa.array([h])], names=["label", "words", "times", "size", "h"])


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE, room: int = ROOM, longest: int = LONGEST, seed: int = 7) -> Model:
    """Learns from the whole documents of ``sample`` labels (doc_id, label) at most, chosen by a hash of their ids, as far as ``room`` goes; a document whose distinct words take over ``longest`` bytes teaches nothing."""
    known = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("long").alias("label"))
    known = draw(known, sample, "doc_id", "label", seed=seed)
    drawn = texts(docs).join(F.broadcast(known), "doc_id").select("label", "text", F.xxhash64("doc_id", F.lit(seed)).alias("h"))
    bags = materialize(drawn.mapInArrow(_bags, "label long, words binary, times binary, size long, h long"), "bags")
    last, left = None, room
    for h, size in bags.where(F.col("size") <= longest).groupBy("h").agg(F.sum("size")).orderBy("h").collect():  # ``sample`` rows at most
        if size > left:
            break
        last, left = h, left - size
    kept = bags.where((F.col("size") <= longest) & (F.col("h") <= F.lit(last)))
    found = kept.select("h", "words", "label", "times").toArrow().to_pydict()
    return train([(w, n, y) for _, w, y, n in sorted(zip(found["h"], found["words"], found["label"], found["times"]))])


class Scorer:
    def __init__(self, model: Model):
        self.model, self.known = model, {}

    def logit(self, text: str) -> float:
        w = tokens(text)
        if not w:
            return self.model.bias
        known, long = self.known, []
        if missing := [x for x in set(w) if x not in known]:
            if len(known) + len(missing) > CACHE and known:
                known.clear()
                missing = list(set(w))
            long = [x for x in missing if len(x) > LONG]
            known.update((x, self.model.long_score(x)) for x in long)
            missing = [x for x in missing if len(x) <= LONG]
            size = np.cumsum(list(map(len, missing)), dtype=np.int64) >> 20  # a megabyte or so at a time
            for some in np.split(np.arange(len(missing)), np.flatnonzero(np.diff(size)) + 1):
                if len(own := [missing[i] for i in some.tolist()]):
                    known.update(zip(own, self.model.word_scores(own).tolist()))
        again = sum(map(eq, w, w[1:]))
        if again and REPEAT not in known:
            known[REPEAT] = float(self.model.word_scores([REPEAT])[0])
        total = sum(map(known.__getitem__, w)) + (again * known[REPEAT] if again else 0)
        for x in long:  # too long to keep
            del known[x]
        return total / (len(w) + again) + self.model.bias


def _score(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    scorer = Scorer(model)
    for b in batches:
        z = np.array([scorer.logit(t) for t in b.column(1).to_pylist()], np.float64)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(1 / (1 + np.exp(-z)))], names=["doc_id", "score"])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) per row of docs: the probability of label 1."""
    return texts(docs).mapInArrow(partial(_score, model=model), "doc_id long, score double")


def _keep(batches: Iterator[pa.RecordBatch], model: Model, least: float) -> Iterator[pa.RecordBatch]:
    scorer, cut = Scorer(model), float(np.log(least / (1 - least)))
    for b in batches:
        text = b.column(b.schema.get_field_index("text")).to_pylist()
        yield b.filter(pa.array([scorer.logit(t or "") >= cut for t in text], pa.bool_()))


def keep(docs: DataFrame, model: Model, least: float = 0.3) -> DataFrame:
    """The rows of docs, with all their columns, that score ``least`` or more."""
    return docs.mapInArrow(partial(_keep, model=model, least=least), docs.schema)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents, learned from the labels outside of the held-out fold."""
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, fit(docs, table(spark, sf_dir, "labels").where(fold_col() != 0)))
    return scored.select("doc_id", (fold_col() == 0).alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))
