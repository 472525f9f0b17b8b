"""Language identification by cross-parsing entropy.

Of each language a suffix automaton of running labelled text is built. A text is cut greedily into the longest phrases that
occur in the language's text (or single unseen characters), across words; the language that needs the fewest phrases wins.
Phrase counts are normalised by what the language needs for running text of its own that its automaton has not seen, so
that richer samples give no advantage.

Texts are lower-cased; letters and marks stay, all between them is one space. The training text of a language is a bounded
sample of labelled rows: passages of ``LENGTH`` characters, cut from the whole texts of ``SAMPLE`` documents and drawn by a
hash, ``PASSAGES`` at most, every fifth of them for the normalising count. These bounds are parameters. Every document is
parsed whole, in stretches of ``STRETCH`` symbols that many lanes walk at once; a phrase ends with its stretch.

An automaton's transitions are kept as one hash table of (state, symbol), so its size follows the text and not the alphabet.

Defined cases: a null text or one without a letter (Unicode category L) is ``und`` with score 0; so is every text if nothing
can be learned; ties go to the language that is first in code point order; repeated documents get rows of their own; very
long texts cost their length; labelled documents without letters teach nothing; an empty table gives an empty one.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import fold_col, materialize, small, table, texts

SAMPLE, PASSAGES, LENGTH = 300, 250, 1000
STRETCH, PIECE = 1024, 1 << 21
_SPREAD = np.uint64(0x9E3779B97F4A7C15)


@lru_cache(maxsize=1)
def _kinds() -> np.ndarray:
    """Per code point: 2 for letters, 1 for marks, 0 for all else."""
    return np.array([{"L": 2, "M": 1}.get(unicodedata.category(chr(c))[0], 0) for c in range(sys.maxunicode + 1)], np.uint8)


def normal(text: str) -> np.ndarray:
    """Code points of the lower-cased letters and marks, with one space (32) for what is between, before and after them."""
    c = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    c = np.where(_kinds()[c] > 0, c, np.uint32(32))
    return c[np.append(True, (c[1:] != 32) | (c[:-1] != 32))]


def automaton(codes: list[int]) -> list[dict[int, int]]:
    """Transitions of the suffix automaton: each substring of ``codes`` is a path from state 0."""
    nxt: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in codes:
        cur = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            if length[q] == length[p] + 1:
                link[cur] = q
            else:
                copy = len(nxt)
                nxt.append(dict(nxt[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and nxt[p].get(c) == q:
                    nxt[p][c] = copy
                    p = link[p]
                link[q] = link[cur] = copy
        last = cur
    return nxt


def _flat(text: np.ndarray) -> np.ndarray:
    """Rows state, symbol, next state of the automaton of code points."""
    nxt = automaton(text.tolist())
    size = np.array(list(map(len, nxt)))
    out = np.empty((3, int(size.sum())), np.int32)
    out[0] = np.repeat(np.arange(len(nxt)), size)
    out[1] = np.fromiter((c for row in nxt for c in row), np.int32, out.shape[1])
    out[2] = np.fromiter((s for row in nxt for s in row.values()), np.int32, out.shape[1])
    return out


class Model:
    """The automata of all languages in one hash table of (state, symbol); symbol 0 is what no language has."""

    def __init__(self, learned: list[tuple[str, np.ndarray, np.ndarray]]):
        """learned: per language its name, the rows of its automaton, and code points of other text of its own."""
        learned = sorted(learned, key=lambda x: x[0])
        self.languages = [x for x, *_ in learned]
        alphabet = np.unique(np.concatenate([np.zeros(0, np.int32), *(rows[1] for _, rows, _ in learned)]))
        self.code = np.zeros(sys.maxunicode + 1, np.uint32)
        self.code[alphabet] = np.arange(1, len(alphabet) + 1)
        self.size = len(alphabet) + 1
        total, roots, keys, to = 0, [], [], []
        for _, rows, _ in learned:
            roots.append(total)
            keys.append((rows[0].astype(np.uint64) + np.uint64(total)) * np.uint64(self.size) + self.code[rows[1]])
            to.append(rows[2] + total)
            total += int(rows[2].max(initial=0)) + 1
        self.roots = np.array(roots, np.int64)
        self._hash(np.concatenate([np.zeros(0, np.uint64), *keys]), np.concatenate([np.zeros(0, np.int64), *to]))
        first = np.repeat(self.roots, self.size), np.tile(np.arange(self.size), len(roots))
        found = self._next(*first)
        self.first = np.where(found < 0, first[0], found).reshape(len(roots), self.size)
        self.unseen = (found < 0).reshape(len(roots), self.size)
        self.norm = np.ones(len(roots))
        for i, (_, _, other) in enumerate(learned):
            if len(other):
                self.norm[i] = max(1, self.phrases([other])[0, i]) / max(1, (other != 32).sum())

    def _hash(self, keys: np.ndarray, to: np.ndarray) -> None:
        """Linear probing; all keys that want a free slot are placed at once."""
        bits = max(4, int(3 * len(keys)).bit_length())
        self.shift, mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.to, self.mask = np.full(1 << bits, np.iinfo(np.uint64).max), np.zeros(1 << bits, np.int32), mask
        at, left = ((keys * _SPREAD) >> self.shift).astype(np.int64), np.arange(len(keys))
        while len(left):
            free = self.keys[at[left]] == np.iinfo(np.uint64).max
            self.keys[at[left[free]]] = keys[left[free]]
            done = self.keys[at[left]] == keys[left]
            self.to[at[left[done]]] = to[left[done]]
            left = left[~done]
            at[left] = (at[left] + 1) & mask

    def _next(self, state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """The next states, -1 where there is none."""
        key = state.astype(np.uint64) * np.uint64(self.size) + symbol.astype(np.uint64)
        at = ((key * _SPREAD) >> self.shift).astype(np.int64)
        found = self.keys[at]
        out = np.where(found == key, self.to[at], -1)
        left = np.flatnonzero((found != key) & (found != np.iinfo(np.uint64).max))
        while len(left):
            at[left] = (at[left] + 1) & self.mask
            found = self.keys[at[left]]
            hit = found == key[left]
            out[left[hit]] = self.to[at[left[hit]]]
            left = left[~hit & (found != np.iinfo(np.uint64).max)]
        return out

    def phrases(self, texts: list[np.ndarray]) -> np.ndarray:
        """(texts, languages): how many longest matches, or single unseen characters, make up each text of code points."""
        k, size = len(self.roots), np.array([len(t) for t in texts], np.int64)
        lanes = -(-size // STRETCH)
        flat = self.code[np.concatenate([*texts, np.zeros(0, np.uint32)])]
        owner = np.repeat(np.arange(len(texts)), lanes)
        number = np.arange(len(owner)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        start = np.repeat(np.cumsum(size) - size, lanes) + number * STRETCH
        length = np.minimum(STRETCH, np.repeat(size, lanes) - number * STRETCH)
        order = np.argsort(-length, kind="stable")  # lanes that are still on the way come first
        start, length = start[order], length[order]
        live = len(order) - np.searchsorted(length[::-1], np.arange(STRETCH), "right")
        state = np.repeat(self.roots[:, None], len(order), axis=1)
        count = np.zeros((k, len(order)), np.int32)
        root = self.roots[:, None]
        for step in range(int(length.max(initial=0))):
            m = live[step]
            c, s = flat[start[:m] + step], state[:, :m]
            new = self._next(s.ravel(), np.tile(c, k)).reshape(k, m)
            lang, lane = np.nonzero(new < 0)
            count[lang, lane] += (s[lang, lane] != self.roots[lang]).astype(np.int32) + self.unseen[lang, c[lane]]
            new[lang, lane] = self.first[lang, c[lane]]
            state[:, :m] = new
        count += state != root
        out = np.zeros((k, len(texts)), np.int64)
        for i in range(k):
            out[i] = np.bincount(owner[order], count[i], len(texts))
        return out.T

    def predict(self, texts: list[str]) -> list[tuple[str, float]]:
        if not self.languages:
            return [("und", 0.0)] * len(texts)
        codes = [normal(t) for t in texts]
        counts = self.phrases(codes)
        letters = np.array([int((_kinds()[c] == 2).sum()) for c in codes])
        cost = counts / np.maximum(1, letters)[:, None] / self.norm
        best = cost.argmin(axis=1)
        score = 1 / np.exp(-8 * (cost - cost.min(axis=1, keepdims=True))).sum(axis=1)
        return [(self.languages[b], float(x)) if n else ("und", 0.0) for b, x, n in zip(best.tolist(), score, letters.tolist())]


_MODELS: dict[tuple, Model] = {}


def _pack(x: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.diff(x.astype(np.int32), prepend=0, axis=-1).astype(np.int32).tobytes())


def _unpack(x: bytes, rows: int) -> np.ndarray:
    return np.cumsum(np.frombuffer(zstandard.ZstdDecompressor().decompress(x), np.int32).reshape(rows, -1), axis=1, dtype=np.int32)


def model_of(learned: tuple) -> Model:
    """The worker's model; another one makes room first."""
    if learned not in _MODELS:
        _MODELS.clear()
        _MODELS[learned] = Model([(lang, _unpack(rows, 3), _unpack(other, 1)[0]) for lang, rows, other in learned])
    return _MODELS[learned]


def _cut(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Passages of the normal texts, numbered."""
    for b in batches:
        for lang, doc_id, text in zip(*(c.to_pylist() for c in b.columns)):
            c = normal(text)
            parts = [c[at : at + length].tobytes() for at in range(0, len(c), length)] if len(c) > 1 else []
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(parts), pa.string()), pa.array([doc_id] * len(parts), pa.int64()), pa.array(range(len(parts)), pa.int64()), pa.array(parts, pa.binary())], names=["lang", "doc_id", "k", "passage"])


def _build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The automaton of each language; passages (lang, n, passage) come sorted, those of one language are held at a time."""
    held: list[tuple] = []

    def done() -> pa.RecordBatch:
        text = lambda own: np.frombuffer(b"".join(p for _, n, p in held if (n % 5 == 0) != own), np.uint32).astype(np.int32)
        return pa.RecordBatch.from_arrays([pa.array([held[0][0]]), pa.array([_pack(_flat(text(True)))], pa.binary()), pa.array([_pack(text(False)[None])], pa.binary())], names=["lang", "rows", "other"])

    for b in batches:
        for row in zip(*(c.to_pylist() for c in b.columns)):
            if held and held[0][0] != row[0]:
                yield done()
                held = []
            held.append(row)
    if held:
        yield done()


def fit(docs: DataFrame, sample: int = SAMPLE, passages: int = PASSAGES, length: int = LENGTH, seed: int = 5) -> tuple:
    """What ``model_of`` needs, from labelled documents: per language its name, its automaton, and text to normalise by."""
    known = docs.where("lang is not null and doc_id is not null and text is not null")
    h = F.xxhash64("doc_id", F.lit(seed))
    ids = known.select("lang", F.col("doc_id").cast("long").alias("doc_id"))
    many = small(ids.groupBy("lang").agg(F.count("*").alias("many")), 20_000)
    share = F.shiftright(h, 1) + (1 << 62) < F.lit(2.0**63) * F.least(F.lit(1.0), (3.0 * sample + 100) / F.col("many"))
    n = F.row_number().over(W.partitionBy("lang").orderBy(h, "doc_id"))
    drawn = ids.join(many, "lang").where(share).select("lang", "doc_id").distinct().select("lang", "doc_id", n.alias("n")).where(F.col("n") <= sample)
    drawn = small(drawn.select("lang", "doc_id"), 200_000)  # ``sample`` rows per language
    own = known.select("lang", F.col("doc_id").cast("long").alias("doc_id"), "text").join(drawn, ["lang", "doc_id"]).select("lang", "doc_id", "text")
    cut = materialize(own.mapInArrow(partial(_cut, length=length), "lang string, doc_id long, k long, passage binary"), "passages")
    order = W.partitionBy("lang").orderBy(F.xxhash64("doc_id", "k", F.lit(seed)), "doc_id", "k", "passage")
    kept = cut.select("lang", F.row_number().over(order).alias("n"), "passage").where(F.col("n") <= passages)
    built = kept.repartition("lang").sortWithinPartitions("lang", "n").mapInArrow(_build, "lang string, rows binary, other binary")
    return tuple((r["lang"], bytes(r["rows"]), bytes(r["other"])) for r in sorted(built.collect(), key=lambda r: r["lang"]))


def _pieces(texts: list[str]) -> Iterator[list[str]]:
    """Runs of texts of about ``PIECE`` characters."""
    piece, size = [], 0
    for t in texts:
        piece.append(t)
        size += len(t)
        if size >= PIECE:
            yield piece
            piece, size = [], 0
    if piece:
        yield piece


def _predict(batches: Iterator[pa.RecordBatch], learned: tuple) -> Iterator[pa.RecordBatch]:
    model = model_of(learned)
    for b in batches:
        found = [x for piece in _pieces(b.column(1).to_pylist()) for x in model.predict(piece)]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())], names=["doc_id", "lang_pred", "score"])


def predict(docs: DataFrame, learned: tuple) -> DataFrame:
    """(doc_id, lang_pred, score) per row of docs."""
    return texts(docs).mapInArrow(partial(_predict, learned=learned), "doc_id long, lang_pred string, score double")


def op8_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions for all documents, learned from the labelled ones outside of the held-out fold."""
    docs = table(spark, sf_dir, "documents")
    found = predict(docs, fit(docs.where(fold_col() != 0)))
    return found.select("doc_id", (fold_col() == 0).alias("held_out"), "lang_pred", "score")
