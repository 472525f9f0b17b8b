"""Language-model scores of a log-bilinear model trained with noise-contrastive estimation.

The model predicts a symbol from the two before it. The context is the sum of a vector for either word, and a symbol's
probability is that of its group, normalised over all groups, times its own, normalised over the group's symbols:
s(g, h) = (A1[h1] + A2[h2]) . R[g] + c[g], and s(w, h) = (A1[h1] + A2[h2]) . Q[w] + b[w], both by batched matrix products.

Symbols are the ``SYMBOLS`` commonest tokens (the document's end is one) and ``BUCKETS`` classes that all other words fall
into by their last three bytes. What falls to a class is shared out among its words by their smoothed counts, so every word
has a probability that follows the context, and the scores are those of a distribution over every word.

1. Tokens of all training documents are counted (partial sums in each task, then by word).
2. The training documents are dealt into ``ROUNDS`` parts by a hash, and each round trains on every position of one part, so
   each position is learned from once. Each task trains a copy of the model by stochastic gradient descent against
   ``NOISE`` draws from the groups' frequencies, common to a batch, and as many from the frequencies within each group. The
   copies are averaged row by row, weighted by how often a task has met the row's symbol, first over neighbouring tasks.
3. All documents are scored. Counts of the commonest words travel with the tasks (``HEAD`` words and ``ROOM`` bytes at
   most, words of any usual length); the remaining words are joined with the table of counts.

What the second and third step gather grows with the documents: counts, copies of the model, and words to look up.

Defined cases: a null text is empty, an empty text is its end alone; a null doc_id is the empty text in crc32; rows that
repeat a doc_id are scored each; very long texts and words are scored whole; ties in frequency go to the smaller word;
without training documents all counts are zero and every token has the probability of an unknown one; an empty table gives
an empty one; other columns are left out.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import partial
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, fold_col, materialize, table, texts

SYMBOLS, BUCKETS, GROUPS, DIM, NOISE, BATCH, LEAST, STEP = 6144, 2048, 64, 16, 16, 4096, 64, 0.15
ROUNDS, HEAD, ROOM, LONGEST, BLOCKS, NEIGHBOURS = 2, 1 << 18, 32 << 20, 1 << 20, 16, 64
FLUSH, COUNTED, PIECE, ROWS = 1 << 19, 1 << 24, 1 << 23, 1 << 10
END = b""


def tokens(text: str) -> list[bytes]:
    """Words with A-Z lowered, then the end."""
    w = text.encode("utf-8", "surrogatepass").translate(LOWER).split()
    w.append(END)
    return w


def split(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts with A-Z lowered, without the ends, and how many each text has."""
    parts = pc.ascii_split_whitespace(pc.ascii_lower(texts.cast(pa.string())))
    words, begin = parts.values.cast(pa.binary()), parts.offsets.to_numpy()
    there = pc.greater(pc.binary_length(words), 0)  # spaces at the sides of a text leave empty strings
    if not pc.all(there, min_count=0).as_py():
        begin = np.append(0, np.cumsum(there.to_numpy(zero_copy_only=False)))[begin]
        words = words.filter(there)
    return words, np.diff(begin).astype(np.int64)


def _pieces(texts: pa.Array, room: int) -> Iterator[tuple[int, pa.Array]]:
    """Runs of texts, of ``room`` bytes (six for each space, if words are shorter) or a single one, and where each begins."""
    size = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    spaces = sum(pc.count_substring(texts, c).to_numpy(zero_copy_only=False).astype(np.int64) for c in " \t\n")
    size, at = np.cumsum(np.maximum(size, 6 * spaces) + 64), 0
    while at < len(texts):
        stop = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + room, "right")))
        yield at, texts.slice(at, stop - at)
        at = stop


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, rows, least = [], 0, FLUSH

    def merged() -> pa.Table:
        t = pa.Table.from_batches(held).group_by("word", use_threads=False).aggregate([("n", "sum")])
        return t.select(["word", "n_sum"]).rename_columns(["word", "n"]).combine_chunks()

    for b in batches:
        for _, own in _pieces(b.column(0), COUNTED):
            seen = pc.value_counts(split(own)[0])
            for word, n in ((seen.field("values"), seen.field("counts")), (pa.array([END]), pa.array([len(own)], pa.int64()))):
                held.append(pa.RecordBatch.from_arrays([word, n], names=["word", "n"]))
                rows += len(word)
            if rows >= least:
                t = merged()
                if len(t) >= FLUSH:
                    yield from t.to_batches()
                    held, rows, least = [], 0, FLUSH
                else:
                    held, rows, least = t.to_batches(), len(t), len(t) + FLUSH
    if held:
        yield from merged().to_batches()


def count(docs: DataFrame) -> DataFrame:
    """(word, c): every token of the texts and how often it occurs; the end is the empty word."""
    part = docs.select("text").mapInArrow(_count, "word binary, n long")
    return materialize(part.groupBy("word").agg(F.sum("n").alias("c")), "counts")


def bucket(word: bytes, buckets: int) -> int:
    return zlib.crc32(word[-3:]) % buckets


def bucket_col(word: str, buckets: int) -> Column:
    return F.crc32(F.expr(f"substring({word}, greatest(1, octet_length({word}) - 2), 3)")) % buckets


class Vocabulary:
    """The commonest words with their counts, the totals of the whole corpus, and the model's symbols.

    ``classes``: per bucket the tokens and distinct words of the whole corpus in it.
    """

    def __init__(self, words: list[bytes], counts: list[int], total: int, distinct: int, classes: dict[int, tuple[int, int]], symbols: int = SYMBOLS, buckets: int = BUCKETS):
        self.words, self.counts, self.total, self.distinct = words, np.array(counts, np.float64), total, distinct
        self.symbols, self.buckets = min(symbols, len(words)), buckets
        self.log_all = np.log10(total + 0.5 * (distinct + 1))
        held = np.zeros((2, buckets))  # tokens and words of the buckets that have no symbol of their own
        for k, (n, v) in classes.items():
            held[:, k] = n, v
        own = [bucket(w, buckets) for w in words[: self.symbols]]
        np.subtract.at(held[0], own, self.counts[: self.symbols])
        np.subtract.at(held[1], own, 1)
        self.log_bucket = np.log10(held[0] + 0.5 * (held[1] + 1))
        mass = np.concatenate([self.counts[: self.symbols], held[0]]) + 0.5
        self.size = -(-len(mass) // GROUPS) * GROUPS  # symbol w is in group w % GROUPS; those that fill up have no mass
        self.unigram = np.append(mass, np.zeros(self.size - len(mass))) / mass.sum()

    def codes(self) -> dict[bytes, int]:
        """The symbol of each of the commonest words."""
        return {w: i if i < self.symbols else self.symbols + bucket(w, self.buckets) for i, w in enumerate(self.words)}

    def code(self, words: list[bytes], known: dict[bytes, int]) -> np.ndarray:
        out = np.fromiter(map(known.get, words, repeat(-1)), np.int32, len(words))
        for k in np.flatnonzero(out < 0).tolist():
            out[k] = self.symbols + bucket(words[k], self.buckets)
        return out

    def __getstate__(self) -> dict:
        return self.__dict__ | {"words": zstandard.ZstdCompressor(level=1).compress(b"\n".join(self.words)), "none": not self.words}

    def __setstate__(self, state: dict) -> None:
        packed, none = state.pop("words"), state.pop("none")
        self.__dict__.update(state)
        self.words = [] if none else zstandard.ZstdDecompressor().decompress(packed).split(b"\n")


def vocabulary(counts: DataFrame, head: int = HEAD, symbols: int = SYMBOLS, buckets: int = BUCKETS, room: int = ROOM) -> Vocabulary:
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    usual = counts.where(F.octet_length("word") <= LONGEST)
    at = None  # the least count whose words all fit
    for c, n, size in usual.groupBy("c").agg(F.count("*"), F.sum(F.octet_length("word"))).orderBy(F.desc("c")).toLocalIterator():
        if n > head or size > room:
            break
        at, head, room = c, head - n, room - size
    top = [] if at is None else sorted(usual.where(F.col("c") >= at).collect(), key=lambda r: (-r["c"], r["word"]))
    classes = counts.groupBy(bucket_col("word", buckets).cast("int").alias("k")).agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect()
    return Vocabulary([bytes(r["word"]) for r in top], [r["c"] for r in top], total, distinct, {r["k"]: (r["n"], r["v"]) for r in classes}, symbols, buckets)


class Lexicon:
    """A vocabulary as arrays, to look up all words of many texts at once."""

    def __init__(self, vocab: Vocabulary):
        self.vocab, self.words = vocab, pa.array(vocab.words, pa.binary())
        self.symbol = np.concatenate([np.arange(vocab.symbols), self._classes(self.words.slice(vocab.symbols)), [0]]).astype(np.int32)
        self.end = self.words.index(pa.scalar(END, pa.binary())).as_py() % (len(vocab.words) + 1)  # the last, if it is none of them

    def _classes(self, words: pa.Array) -> np.ndarray:
        tails = pc.binary_slice(words, -3).dictionary_encode()
        return self.vocab.code(tails.dictionary.to_pylist(), {})[tails.indices.to_numpy()]

    def read(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, pa.Array]:
        """Of the texts' tokens: where each text begins, places in the vocabulary (its size for other words), symbols, and
        of the other words: the numbers of their texts, and the words."""
        words, n = split(texts)
        begin, none = np.append(0, np.cumsum(n + 1)), len(self.words)
        place = np.full(begin[-1], self.end, np.int32)
        place[np.arange(len(words)) + np.repeat(np.arange(len(n)), n)] = pc.fill_null(pc.index_in(words, value_set=self.words), none).to_numpy()
        symbols = self.symbol[place]
        miss = np.flatnonzero(place == none)
        text = np.searchsorted(begin, miss, "right") - 1
        at = np.where(miss + 1 == begin[text + 1], len(words), miss - text)  # an end stands after each text before
        others = pa.concat_arrays([words, pa.array([END])]).take(pa.array(at))
        symbols[miss] = self._classes(others)
        return begin[:-1], place, symbols, text, others


def contexts(symbols: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The word before each token and the one before that; the end stands before a text's first word, twice."""
    h1, h2 = np.roll(symbols, 1), np.roll(symbols, 2)  # before a text stands the end of another
    h2[begin] = symbols[-1:]
    return h1, h2


class Model:
    """One row of parameters for each symbol as word before (A1), as second word before (A2) and as word (Q), and for each
    group (R); the last column is the bias of words and groups."""

    def __init__(self, rows: np.ndarray, size: int):
        self.rows, self.size = rows, size
        self.a1, self.a2, self.q, self.r = (rows[k * size : (k + 1) * size] if k < 3 else rows[3 * size :] for k in range(4))

    @classmethod
    def start(cls, unigram: np.ndarray, dim: int = DIM, seed: int = 13) -> Model:
        size = len(unigram)
        group = unigram.reshape(-1, GROUPS).sum(axis=0)
        rows = np.random.default_rng(seed).normal(0, 0.1, (3 * size + GROUPS, dim + 1)).astype(np.float32)
        rows[: 2 * size, dim] = 0
        with np.errstate(divide="ignore", invalid="ignore"):
            rows[2 * size : 3 * size, dim] = np.where(unigram > 0, np.log(unigram / np.tile(group, size // GROUPS)), -np.inf)
            rows[3 * size :, dim] = np.log(group)
        return cls(rows, size)

    def log_probabilities(self, h1: np.ndarray, h2: np.ndarray, w: np.ndarray) -> np.ndarray:
        """Natural logarithms of the probability of each w after its context."""
        g, slot = w % GROUPS, w // GROUPS
        order = _order(g, GROUPS)
        h1, h2, g, slot = h1[order], h2[order], g[order], slot[order]
        p = self._groups(h1, h2, g)
        words = np.ascontiguousarray(self.q.reshape(-1, GROUPS, self.q.shape[1]).transpose(1, 2, 0))  # per group, columns of its symbols
        edge = np.searchsorted(g, np.arange(GROUPS + 1)).tolist()
        for x, first, last in zip(words, edge, edge[1:]):
            for s in range(first, last, ROWS):
                e = min(s + ROWS, last)
                a = self.a1.take(h1[s:e], axis=0) + self.a2.take(h2[s:e], axis=0)
                a[:, -1] = 1  # so that products add the bias
                p[s:e] += _log_softmax(a @ x, slot[s:e])
        out = np.empty(len(w), np.float64)
        out[order] = p
        return out

    def _groups(self, h1: np.ndarray, h2: np.ndarray, g: np.ndarray) -> np.ndarray:
        """Logarithms of the groups' probabilities. A group's score is the sum of what either word gives, so its exponential
        is the product of two that are computed once for each symbol."""
        u1, u2 = self.a1[:, :-1] @ self.r[:, :-1].T, self.a2[:, :-1] @ self.r[:, :-1].T + self.r[:, -1]
        u1 -= u1.max(axis=1, keepdims=True)
        u2 -= u2.max(axis=1, keepdims=True)
        e1, e2 = np.exp(u1), np.exp(u2)
        out = np.empty(len(g), np.float64)
        for s in range(0, len(g), ROWS):
            x, y, z = h1[s : s + ROWS], h2[s : s + ROWS], g[s : s + ROWS]
            total = np.einsum("ij,ij->i", e1.take(x, axis=0), e2.take(y, axis=0))
            own = u1.take(x * GROUPS + z) + u2.take(y * GROUPS + z) - np.log(np.maximum(total, 1e-30))
            odd = np.flatnonzero(~(total > 1e-30))  # where the products are too small for floats of this size
            if len(odd):
                own[odd] = _log_softmax(u1[x[odd]] + u2[y[odd]], z[odd])
            out[s : s + ROWS] = own
        return out


def _order(keys: np.ndarray, limit: int) -> np.ndarray:
    """A stable order of keys below ``limit``; small ones are dealt by their digits."""
    return np.argsort(keys.astype(np.uint16) if limit <= 1 << 16 else keys, kind="stable")


def _log_softmax(s: np.ndarray, pick: np.ndarray) -> np.ndarray:
    own = s[np.arange(len(s)), pick]
    with np.errstate(over="ignore"):
        total = np.exp(s) @ np.ones(s.shape[1], s.dtype)
    odd = ~((total > 1e-30) & (total < 1e30))
    if odd.any():  # outside of what floats of this size hold well
        top = s[odd].max(axis=1)
        own[odd] -= top
        total[odd] = np.exp(s[odd] - top[:, None]).sum(axis=1)
    return own - np.log(total)


class Trainer:
    """Adagrad steps on noise-contrastive estimation; noise groups are shared by a batch, noise words by a group's pairs in it."""

    def __init__(self, model: Model, unigram: np.ndarray, seed: int, rate: float):
        self.m, self.rng, self.rate = Model(model.rows.copy(), model.size), np.random.default_rng(seed), rate
        self.sums = np.full(len(model.rows), 0.05, np.float32)
        self.met = np.zeros(len(model.rows), np.int64)
        by_group = unigram.reshape(-1, GROUPS).T
        group = by_group.sum(axis=1)
        self.groups = np.cumsum(group)
        self.words = np.cumsum(by_group.ravel())  # of one group after the other
        self.begin = np.append(0, self.words)[:-1].reshape(GROUPS, -1)[:, 0]
        self.mass = group
        with np.errstate(divide="ignore"):
            self.log_group = np.log(NOISE * group).astype(np.float32)
            self.log_word = np.log(NOISE * unigram / np.tile(group, len(unigram) // GROUPS)).astype(np.float32)

    def step(self, h1: np.ndarray, h2: np.ndarray, w: np.ndarray) -> None:
        m, size = self.m, self.m.size
        slots = size // GROUPS
        key = w % GROUPS * slots + w // GROUPS  # by group, and by word in it
        order = _order(key, size)
        h1, h2, w, key = h1[order], h2[order], w[order], key[order]
        each = np.bincount(w % GROUPS, minlength=GROUPS)
        there = np.flatnonzero(each)
        edge = np.append(0, np.cumsum(each[there])).tolist()
        begin = np.flatnonzero(np.append(True, np.diff(key) != 0))
        words, times = w[begin], np.diff(np.append(begin, len(w)))
        a = m.a1.take(h1, axis=0) + m.a2.take(h2, axis=0)
        a[:, -1] = 1  # so that products add the bias
        noise = np.minimum(np.searchsorted(self.groups, self.rng.random(NOISE) * self.groups[-1]), GROUPS - 1)
        drawn = self.begin[there][:, None] + self.rng.random((len(there), NOISE)) * self.mass[there][:, None]
        drawn = np.minimum(np.searchsorted(self.words, drawn), len(self.words) - 1)
        drawn = drawn % slots * GROUPS + drawn // slots
        q, rn = np.repeat(m.q.take(words, axis=0), times, axis=0), m.r[noise]
        good = _sigmoid(np.einsum("ij,ij->i", a, q) - self.log_word[w]) - 1
        bad = _sigmoid(a @ rn.T - self.log_group[noise])
        rows = np.concatenate([m.q[drawn], m.r[there][:, None]], axis=1)  # per group its noise words, and itself
        less = rows.copy()
        less[:, :-1, -1] -= self.log_word[drawn]
        less[:, -1, -1] -= self.log_group[there]
        x = np.empty((len(w), NOISE + 1), np.float32)
        for k, (s, e) in enumerate(zip(edge, edge[1:])):
            np.matmul(a[s:e], less[k].T, out=x[s:e])
        x = _sigmoid(x)
        x[:, -1] -= 1
        ga, against = bad @ rn, np.empty((len(there), NOISE + 1, a.shape[1]), np.float32)
        for k, (s, e) in enumerate(zip(edge, edge[1:])):
            ga[s:e] += x[s:e] @ rows[k]
            np.matmul(x[s:e].T, a[s:e], out=against[k])
        ga += np.multiply(q, good[:, None], out=q)
        ga[:, -1] = 0
        of_groups = np.zeros((GROUPS, a.shape[1]), np.float32)
        of_groups[there] = against[:, -1]
        np.add.at(of_groups, noise, bad.T @ a)
        each += np.bincount(noise, minlength=GROUPS)
        group = np.flatnonzero(each)
        a *= good[:, None]
        parts = [
            _summed(h1, ga, size),
            _summed(h2, ga, size),
            _summed(np.concatenate([w, drawn.ravel()]), np.concatenate([a, against[:, :-1].reshape(-1, a.shape[1])]), size),
            (group, of_groups[group], each[group]),
        ]
        used = np.concatenate([at + k * size for k, (at, _, _) in enumerate(parts)])
        grad = np.concatenate([x for _, x, _ in parts])
        sums = self.sums[used] + np.einsum("ij,ij->i", grad, grad) / grad.shape[1]
        self.sums[used] = sums
        grad *= (self.rate / np.sqrt(sums))[:, None]
        m.rows[used] = m.rows.take(used, axis=0) - grad
        self.met[used] += np.concatenate([n for _, _, n in parts])


def _summed(at: np.ndarray, rows: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The places met, the sums of their rows, and how often they were met."""
    order = _order(at, limit)
    at = at[order]
    first = np.flatnonzero(np.append(True, np.diff(at) != 0))
    met = np.diff(np.append(first, len(at)))
    out, many = rows.take(order[first], axis=0), met > 1  # most places are met once
    if many.any():
        begin = np.append(0, np.cumsum(met[many])[:-1])
        out[many] = np.add.reduceat(rows.take(order[np.repeat(many, met)], axis=0), begin, axis=0)
    return at[first].astype(np.int64), out, met


def _sigmoid(x: np.ndarray) -> np.ndarray:
    np.negative(x, out=x)
    with np.errstate(over="ignore"):
        np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


_COPY = pa.schema([("block", pa.int64()), ("task", pa.int64()), ("pairs", pa.int64()), ("met", pa.binary()), ("values", pa.binary())])
COPY = "block long, task long, pairs long, met binary, values binary"


def _train(batches: Iterator[pa.RecordBatch], model: Model, vocab: Vocabulary, seed: int, step: float) -> Iterator[pa.RecordBatch]:
    task, lexicon = TaskContext.get().partitionId(), None
    trainer, pairs, held, size = Trainer(model, vocab.unigram, seed * 1_000_003 + task, step), 0, [], 0

    def run(batch: int, least: int) -> None:
        nonlocal held, size, pairs
        every = [np.concatenate(x) for x in zip(*held)]
        order = trainer.rng.permutation(size)
        n = size // least * least
        for at in range(0, n, batch):
            trainer.step(*(x[order[at : min(at + batch, n)]] for x in every))
        pairs += n
        held, size = [tuple(x[order[n:]] for x in every)], size - n

    for b in batches:
        lexicon = lexicon or Lexicon(vocab)
        for _, own in _pieces(b.column(0), PIECE):
            begin, _, symbols, _, _ = lexicon.read(own)
            every, at = (*contexts(symbols, begin), symbols), 0
            for stop in [*begin[1:].tolist(), len(symbols)]:
                if size + stop - at >= 16 * BATCH or stop == len(symbols):
                    held.append(tuple(x[at:stop] for x in every))
                    at, size = stop, size + stop - at
                    if size >= 16 * BATCH:
                        run(BATCH, BATCH)
    if size:
        run(min(BATCH, max(LEAST, size // 64)), 1)
    if pairs:
        for k, own in enumerate(np.array_split(np.arange(len(model.rows)), BLOCKS)):
            yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip((k, task, pairs, trainer.met[own].tobytes(), trainer.m.rows[own].tobytes()), _COPY)], schema=_COPY)


def _average(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """Weighted means of the rows of each block; rows that no copy has met keep the value they began with."""
    sums: dict[tuple[int, int], list] = {}
    for b in batches:
        for k, task, pairs, met, values in zip(*(c.to_pylist() for c in b.columns)):
            n, x = np.frombuffer(met, np.int64), np.frombuffer(values, np.float32).reshape(-1, width).astype(np.float64)
            own = sums.setdefault((k, task), [0, np.zeros(len(n), np.int64), np.zeros_like(x), x])
            own[0] += pairs
            own[1] = own[1] + n
            own[2][n > 0] += n[n > 0, None] * x[n > 0]
    for (k, task), (pairs, n, total, x) in sums.items():
        x = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], x).astype(np.float32)
        yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip((k, task, pairs, n.tobytes(), x.tobytes()), _COPY)], schema=_COPY)


def _averaged(copies: DataFrame, width: int, task: Column, parts: int | None = None) -> DataFrame:
    keyed = copies.select("block", task.cast("long").alias("task"), "pairs", "met", "values")
    dealt = keyed.repartition(parts, "block", "task") if parts else keyed.repartition("block", "task")
    return dealt.sortWithinPartitions("block", "task", "pairs", "values").mapInArrow(partial(_average, width=width), COPY)


def train(docs: DataFrame, vocab: Vocabulary, rounds: int = ROUNDS) -> Model:
    """The averaged model of all tasks over the texts of docs; each is learned from in one of the rounds."""
    model = Model.start(vocab.unigram)
    width = model.rows.shape[1]
    for k in range(rounds):
        own = docs.where(F.pmod(F.xxhash64("text"), F.lit(rounds)) == k).select("text")
        copies = own.mapInArrow(partial(_train, model=model, vocab=vocab, seed=k, step=STEP / (1 + k)), COPY)
        near = _averaged(copies, width, F.floor(F.col("task") / NEIGHBOURS))
        blocks = _averaged(near, width, F.lit(0), BLOCKS).select("block", "values").collect()
        if blocks:
            rows = b"".join(bytes(r["values"]) for r in sorted(blocks, key=lambda r: r["block"]))
            model = Model(np.frombuffer(rows, np.float32).reshape(-1, width).copy(), model.size)
    return model


SCORED = "doc_id long, n_tokens long, known long, counts double, probability double, others array<binary>, times array<long>"


class Scorer:
    def __init__(self, vocab: Vocabulary, model: Model):
        self.vocab, self.model, self.lexicon = vocab, model, Lexicon(vocab)
        self.logs = np.append(np.log10(vocab.counts + 0.5), 0.0)
        self.start = int(self.lexicon.read(pa.array([""]))[2][0])

    def score(self, texts: pa.Array) -> list[pa.Array]:
        """Columns, per text: tokens, of them in the head, sum of the head's log10(c + 0.5), log10 probability without the others' counts, other words, and how often."""
        vocab = self.vocab
        begin, place, w, text, others = self.lexicon.read(texts)
        logs = self.logs[place]
        p = self.model.log_probabilities(*contexts(w, begin), w) * np.log10(np.e)
        rare = w >= vocab.symbols
        p[rare] += logs[rare] - vocab.log_bucket[w[rare] - vocab.symbols]
        known, counts, prob = (np.add.reduceat(x, begin) for x in ((place < len(vocab.words)).astype(np.int64), logs, p))
        others = others.dictionary_encode()
        pair, times = np.unique(text * max(1, len(others.dictionary)) + others.indices.to_numpy(), return_counts=True)
        text, word = np.divmod(pair, max(1, len(others.dictionary)))
        at = pa.array(np.searchsorted(text, np.arange(len(begin) + 1)), pa.int32())
        lists = [pa.ListArray.from_arrays(at, x) for x in (others.dictionary.take(pa.array(word)), pa.array(times, pa.int64()))]
        return [pa.array(np.diff(np.append(begin, len(w)))), pa.array(known), pa.array(counts), pa.array(prob), *lists]


def _score(batches: Iterator[pa.RecordBatch], vocab: Vocabulary, model: Model) -> Iterator[pa.RecordBatch]:
    scorer = None
    for b in batches:
        scorer = scorer or Scorer(vocab, model)
        for at, own in _pieces(b.column(1), PIECE):
            yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(own)), *scorer.score(own)], names=["doc_id", "n_tokens", "known", "counts", "probability", "others", "times"])


def score(docs: DataFrame, counts: DataFrame, vocab: Vocabulary, model: Model) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score per row of docs (doc_id, text)."""
    first = docs.select("doc_id", "text").mapInArrow(partial(_score, vocab=vocab, model=model), SCORED)
    first = materialize(first.withColumn("row", F.monotonically_increasing_id()), "scored")
    others = first.where(F.size("others") > 0).select("row", F.explode(F.arrays_zip("others", "times")).alias("x")).select("row", F.col("x.others").alias("word"), F.col("x.times").alias("n"))
    found = others.join(counts, "word", "left").select("row", "n", F.coalesce("c", F.lit(0)).alias("c"))
    found = found.groupBy("row").agg(F.sum(F.col("n") * F.log10(F.col("c") + 0.5)).alias("logs"), F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("more"))
    d = first.drop("others", "times").join(found, "row", "left")
    logs = F.coalesce("logs", F.lit(0.0))
    return d.select(
        "doc_id",
        "n_tokens",
        (F.col("known") + F.coalesce("more", F.lit(0))).cast("long").alias("n_known"),
        F.lit(vocab.total).cast("long").alias("train_tokens"),
        (F.col("counts") + logs - F.col("n_tokens") * F.lit(float(vocab.log_all))).alias("base_score"),
        (F.col("probability") + logs).alias("score"),
    )


def op1_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents by the model of those outside of the held-out fold."""
    docs = texts(table(spark, sf_dir, "documents"))
    learn = docs.where(fold_col() != 1)
    counts = count(learn)
    vocab = vocabulary(counts)
    scored = score(docs, counts, vocab, train(learn, vocab))
    return scored.select("doc_id", (fold_col() == 1).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
