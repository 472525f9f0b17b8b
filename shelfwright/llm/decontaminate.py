"""Benchmark decontamination by an FM-index per training shard.

The phrases are the windows of ``width`` consecutive words of the benchmark items (a shorter item is one window). A shard
is what one task has read of the documents, in pieces of ``SHARD`` symbols. Words that occur in no phrase cannot be part
of an occurrence, so the shard's text is the runs of phrase words that are as long as the shortest phrase at least, each
closed by a separator. Over it stand the suffix array (prefix doubling; separators differ, so no comparison leaves a
run), its Burrows-Wheeler transform in a wavelet matrix, and samples of the suffix positions at every ``STEP``-th symbol
and at the start of each run. All phrases are searched backwards together; the rows of those found are walked back to a
sampled position, and the occurrences are merged into hit words.

The benchmark is sent to the tasks in blocks of ``BLOCK_BYTES`` at most, and each worker builds a block's phrases once, in
arrays; more than one block gives one pass each, whose spans are merged per document.

Defined cases: null or wordless texts of documents give zero counts, such items are no phrases; items with a null id
mark words but are not listed; items that repeat are found alike; repeated document rows are judged each; with an empty
benchmark nothing is hit.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator
from functools import partial
from itertools import repeat

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, table

#: Lower-cases A-Z and turns every ASCII byte that is no letter or digit into a space.
WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
SHARD, STEP, BLOCK_BYTES = 1 << 20, 16, 16 << 20

OUT = "row long, doc_id long, n_words long, starts array<long>, ends array<long>, items array<string>"
_OUT = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("n_words", pa.int64()), ("starts", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64())), ("items", pa.list_(pa.string()))])


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(WORDS).split()


class Phrases:
    """The distinct windows of a block of items, coded by the block's vocabulary (from 1), in arrays."""

    def __init__(self, items: list[tuple[str | None, str | None]], width: int):
        self.vocabulary: dict[bytes, int] = {}
        code = lambda w: self.vocabulary.setdefault(w, len(self.vocabulary) + 1)
        own = [np.fromiter(map(code, w), np.int32, len(w)) for _, t in items if (w := words(t))]
        names = [i for i, t in items if words(t)]
        self.items = sorted({i for i in names if i is not None})
        number = {x: k for k, x in enumerate(self.items)}
        size = np.array([len(x) for x in own], np.int64)
        flat = np.concatenate([*own, np.zeros(width, np.int32)])
        begin, n = np.cumsum(size) - size, np.maximum(1, size - width + 1)
        item = np.repeat(np.arange(len(own)), n)
        start = np.repeat(begin, n) + np.arange(len(item)) - np.repeat(np.cumsum(n) - n, n)
        window = np.lib.stride_tricks.sliding_window_view(flat, width)[start]
        length = np.minimum(width, size)[item]
        window[np.arange(width) >= length[:, None]] = 0
        window = np.ascontiguousarray(window)
        _, first, which = np.unique(window.view(f"V{4 * width}").ravel(), return_index=True, return_inverse=True)
        self.codes, self.lengths = window[first].astype(np.int64), length[first]
        self.shortest = int(self.lengths.min(initial=width)) if len(first) else 0
        # the items of each window, as runs of one array
        named = np.array([number.get(i, -1) for i in names], np.int64)[item]
        pair = np.unique(which[named >= 0] * max(1, len(self.items)) + named[named >= 0])
        self.item_of = (pair % max(1, len(self.items))).astype(np.int32)
        self.item_edge = np.searchsorted(pair // max(1, len(self.items)), np.arange(len(first) + 1))

    def items_of(self, owner: np.ndarray, which: np.ndarray, docs: int) -> list[list[str]]:
        """Per document the sorted ids of the items of the windows found in it."""
        pair = np.unique(owner * max(1, len(self.lengths)) + which)
        owner, which = pair // max(1, len(self.lengths)), pair % max(1, len(self.lengths))
        n = self.item_edge[which + 1] - self.item_edge[which]
        at = np.repeat(self.item_edge[which] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        pair = np.unique(np.repeat(owner, n) * max(1, len(self.items)) + self.item_of[at])
        out: list[list[str]] = [[] for _ in range(docs)]
        for d, k in zip((pair // max(1, len(self.items))).tolist(), (pair % max(1, len(self.items))).tolist()):
            out[d].append(self.items[k])
        return out


_PHRASES: dict[tuple[bytes, int], Phrases] = {}


def phrases_of(block: bytes, width: int) -> Phrases:
    """The worker's phrases of a packed block of items; others make room first."""
    key = (hashlib.sha256(block).digest(), width)
    if key not in _PHRASES:
        _PHRASES.clear()
        _PHRASES[key] = Phrases(pickle.loads(zstandard.ZstdDecompressor().decompress(block)), width)
    return _PHRASES[key]


def suffix_array(text: np.ndarray, longest: int) -> np.ndarray:
    """Of ``text``, whose separators (0) count as distinct and smaller than all else; runs have ``longest`` symbols at most."""
    zero = text == 0
    rank = np.where(zero, np.cumsum(zero) - 1, text + zero.sum()).astype(np.int64)
    n, k = len(text), 1
    while True:
        new = np.empty(n, np.int64)
        nxt = np.append(rank[k:], np.zeros(min(k, n), np.int64))[:n] + 1
        key = rank * (int(rank.max()) + 2) + np.where(zero, 0, nxt)
        order = np.argsort(key, kind="stable")
        new[order] = np.append(0, np.cumsum(np.diff(key[order]) != 0))
        rank = new
        k *= 2
        if rank[order[-1]] == n - 1 or k > 2 * longest + 2:
            return order


class WaveletMatrix:
    def __init__(self, symbols: np.ndarray, top: int):
        self.levels, self.zeros = [], []
        for shift in range(max(1, int(top).bit_length()) - 1, -1, -1):
            bit = (symbols >> shift & 1).astype(np.uint8)
            packed = np.packbits(np.append(bit, np.zeros(128 - len(bit) % 64, np.uint8)), bitorder="little").view(np.uint64)
            ones = np.append(0, np.cumsum(np.bitwise_count(packed), dtype=np.int64))[:-1]
            self.levels.append((shift, packed, ones))
            self.zeros.append(len(bit) - int(bit.sum()))
            symbols = np.concatenate([symbols[bit == 0], symbols[bit == 1]])

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often c occurs before position i, elementwise."""
        p = np.zeros(len(i), np.int64)
        for (shift, packed, ones), zeros in zip(self.levels, self.zeros):
            up = (c >> shift & 1).astype(bool)
            at = []
            for x in (p, i):
                r = ones[x >> 6] + np.bitwise_count(packed[x >> 6] & ((np.uint64(1) << (x & 63).astype(np.uint64)) - np.uint64(1)))
                at.append(np.where(up, zeros + r, x - r))
            p, i = at
        return i - p


class Index:
    """FM-index of runs of symbols, each closed by 0."""

    def __init__(self, text: np.ndarray, longest: int):
        sa = suffix_array(text, longest)
        self.bwt = text[sa - 1]
        top = int(text.max(initial=0))
        self.before = np.append(0, np.cumsum(np.bincount(text, minlength=top + 1)))
        self.tree = WaveletMatrix(self.bwt, top)
        sampled = (sa % STEP == 0) | (self.bwt == 0)
        self.sampled, self.samples = np.append(0, np.cumsum(sampled)), sa[sampled]
        self.is_sample = sampled

    def search(self, codes: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The phrases that occur, and the rows [lo, hi) of their suffixes."""
        live, n = np.arange(len(lengths)), len(self.bwt)
        lo, hi = np.zeros(len(live), np.int64), np.full(len(live), n, np.int64)
        out: list[tuple] = []
        for step in range(int(lengths.max(initial=0))):
            c = codes[live, lengths[live] - 1 - step]
            ok = c < len(self.before) - 1
            live, c, lo, hi = live[ok], c[ok], lo[ok], hi[ok]
            lo, hi = self.before[c] + self.tree.rank(c, lo), self.before[c] + self.tree.rank(c, hi)
            ok = lo < hi
            live, lo, hi = live[ok], lo[ok], hi[ok]
            over = lengths[live] == step + 1
            out.append((live[over], lo[over], hi[over]))
            live, lo, hi = live[~over], lo[~over], hi[~over]
        return tuple(np.concatenate(x) for x in zip(*out)) if out else (live, lo, hi)

    def locate(self, row: np.ndarray) -> np.ndarray:
        """Text positions of suffix rows."""
        at, steps, todo, row = np.zeros(len(row), np.int64), 0, np.arange(len(row)), row.copy()
        while len(todo):
            here = self.is_sample[row]
            at[todo[here]] = self.samples[self.sampled[row[here]]] + steps
            todo, row, steps = todo[~here], row[~here], steps + 1
            c = self.bwt[row]
            row = self.before[c] + self.tree.rank(c, row)
        return at


def find(text: np.ndarray, longest: int, phrases: Phrases) -> tuple[np.ndarray, np.ndarray]:
    """Phrase and position of every occurrence in runs closed by 0."""
    index = Index(text, longest)
    which, lo, hi = index.search(phrases.codes, phrases.lengths)
    n = hi - lo
    row = np.repeat(lo - np.append(0, np.cumsum(n)[:-1]), n) + np.arange(int(n.sum()))
    return np.repeat(which, n), index.locate(row)


def _scan(batches: Iterator[pa.RecordBatch], block: bytes, width: int) -> Iterator[pa.RecordBatch]:
    phrases = phrases_of(block, width)
    docs: list[tuple] = []  # row, doc_id, n_words
    runs: list[tuple[int, int, np.ndarray]] = []  # document in docs, first word, symbols
    size = 0

    def flush() -> pa.RecordBatch:
        starts, ends, found = [[] for _ in docs], [[] for _ in docs], [[] for _ in docs]
        if runs:
            text = np.concatenate([x for _, _, c in runs for x in (c, np.zeros(1, np.int64))])
            begin = np.append(0, np.cumsum([len(c) + 1 for *_, c in runs]))
            which, at = find(text, max(len(c) for *_, c in runs), phrases)
            cover = np.zeros(len(text) + 1, np.int64)
            np.add.at(cover, at, 1)
            np.add.at(cover, at + phrases.lengths[which], -1)
            edge = np.diff(np.append(0, np.cumsum(cover) > 0).astype(np.int8))
            for s, e in zip(np.flatnonzero(edge > 0).tolist(), np.flatnonzero(edge < 0).tolist()):
                k = int(np.searchsorted(begin, s, "right")) - 1
                d, first, _ = runs[k]
                starts[d].append(first + s - int(begin[k]))
                ends[d].append(first + e - int(begin[k]))
            owner = np.array([d for d, *_ in runs], np.int64)[np.searchsorted(begin, at, "right") - 1]
            found = phrases.items_of(owner, which, len(docs))
        cols = [*map(list, zip(*docs)), starts, ends, found]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _OUT)], schema=_OUT)

    for b in batches:
        for row, doc_id, text in zip(*(c.to_pylist() for c in b.columns)):
            w = words(text)
            if phrases.shortest:
                code = np.fromiter(map(phrases.vocabulary.get, w, repeat(0)), np.int64, len(w))
                edge = np.flatnonzero(np.diff(np.concatenate([[0], code > 0, [0]]).astype(np.int8)))
                for s, e in edge.reshape(-1, 2)[edge[1::2] - edge[::2] >= phrases.shortest].tolist():
                    runs.append((len(docs), s, code[s:e]))
                    size += e - s + 1
            docs.append((row, doc_id, len(w)))
            if size >= SHARD or len(docs) >= 1 << 16:
                yield flush()
                docs, runs, size = [], [], 0
    if docs:
        yield flush()


def _merge(spans: list) -> tuple[list[int], list[int]]:
    starts, ends = [], []
    for s, e in sorted(spans):
        if ends and s <= ends[-1]:
            ends[-1] = max(ends[-1], e)
        else:
            starts.append(s)
            ends.append(e)
    return starts, ends


def _merge_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = []
        for row, doc_id, n, starts, ends, items in zip(*(c.to_pylist() for c in b.columns)):
            s, e = _merge([x for p, q in zip(starts, ends) for x in zip(p, q)])
            out.append((row, doc_id, n, s, e, sorted(set().union(*items))))
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out) if out else [[]] * 6, _OUT)], schema=_OUT)


def _keep(batches: Iterator[pa.RecordBatch], block: bytes, width: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        number = pa.array(np.arange(b.num_rows))
        own = pa.RecordBatch.from_arrays([number, number, b.column(b.schema.get_field_index("text"))], names=["row", "doc_id", "text"])
        yield b.filter(pa.array([not s for x in _scan(iter([own]), block, width) for s in x.column(3).to_pylist()], pa.bool_()))


def _items(benchmark: DataFrame, block_bytes: int) -> tuple[DataFrame, int]:
    """The items that have text, and how many blocks of about ``block_bytes`` they make."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").where("text is not null")
    total = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    return items, int(max(1, -(-total // block_bytes)))


def _block(items: DataFrame, n: int, k: int) -> bytes:
    """The items of a block, packed."""
    own = items if n == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)
    return zstandard.ZstdCompressor(level=3).compress(pickle.dumps(sorted(map(tuple, own.collect()), key=lambda r: (r[0] is not None, r))))


def keep_clean(docs: DataFrame, benchmark: DataFrame, width: int = 10, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of docs, with all their columns, in which no phrase occurs."""
    items, n = _items(benchmark, block_bytes)
    for k in range(n):
        docs = docs.mapInArrow(partial(_keep, block=_block(items, n, k), width=width), docs.schema)
        if k < n - 1:  # so that one block at a time is held
            docs = materialize(docs, "clean")
    return docs


def hits(docs: DataFrame, benchmark: DataFrame, width: int = 10, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per row of docs: row, doc_id, n_words, the merged spans of hit words (starts, ends), and the ids of the items found."""
    items, n = _items(benchmark, block_bytes)
    row = F.monotonically_increasing_id() if n > 1 else F.lit(0).cast("long")
    source = docs.select(row.alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    if n == 1:
        return source.mapInArrow(partial(_scan, block=_block(items, 1, 0), width=width), OUT)
    source, parts = materialize(source, "rows"), None
    for k in range(n):
        part = materialize(source.mapInArrow(partial(_scan, block=_block(items, n, k), width=width), OUT), "hits")
        parts = part if parts is None else parts.union(part)
    grouped = parts.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), *(F.collect_list(c).alias(c) for c in ("starts", "ends", "items")))
    return grouped.mapInArrow(_merge_blocks, OUT)


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        _, doc_id, n, starts, ends, items = (c.to_pylist() for c in b.columns)
        hit = [sum(e) - sum(s) for s, e in zip(starts, ends)]
        sha = [hashlib.sha256(",".join(x).encode()).hexdigest() for x in items]
        yield pa.RecordBatch.from_pydict({"doc_id": pa.array(doc_id, pa.int64()), "n_words": pa.array(n, pa.int64()), "n_hit": pa.array(hit, pa.int64()), "n_items": pa.array([len(x) for x in items], pa.int64()), "items_sha256": pa.array(sha, pa.string()), "contaminated": pa.array([x > 0 for x in hit], pa.bool_())})


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hit words and items of all documents, for all items."""
    found = hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.mapInArrow(_digest, "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean")


OP4_SQL = r"""
WITH w AS (
  SELECT row_number() OVER () AS row, doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents
), b AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL
), phrases AS (
  SELECT DISTINCT item, least(10, len(w)) AS n, array_to_string(w[k : k + least(10, len(w)) - 1], ' ') AS phrase FROM (SELECT *, unnest(generate_series(1, greatest(1, len(w) - 9))) AS k FROM b WHERE len(w) > 0)
), windows AS (
  SELECT row, n, k, array_to_string(w[k : k + n - 1], ' ') AS phrase FROM (SELECT row, w, n, unnest(generate_series(1, len(w) - n + 1)) AS k FROM w, (SELECT DISTINCT n FROM phrases) WHERE len(w) >= n)
), found AS (
  SELECT row, windows.n, k, item FROM windows JOIN phrases ON windows.n = phrases.n AND windows.phrase = phrases.phrase
), hit AS (
  SELECT row, count(DISTINCT p) AS n_hit FROM (SELECT row, unnest(generate_series(k, k + n - 1)) AS p FROM (SELECT DISTINCT row, n, k FROM found)) GROUP BY 1
), items AS (
  SELECT row, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS ids FROM found GROUP BY 1
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN hit USING (row) LEFT JOIN items USING (row)
"""
