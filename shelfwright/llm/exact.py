"""Removal of repeated strings of ``width`` bytes by suffix arrays over shards that keep equal strings together.

Every window of ``width`` bytes has a least hash among its grams of ``gram`` bytes (its minimizer), and equal windows have
equal ones. Runs of windows with one minimizer form a piece of text, and pieces meet by minimizer:

1. Texts are put in blocks of about ``BLOCK`` bytes. Each block reports its distinct minimizers to shards by hash, and
   gets back which of them another document has too, one bit each.
2. Each block cuts its documents into pieces, keeps those whose minimizer is shared, each distinct one once with its
   smallest and largest document, and sends them to tasks by minimizer.
3. Each task works through its pieces in shards by minimizer. What only one document can have is left out: windows of a
   piece of one document whose hash comes once. The suffixes of the others are sorted by induced sorting, and their
   permuted common prefixes computed; neighbours that agree in ``width`` bytes are equal windows, and their smallest
   document is theirs. What concerns a block goes back to it, one row for each task.
4. Each block marks the bytes of its documents that a window with a smaller document covers, and takes them out.

A text, passage or line in very many documents is reported once per block, so no key gathers rows in proportion to its
documents; equal pieces are put together before sorting, by their bytes. A minimizer that more than ``HOT`` blocks report is
split further by a second hash of the window's grams, and so are, in a shard, pieces of one minimizer that hold more text
than one suffix array takes.

Equal windows have their minimizer's gram at one distance. So a piece goes into the array as what stands before that gram
and one symbol, the name in order of what follows from there on; pieces that have the gram more than once, and all others of
its minimizer, go in whole.

Defined cases: null texts are empty; ties, equal texts with one id included, remove nothing from each other; a null doc_id counts as smaller than all; rows that repeat a doc_id are no smaller
documents to each other; texts shorter than ``width`` bytes lose nothing; an empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial
from itertools import pairwise

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, materialize, table, texts
from .suffix import permuted_prefixes, suffix_array

WIDTH, GRAM = 50, 16
BLOCK, SHARD, TEXT, HOT = 4 << 20, 4 << 20, 1 << 20, 64
#: What one task takes at most of minimizers and of pieces, and at least, while there are fewer tasks than ``TASKS``. Rows
#: between blocks and tasks are as many as the tasks, so tasks are large; they work through pieces a shard at a time.
HASHES, FEW_HASHES, PART, FEW, TASKS = 4_000_000, 1_000_000, 48 << 20, 2 << 20, 96
#: Found runs that a task holds before it sends them.
FOUND_AT_ONCE = 1 << 21
NULL_ID = -(1 << 63)
#: Places of repeated windows that are looked at together.
AT_ONCE = 1 << 18

BLOCKS = "block long, n long, ids binary, sizes binary, text binary"
_BLOCKS = pa.schema([("block", pa.int64()), ("n", pa.int64()), ("ids", pa.binary()), ("sizes", pa.binary()), ("text", pa.binary())])


_ZSTD = zstandard.ZstdCompressor(level=1)


def _zip(x: np.ndarray | bytes) -> bytes:
    return _ZSTD.compress(x if isinstance(x, bytes) else np.ascontiguousarray(x).tobytes())


def _unzip(x: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(x), kind)


def _tight(x: np.ndarray) -> bytes:
    """Integers that mostly repeat or rise slowly, as compressed differences, byte by byte."""
    d = np.diff(x.astype(np.int64), prepend=0)
    return _zip(d.view(np.uint8).reshape(-1, 8).T)


def _loose(x: bytes) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(_unzip(x, np.uint8).reshape(8, -1).T).view(np.int64).ravel())


def _batch(schema: pa.Schema, *values) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, schema)], schema=schema)


def _collect(batches: Iterator[pa.RecordBatch], block: int) -> Iterator[pa.RecordBatch]:
    number, ids, parts, size = TaskContext.get().partitionId() << 32, [], [], 0

    def done() -> pa.RecordBatch:
        return _batch(_BLOCKS, number, size, np.array(ids, np.int64).tobytes(), np.array(list(map(len, parts)), np.int64).tobytes(), _zip(b"".join(parts)))

    for b in batches:
        for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            ids.append(NULL_ID if doc_id is None else doc_id)
            parts.append(text.encode("utf-8", "surrogatepass"))
            size += len(parts[-1])
            if size >= block or len(ids) >= 1 << 16:
                yield done()
                number, ids, parts, size = number + 1, [], [], 0
    if ids:
        yield done()


_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]
_CHUNK = 1 << 16


def minimizers(text: np.ndarray, width: int, gram: int, second: bool = False) -> np.ndarray:
    """The least gram hash (48 bits) of the window at each position, over all of ``text`` as one string."""
    n, grams = len(text) - width + 1, width - gram + 1
    out = np.empty(max(0, n), np.uint64)
    for at in range(0, n, _CHUNK):
        h, k = text[at : min(at + _CHUNK, n) + width - 1].astype(np.uint64) + np.uint64(1), 1
        m = None  # hash of the parts of the gram so far, which is cut by the bits of its length
        done = 0
        while k <= gram:
            if gram & k:
                m = h if m is None else m[: len(h) - done] * _ODD[4] + h[done:]
                done += k
            if k * 2 <= gram:
                h = h[:-k] * _ODD[k.bit_length() % 4] + h[k:]
            k *= 2
        m = m[: len(m)]
        m = m * (_ODD[5] if second else _ODD[4])
        m ^= m >> np.uint64(32)
        m *= _ODD[0]
        m >>= np.uint64(16)
        k = 1
        while k * 2 <= grams:
            m = np.minimum(m[:-k], m[k:])
            k *= 2
        if grams > k:
            m = np.minimum(m[: len(m) - (grams - k)], m[grams - k :])
        out[at : at + _CHUNK] = m[: min(_CHUNK, n - at)]
    return out


class Block:
    """The documents of a block as one string, and its runs of windows with one minimizer."""

    def __init__(self, ids: bytes, sizes: bytes, text: bytes, width: int, gram: int):
        self.ids, self.sizes = np.frombuffer(ids, np.int64), np.frombuffer(sizes, np.int64)
        self.text, self.width, self.gram = _unzip(text, np.uint8), width, gram
        self.begin = np.cumsum(self.sizes) - self.sizes
        self.least = minimizers(self.text, width, gram)
        self.doc = np.repeat(np.arange(len(self.ids), dtype=np.int32), self.sizes)
        inside = np.zeros(len(self.least), bool)
        if len(inside):
            last = self.doc[width - 1 :]
            inside = self.doc[: len(last)] == last
        self.inside = inside
        self._cut(self.least)

    def _cut(self, key: np.ndarray) -> None:
        if not len(key):
            self.start = self.stop = np.zeros(0, np.int64)
        else:
            doc = self.doc[: len(key)]
            new = np.append(True, (key[1:] != key[:-1]) | (doc[1:] != doc[:-1]) | (self.inside[1:] != self.inside[:-1]))
            start = np.flatnonzero(new)
            stop = np.append(start[1:], len(key))
            ok = self.inside[start]
            self.start, self.stop = start[ok], stop[ok]
        self.key = key[self.start]

    def distinct(self) -> tuple[np.ndarray, np.ndarray]:
        """Minimizers, sorted, and whether two documents of the block have them."""
        value, back = np.unique(self.key, return_inverse=True)
        owner = self.ids[self.doc[self.start]]
        lo, hi = np.full(len(value), np.iinfo(np.int64).max), np.full(len(value), np.iinfo(np.int64).min)
        np.minimum.at(lo, back, owner)
        np.maximum.at(hi, back, owner)
        return value, lo < hi

    def split(self, hot: np.ndarray) -> None:
        """Cuts the runs of hot minimizers (sorted) further, by a second hash, a stretch of text at a time."""
        for at in range(0, len(self.least), _CHUNK):
            part = self.least[at : at + _CHUNK]
            hit = hot[np.minimum(np.searchsorted(hot, part), len(hot) - 1)] == part
            if hit.any():
                other = minimizers(self.text[at : at + len(part) + self.width - 1], self.width, self.gram, second=True)
                part[hit] = part[hit] * _ODD[1] ^ other[hit]
        self._cut(self.least)


def _share(key: np.ndarray, shards: int) -> np.ndarray:
    return ((key * _ODD[2]) >> np.uint64(33)).astype(np.int64) % shards


def _by_value(x: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each value and the places where it stands, both ascending."""
    order = np.argsort(x.astype(np.uint16) if len(x) and x.max() < 1 << 16 else x, kind="stable")
    for own in np.split(order, np.flatnonzero(np.diff(x[order])) + 1) if len(x) else []:
        yield int(x[own[0]]), own


_REPORT = pa.schema([("shard", pa.int32()), ("block", pa.int64()), ("hashes", pa.binary()), ("several", pa.binary())])
REPORT = "shard int, block long, hashes binary, several binary"


def _report(batches: Iterator[pa.RecordBatch], shards: int, width: int, gram: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for block, _, ids, sizes, text in zip(*(c.to_pylist() for c in b.columns)):
            value, several = Block(ids, sizes, text, width, gram).distinct()
            for s, own in _by_value(_share(value, shards)):
                # 6 of the 8 bytes hold the 48 bits
                six = value[own].view(np.uint8).reshape(-1, 8)[:, :6]
                yield _batch(_REPORT, s, block, six.tobytes(), np.packbits(several[own]).tobytes())


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """The rows of each run of one value of the first column."""
    held: list[tuple] = []
    for b in batches:
        for row in zip(*(c.to_pylist() for c in b.columns)):
            if held and held[0][0] != row[0]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


_ANSWER = pa.schema([("block", pa.int64()), ("shard", pa.int32()), ("shared", pa.binary()), ("hot", pa.binary())])
ANSWER = "block long, shard int, shared binary, hot binary"


def _answer(batches: Iterator[pa.RecordBatch], hot: int) -> Iterator[pa.RecordBatch]:
    for rows in _groups(batches):
        values = []
        for _, _, six, _ in rows:
            x = np.zeros((len(six) // 6, 8), np.uint8)
            x[:, :6] = np.frombuffer(six, np.uint8).reshape(-1, 6)
            values.append(x.view(np.uint64).ravel())
        several = np.concatenate([np.unpackbits(np.frombuffer(r[3], np.uint8), count=len(v)) for r, v in zip(rows, values)])
        every = np.concatenate(values)
        _, back, n = np.unique(every, return_inverse=True, return_counts=True)
        some = np.bincount(back, several, len(n)) > 0
        shared, many = ((n > 1) | some)[back], (n > hot)[back]
        at = 0
        for (shard, block, _, _), v in zip(rows, values):
            yield _batch(_ANSWER, block, shard, np.packbits(shared[at : at + len(v)]).tobytes(), np.packbits(many[at : at + len(v)]).tobytes())
            at += len(v)


_CUT = pa.schema([("block", pa.int64()), ("shard", pa.int32()), ("number", pa.binary()), ("sizes", pa.binary()), ("text", pa.binary()), ("low", pa.binary()), ("high", pa.binary()), ("doc", pa.binary()), ("start", pa.binary())])
CUT = "block long, shard int, number binary, sizes binary, text binary, low binary, high binary, doc binary, start binary"


def _pieces(batches: Iterator[pa.RecordBatch], shards: int, ask: int, width: int, gram: int) -> Iterator[pa.RecordBatch]:
    """Per block one row for itself (shard -1: the pieces' numbers, documents and positions) and one for each shard that gets
    pieces: their numbers, sizes and text, and their smallest and largest documents in the block."""
    for b in batches:
        for block, _, ids, sizes, text, answers in zip(*(c.to_pylist() for c in b.columns)):
            x = Block(ids, sizes, text, width, gram)
            value, _ = x.distinct()
            to, shared, hot = dict(_by_value(_share(value, ask))), np.zeros(len(value), bool), np.zeros(len(value), bool)
            for a in answers or []:
                own = to[a["shard"]]
                shared[own] = np.unpackbits(np.frombuffer(a["shared"], np.uint8), count=len(own))
                hot[own] = np.unpackbits(np.frombuffer(a["hot"], np.uint8), count=len(own))
            shared, hot = value[shared], value[hot & shared]
            whole, least = x.start, x.key
            if len(hot):
                x.split(hot)
            base = least[np.searchsorted(whole, x.start, "right") - 1]
            run = np.flatnonzero(np.isin(base, shared))
            start, stop, key = x.start[run], x.stop[run] + width - 1, x.key[run]
            doc = x.doc[start]
            raw, index, number = x.text.tobytes(), {}, np.empty(len(run), np.int32)
            for k, (s, e) in enumerate(zip(start.tolist(), stop.tolist())):
                number[k] = index.setdefault(raw[s:e], len(index))
            yield _batch(_CUT, block, -1, _tight(number), b"", b"", b"", b"", _tight(doc), _tight(start))
            if not index:
                continue
            lo, hi = np.full(len(index), np.iinfo(np.int64).max), np.full(len(index), np.iinfo(np.int64).min)
            np.minimum.at(lo, number, x.ids[doc])
            np.maximum.at(hi, number, x.ids[doc])
            own = np.empty(len(index), np.uint64)
            own[number] = key
            pieces = list(index)
            for s, k in _by_value(_share(own, shards)):
                parts = [pieces[i] for i in k.tolist()]
                yield _batch(_CUT, block, s, _tight(k), _tight(np.array(list(map(len, parts)))), _zip(b"".join(parts)), _tight(lo[k]), _tight(hi[k]), b"", b"")


_FOUND = pa.schema([("block", pa.int64()), ("piece", pa.binary()), ("offset", pa.binary()), ("n", pa.binary()), ("first", pa.binary())])
FOUND = "block long, piece binary, offset binary, n binary, first binary"


def _runs_of(rest: np.ndarray, owner: np.ndarray, offset: np.ndarray, by: np.ndarray, new: np.ndarray, lo: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs of windows with one smallest document: ``by`` has the windows in suffix order, ``new`` where one differs from the one before."""
    first = np.minimum.reduceat(lo[rest][owner[by]], np.flatnonzero(new))
    doc = np.empty(len(owner), np.int64)
    doc[by] = first[np.cumsum(new) - 1]
    start = np.flatnonzero(np.append(True, (np.diff(doc) != 0) | (np.diff(owner) != 0)))
    return rest[owner[start]], offset[start], np.diff(np.append(start, len(doc))), doc[start]


def _windows(w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Piece and offset of each window, ``w`` of each piece."""
    return np.repeat(np.arange(len(w), dtype=np.int32), w), np.arange(int(w.sum()), dtype=np.int32) - np.repeat((np.cumsum(w) - w).astype(np.int32), w)


def _first_in(pieces: list[bytes], rest: np.ndarray, size: np.ndarray, windows: np.ndarray, lo: np.ndarray, width: int, gram: int) -> tuple[np.ndarray, ...]:
    """Runs of windows of the pieces numbered ``rest``, from suffix arrays."""
    raw = np.frombuffer(b"".join(pieces[i] for i in rest.tolist()), np.uint8)
    n, w = size[rest], windows[rest]
    anchor, whole = _anchors(raw, n, width, gram)
    out = []
    for own, find in ((~whole, partial(_anchored, anchor=anchor[~whole])), (whole, _unanchored)):
        if own.all():
            return find(raw, rest, n, w, lo, width)
        if own.any():
            out.append(find(raw[np.repeat(own, n)], rest[own], n[own], w[own], lo, width))
    return tuple(np.concatenate(c) for c in zip(*out))


def _anchors(raw: np.ndarray, n: np.ndarray, width: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Where each piece has the gram of its minimizer, and the pieces that need their whole text sorted: those with it more
    than once, with all others of that minimizer, or all if windows of a piece have more than one minimizer."""
    begin = np.cumsum(n) - n
    h = np.full(len(raw), np.iinfo(np.uint64).max)
    h[: len(raw) - gram + 1] = minimizers(raw, gram, gram)
    grams = n - gram + 1
    at = np.repeat(begin - (np.cumsum(grams) - grams), grams) + np.arange(int(grams.sum()))
    h = h[at]
    edge = np.cumsum(grams) - grams
    least = np.minimum.reduceat(h, edge)
    place = np.flatnonzero(h == np.repeat(least, grams))
    owner = np.searchsorted(edge, place, "right") - 1
    first = np.searchsorted(owner, np.arange(len(n)))
    anchor = place[first] - edge
    several = np.diff(np.append(first, len(owner))) > 1
    several |= np.isin(least, least[several])
    if ((anchor > width - gram) | (anchor < n - width))[~several].any():
        several[:] = True
    elif several.any():  # a piece whose windows lack its least gram may share them with any other
        gap = np.maximum(np.diff(place, prepend=0), 1)
        gap[first] = 0
        last = place[np.append(first[1:], len(owner)) - 1] - edge
        if ((anchor > width - gram) | (last < n - width) | (np.maximum.reduceat(gap, first) > width - gram + 1))[several].any():
            several[:] = True
    return anchor, several


def _anchored(raw: np.ndarray, rest: np.ndarray, n: np.ndarray, w: np.ndarray, lo: np.ndarray, width: int, anchor: np.ndarray) -> tuple[np.ndarray, ...]:
    """Windows of pieces that have the gram of their minimizer once. Equal windows have it at equal distance, so it stands in
    the array as one symbol for what follows it, named in order; what goes before is induced from these."""
    begin = np.cumsum(n) - n
    length = n - anchor
    words = np.zeros((len(rest), -(-width // 8) * 8), np.uint8)
    for k in range(words.shape[1]):
        has = np.flatnonzero(length > k)
        words[has, k] = raw[(begin + anchor)[has] + k]
    words = words.view(">u8").astype(np.uint64)
    by = np.lexsort((length, *words.T[::-1]))
    rank = np.empty(len(rest), np.int64)
    rank[by] = np.cumsum(np.append(False, (words[by[1:]] != words[by[:-1]]).any(axis=1) | (length[by[1:]] != length[by[:-1]])))
    end = np.cumsum(anchor + 1)
    text = np.zeros(int(end[-1]) + 1, np.uint32)
    start = end - anchor - 1
    before = np.repeat(begin - (start - np.arange(len(rest))), anchor) + np.arange(int(anchor.sum()))
    chars = np.ones(len(text), bool)
    chars[end - 1] = chars[-1] = False
    text[chars] = raw[before].astype(np.uint32) + 1
    text[end - 1] = rank + 257
    if text.max() < 1 << 16:
        text = text.astype(np.uint16)
    owner, offset = _windows(w)
    position = start.astype(np.int32)[owner] + offset
    ahead = anchor.astype(np.int32)[owner] - offset
    sa = suffix_array(text)
    common = permuted_prefixes(text, sa)[position]
    number = np.full(len(text), -1, np.int32)
    number[position] = np.arange(len(position), dtype=np.int32)
    every = number[sa]
    at = np.flatnonzero(every >= 0)  # at[0] > 0, as the end stands first
    by, before = every[at], every[at - 1]
    same = (before >= 0) & (ahead[before] == ahead[by]) & (common[by] >= ahead[by])
    # the symbols before are the same, and so is what follows if its names are; else it is the same as far as the window goes
    left = np.flatnonzero(same & (common[by] == ahead[by]))
    x, y, need = words[owner[by[left]]], words[owner[before[left]]], width - ahead[by[left]]
    for k in range(words.shape[1]):
        shift = np.clip(64 - 8 * (need - 8 * k), 0, 63).astype(np.uint64)
        same[left] &= (need <= 8 * k) | ((x[:, k] ^ y[:, k]) >> shift == 0)
    return _runs_of(rest, owner, offset, by, ~same, lo)


def _unanchored(raw: np.ndarray, rest: np.ndarray, n: np.ndarray, w: np.ndarray, lo: np.ndarray, width: int) -> tuple[np.ndarray, ...]:
    """Windows of any pieces, from the suffix array of their whole text."""
    end = np.cumsum(n + 1)
    text = np.empty(int(end[-1]) + 1, np.uint16)
    text[end - 1] = 1
    text[-1] = 0
    letters = np.ones(len(text), bool)
    letters[end - 1] = letters[-1] = False
    text[letters] = raw.astype(np.uint16) + 2
    begin = end - n - 1
    owner, offset = _windows(w)
    position = begin.astype(np.int32)[owner] + offset
    del letters
    sa = suffix_array(text)
    same = permuted_prefixes(text, sa) >= width  # windows hold letters alone, so no separator is among these
    number = np.full(len(text), -1, np.int32)
    number[position] = np.arange(len(position), dtype=np.int32)
    by = number[sa]
    by = by[by >= 0]  # windows in suffix order
    del sa, number
    return _runs_of(rest, owner, offset, by, ~same[position[by]], lo)


def _again(pieces: list[bytes], lo: np.ndarray, width: int, gram: int) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Pieces of one key cut by the second hash of their windows: texts, keys, documents, and the piece and offset of each."""
    size = np.array(list(map(len, pieces)), np.int64)
    raw = b"".join(pieces)
    key = minimizers(np.frombuffer(raw, np.uint8), width, gram, second=True)
    begin = np.cumsum(size) - size
    owner = np.repeat(np.arange(len(pieces)), size)[: len(key)]
    inside = np.arange(len(key)) - begin[owner] <= size[owner] - width
    new = np.append(True, (key[1:] != key[:-1]) | (owner[1:] != owner[:-1]) | (inside[1:] != inside[:-1]))
    start = np.flatnonzero(new)
    stop = np.append(start[1:], len(key))
    start, stop = start[inside[start]], stop[inside[start]]
    texts_ = [raw[s : e + width - 1] for s, e in zip(start.tolist(), stop.tolist())]
    return texts_, key[start], lo[owner[start]], owner[start], start - begin[owner[start]]


def _repeated(pieces: list[bytes], lo: np.ndarray, hi: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The first window of each piece that two documents may have, and how many windows on the last one ends (0: none may):
    all of a piece that several documents have, and those whose hash comes more than once. The others are in one document."""
    size = np.array(list(map(len, pieces)), np.int64)
    w = size - width + 1
    owner, offset = _windows(w)
    raw = np.frombuffer(b"".join(pieces), np.uint8)
    h = minimizers(raw, width, width)[(np.cumsum(size) - size)[owner] + offset]
    by = np.argsort(h)
    equal = np.diff(h[by]) == 0
    may = np.zeros(len(h), bool)
    may[by[1:][equal]] = may[by[:-1][equal]] = True
    may |= (lo < hi)[owner]
    start, stop = np.zeros(len(pieces), np.int64), np.zeros(len(pieces), np.int64)
    own = np.flatnonzero(may)
    new = _firsts(owner[own])
    start[owner[own[new]]] = offset[own[new]]
    last = own[np.append(new[1:], len(own)) - 1] if len(own) else own
    stop[owner[last]] = offset[last] + 1
    return start, stop


def _firsts(x: np.ndarray) -> np.ndarray:
    """The first place of each run of equal values."""
    return np.flatnonzero(np.append(True, x[1:] != x[:-1])) if len(x) else np.zeros(0, np.int64)


def first_documents(pieces: list[bytes], key: np.ndarray, lo: np.ndarray, width: int, gram: int = GRAM, cut: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows of distinct pieces whose smallest document is the same: piece, first window, windows, document.

    ``lo`` is the smallest document of each piece; pieces with different keys share no window. A key with more text than an
    array takes is cut further by a second hash of its windows.
    """
    size = np.array(list(map(len, pieces)), np.int64)
    windows = size - width + 1
    order = np.argsort(key, kind="stable")
    edge = np.append(np.flatnonzero(np.append(True, np.diff(key[order]) != 0)), len(order)) if len(order) else np.zeros(1, np.int64)
    upto = np.append(0, np.cumsum(size[order]))
    out = [(np.zeros(0, np.int64),) * 4]
    k = 0
    while k + 1 < len(edge):  # keys that fill an array's text together
        last = max(k + 1, int(np.searchsorted(upto[edge], upto[edge[k]] + TEXT, "right")) - 1)
        own = order[edge[k] : edge[last]]
        if cut and last == k + 1 and len(own) > 1 and size[own].sum() > TEXT:
            parts, keys, docs, owner, offset = _again([pieces[i] for i in own.tolist()], lo[own], width, gram)
            index: dict[tuple[bytes, int], int] = {}
            piece, at, n, first = first_documents(*_distinct(parts, keys, docs, index), width, gram, cut=False)
            number = np.array([index[x] for x in zip(parts, keys.tolist())], np.int64)
            by = np.argsort(piece, kind="stable")
            span = np.searchsorted(piece[by], np.arange(len(index) + 1))
            count = span[number + 1] - span[number]
            part = np.repeat(np.arange(len(parts)), count)
            found = by[np.repeat(span[number] - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))]
            out.append((own[owner[part]], offset[part] + at[found], n[found], first[found]))
        else:
            out.append(_first_in(pieces, own, size, windows, lo, width, gram))
        k = last
    return tuple(np.concatenate(c) for c in zip(*out))


def _distinct(parts: list[bytes], keys: np.ndarray, docs: np.ndarray, index: dict[tuple[bytes, int], int]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The distinct parts with their key and smallest document; ``index`` gets their numbers."""
    number = np.array([index.setdefault(x, len(index)) for x in zip(parts, keys.tolist())], np.int64)
    least = np.full(len(index), np.iinfo(np.int64).max)
    np.minimum.at(least, number, docs)
    return [p for p, _ in index], np.array([k for _, k in index], np.uint64), least


def _resolve(batches: Iterator[pa.RecordBatch], shard: int, width: int, gram: int) -> Iterator[pa.RecordBatch]:
    """The pieces of a task, those of about ``shard`` bytes together."""
    for rows in _groups(batches):
        blocks = [r[1] for r in rows]
        raw = b"".join(zstandard.ZstdDecompressor().decompress(r[4]) for r in rows)
        number, size, lo, hi = (np.concatenate([_loose(r[k]) for r in rows]) for k in (2, 3, 5, 6))
        row = np.repeat(np.arange(len(rows), dtype=np.int32), [_count(r[3]) for r in rows])
        del rows
        begin = np.cumsum(size) - size
        letters = np.frombuffer(raw, np.uint8)
        # all windows of a piece have one minimizer, so that of the first is the piece's
        key = np.empty(len(size), np.uint64)
        for at in range(0, len(size), _CHUNK >> 3):
            heads = letters[(begin[at : at + (_CHUNK >> 3), None] + np.arange(width)).ravel()]
            key[at : at + (_CHUNK >> 3)] = minimizers(heads, width, gram)[::width]
        held, many = [], 0
        for _, own in _by_value(((key * _ODD[3]) >> np.uint64(33)).astype(np.int64) % -(-len(raw) // shard)):
            index: dict[bytes, int] = {}
            mine = np.array([index.setdefault(raw[s : s + n], len(index)) for s, n in zip(begin[own].tolist(), size[own].tolist())], np.int64)
            least, most, of = np.full(len(index), np.iinfo(np.int64).max), np.full(len(index), np.iinfo(np.int64).min), np.empty(len(index), np.uint64)
            np.minimum.at(least, mine, lo[own])
            np.maximum.at(most, mine, hi[own])
            of[mine] = key[own]
            start, stop = _repeated(list(index), least, most, width)
            some = np.flatnonzero(stop)
            parts = [p[s : e + width - 1] for p, s, e in zip(index, start.tolist(), stop.tolist()) if e]
            piece, offset, n, first = first_documents(parts, of[some], least[some], width, gram)
            piece, offset = some[piece], offset + start[some[piece]]
            by = np.argsort(piece, kind="stable")
            piece, offset, n, first = piece[by], offset[by], n[by], first[by]
            edge = np.searchsorted(piece, np.arange(len(index) + 1))
            count = edge[mine + 1] - edge[mine]
            k = np.repeat(edge[mine] - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
            own = np.repeat(own, count)
            ok = first[k] < hi[own]
            k, own = k[ok], own[ok]
            held.append((row[own], number[own], offset[k], n[k], first[k]))
            many += len(own)
            if many >= FOUND_AT_ONCE:
                yield from _send(blocks, held)
                held, many = [], 0
        yield from _send(blocks, held)


def _count(x: bytes) -> int:
    return zstandard.frame_content_size(x) // 8


def _send(blocks: list[int], held: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
    """What was found, a row for each block."""
    if held:
        row, *found = (np.concatenate(c) for c in zip(*held))
        for r, own in _by_value(row):
            yield _batch(_FOUND, blocks[r], *(_tight(x[own]) for x in found))


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, starts array<long>, ends array<long>"
_RESULT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("starts", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64()))])


def _remove(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for ids, sizes, text, piece, doc, start, found in zip(*(c.to_pylist() for c in b.columns)):
            ids, sizes, text = np.frombuffer(ids, np.int64), np.frombuffer(sizes, np.int64), _unzip(text, np.uint8)
            gone = np.zeros(len(text), bool)
            if found:
                piece, doc, start = _loose(piece), _loose(doc), _loose(start)
                by = np.argsort(piece, kind="stable")
                edge = np.searchsorted(piece[by], np.arange(int(piece.max()) + 2))
                cover = np.zeros(len(text) + 1, np.int32)
                for f in found:
                    p, offset, n, first = (_loose(f[k]) for k in ("piece", "offset", "n", "first"))
                    upto = np.cumsum(edge[p + 1] - edge[p])
                    cuts = np.searchsorted(upto, np.arange(0, int(upto[-1]) + 1, AT_ONCE))
                    for i, j in pairwise(np.unique(np.append(cuts, [0, len(p)])).tolist()):
                        count = edge[p[i:j] + 1] - edge[p[i:j]]
                        own = np.repeat(np.arange(i, j), count)
                        at = by[np.repeat(edge[p[i:j]] - (np.cumsum(count) - count), count) + np.arange(len(own))]
                        ok = first[own] < ids[doc[at]]
                        s = start[at[ok]] + offset[own[ok]]
                        np.add.at(cover, s, 1)
                        np.add.at(cover, s + n[own[ok]] - 1 + width, -1)
                gone = np.cumsum(cover[:-1], out=cover[:-1]) > 0
                del cover
            out, at = [], 0
            for i, n in zip(ids.tolist(), sizes.tolist()):
                g, t = gone[at : at + n], text[at : at + n]
                edges = np.flatnonzero(np.diff(np.concatenate([[0], g.view(np.int8), [0]]))).tolist() if g.any() else []
                kept = t[~g] if edges else t
                out.append((None if i == NULL_ID else i, n, n - len(kept), len(edges) // 2, hashlib.sha256(kept).hexdigest(), edges[::2], edges[1::2]))
                at += n
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _RESULT)], schema=_RESULT)


def _tasks(total: int, least: int, most: int) -> int:
    """Into how many parts a total goes: of ``least`` each up to ``TASKS``, then of ``most`` at most."""
    return int(max(1, -(-total // most), min(TASKS, -(-total // least))))


def deduplicate(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, block: int = BLOCK, shard: int = SHARD, hot: int = HOT) -> DataFrame:
    """Per row of docs: doc_id, n_bytes, n_removed, n_spans, kept_sha256, and the removed byte ranges (starts, ends)."""
    blocks = materialize(texts(docs).mapInArrow(partial(_collect, block=block), BLOCKS), "blocks")
    total = blocks.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    ask = _tasks(2 * total // (width - gram + 2), FEW_HASHES, HASHES)
    report = blocks.mapInArrow(partial(_report, shards=ask, width=width, gram=gram), REPORT)
    answers = report.repartitionById(ask, F.col("shard")).sortWithinPartitions("shard").mapInArrow(partial(_answer, hot=hot), ANSWER)
    answers = materialize(answers, "answers")
    bits = answers.agg(F.coalesce(F.sum(F.octet_length("shared")), F.lit(0))).first()[0]
    shards = _tasks(bits * 8 * 3 * width // 10, min(FEW, shard), PART)
    grouped = answers.groupBy("block").agg(F.collect_list(F.struct("shard", "shared", "hot")).alias("answers"))
    cut = blocks.join(grouped, "block", "left").mapInArrow(partial(_pieces, shards=shards, ask=ask, width=width, gram=gram), CUT)
    cut = materialize(cut, "pieces")
    discard(answers)
    pieces = cut.where("shard >= 0").select("shard", "block", "number", "sizes", "text", "low", "high")
    found = pieces.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard").mapInArrow(partial(_resolve, shard=shard, width=width, gram=gram), FOUND)
    found = materialize(found, "found").groupBy("block").agg(F.collect_list(F.struct("piece", "offset", "n", "first")).alias("found"))
    own = cut.where("shard < 0").select("block", "number", "doc", "start")
    d = blocks.join(own, "block", "left").join(found, "block", "left")
    return d.select("ids", "sizes", F.col("text"), "number", "doc", "start", "found").mapInArrow(partial(_remove, width=width), RESULT)


def op5_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is removed from each document, judged over all of them."""
    return deduplicate(table(spark, sf_dir, "documents")).drop("starts", "ends")


OP5_SQL = """
WITH d AS (
  SELECT row_number() OVER () AS row, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), hashed AS MATERIALIZED (
  SELECT row, doc_id, k, hash(substr(h, 2 * k + 1, 100)) AS x FROM (SELECT *, unnest(generate_series(0, CAST(len(h) // 2 - 50 AS BIGINT))) AS k FROM d WHERE len(h) >= 100)
), several AS (
  SELECT x FROM hashed GROUP BY 1 HAVING min(doc_id) < max(doc_id)
), windows AS (
  SELECT row, d.doc_id, k, substr(h, 2 * k + 1, 100) AS s FROM hashed JOIN several USING (x) JOIN d USING (row)
), first AS (
  SELECT s, min(doc_id) AS least FROM windows GROUP BY 1 HAVING min(doc_id) < max(doc_id)
), gone AS (
  SELECT row, k, lag(k) OVER (PARTITION BY row ORDER BY k) AS before FROM windows JOIN first USING (s) WHERE least < doc_id
), numbered AS (
  SELECT row, k, sum(CASE WHEN before IS NULL OR k > before + 50 THEN 1 ELSE 0 END) OVER (PARTITION BY row ORDER BY k) AS run FROM gone
), spans AS (
  SELECT row, run, min(k) AS lo, max(k) + 50 AS hi FROM numbered GROUP BY 1, 2
), kept AS (
  SELECT row, run, lo, hi, coalesce(lag(hi) OVER (PARTITION BY row ORDER BY run), 0) AS after FROM spans
), sums AS (
  SELECT row, CAST(sum(hi - lo) AS BIGINT) AS n_removed, count(*) AS n_spans, string_agg(substr(h, CAST(2 * after + 1 AS BIGINT), CAST(2 * (lo - after) AS BIGINT)), '' ORDER BY run) AS heads, max(hi) AS last FROM kept JOIN d USING (row) GROUP BY 1
)
SELECT doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(CASE WHEN n_spans IS NULL THEN h ELSE heads || substr(h, CAST(2 * last + 1 AS BIGINT)) END)) AS kept_sha256
FROM d LEFT JOIN sums USING (row)
"""
