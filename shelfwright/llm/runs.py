"""Periodic runs of words after Kolpakov and Kucherov, and texts without the repeats.

A run is a stretch of consecutive words with smallest period q that no neighbouring word extends keeping period q. Those of
at least ``times`` periods and ``least`` words are found, whole texts at once, each document by itself:

1. Words that cannot belong to such a run go first. Every three consecutive words of a run occur in it ``times`` - 1 times
   at least, so the text is cut where three words are rarer than that within the stretch they stand in, again and again
   until nothing changes. Counts are of hashes, which can only keep too much. Of prose little is left.
2. A suffix automaton of a stretch, with the first end of each state, gives its Lempel-Ziv factors: each is the longest
   string that starts earlier too, and is known with the place of its leftmost occurrence.
3. Main's algorithm: a run that touches the boundary between two factors has one period to the right or to the left of it.
   Longest common extensions of the text with itself, moved by each period, give its ends; Z-functions give these
   extensions for all periods at once. A run that goes on beyond a boundary starts less than a period before the factor
   that ends there (else the factor would have been longer), which bounds the windows by the two factors.
4. Any other run lies strictly inside a factor, and is copied from the factor's earlier occurrence.

All of it takes time in proportion to the words, and memory of some hundred bytes for each word of a stretch, one document
at a time; nothing is shuffled.

Defined cases: a null text is empty; a text without words has no runs and collapses to the empty one; rows that repeat a
doc_id and rows without one are rows of their own; ties of words are ties of their bytes; an empty table gives an empty one.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, texts

_SCHEMA = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed binary"
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
_ARROW = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("runs", pa.list_(_RUN)), ("collapsed", pa.binary())])

#: Odd numbers that mix three words and the stretch they stand in.
_MIX = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93))


def stretches(h: np.ndarray, times: int, least: int) -> list[tuple[int, int]]:
    """Beginnings and ends of the stretches that hold all runs, from the words' hashes."""
    least = max(least, times)
    need = min(times - 1, least - 2)
    if len(h) < least:
        return []
    if need < 2:
        return [(0, len(h))]
    h = h.view(np.uint64)
    gram = h[:-2] * _MIX[0] + (h[1:-1] ^ _MIX[3]) * _MIX[1] + (h[2:] ^ _MIX[0]) * _MIX[2]
    at = np.arange(len(gram))
    while len(at):
        ends = np.append(np.flatnonzero(np.diff(at) > 1) + 1, len(at))
        sizes = np.diff(ends, prepend=0)
        bits = min(24, int(len(at)).bit_length() + 3)
        key = ((gram[at] ^ np.repeat(np.arange(len(sizes), dtype=np.uint64), sizes) * _MIX[3]) * _MIX[0] >> np.uint64(64 - bits)).astype(np.int64)
        stay = (np.bincount(key, minlength=1 << bits)[key] >= need) & np.repeat(sizes >= least - 2, sizes)
        if stay.all():
            return [(int(at[e - n]), int(at[e - 1]) + 3) for n, e in zip(sizes.tolist(), ends.tolist())]
        at = at[stay]
    return []


class Automaton:
    """Suffix automaton of a sequence of numbers, with the first end of each state's strings.

    Nearly all states have one way on: its letter and target stand in two lists, further ways in a dict.
    """

    def __init__(self, w: list[int]):
        self.letter, self.target, self.more, self.first = [-1], [0], {}, [-1]
        link, length, last = [-1], [0], 0
        letter, target, more, first = self.letter, self.target, self.more, self.first
        for i, c in enumerate(w):
            new, p, q = len(link), last, -1
            letter.append(-1), target.append(0), first.append(i), link.append(0), length.append(i + 1)
            while p >= 0:
                own = letter[p]
                if own == c:
                    q = target[p]
                    break
                if own < 0:
                    letter[p], target[p] = c, new
                elif p not in more:
                    more[p] = {c: new}
                elif c in more[p]:
                    q = more[p][c]
                    break
                else:
                    more[p][c] = new
                p = link[p]
            if q >= 0:
                if length[q] != length[p] + 1:
                    clone = len(link)
                    letter.append(letter[q]), target.append(target[q]), first.append(first[q]), link.append(link[q]), length.append(length[p] + 1)
                    if q in more:
                        more[clone] = dict(more[q])
                    while p >= 0 and self.step(p, c) == q:
                        if letter[p] == c:
                            target[p] = clone
                        else:
                            more[p][c] = clone
                        p = link[p]
                    link[q] = q = clone
                link[new] = q
            last = new

    def step(self, state: int, c: int) -> int:
        """The state after one more letter, which must be a way on."""
        return self.target[state] if self.letter[state] == c else self.more[state][c]


def factors(w: list[int]) -> list[tuple[int, int, int]]:
    """(beginning, end, beginning of the leftmost occurrence or -1) of the Lempel-Ziv factors; occurrences may overlap."""
    a, out, i = Automaton(w), [], 0
    first, step = a.first, a.step
    while i < len(w):
        state, j, seen = 0, i, -1
        while j < len(w):
            state = step(state, w[j])
            if first[state] >= j:
                break
            seen, j = first[state], j + 1
        out.append((i, j, seen + 1 - (j - i)) if j > i else (i, i + 1, -1))
        i = out[-1][1]
    return out


def common_prefixes(s: list[int]) -> list[int]:
    """Z-function: how far the sequence from each place on agrees with the whole."""
    n, left, right = len(s), 0, 0
    z = [n] + [0] * (n - 1)
    for i in range(1, n):
        k = 0
        if i < right:
            k = z[i - left]
            if k < right - i:
                z[i] = k
                continue
            k = right - i
        while i + k < n and s[k] == s[i + k]:
            k += 1
        z[i], left, right = k, i, i + k
    return z


def _touching(w: list[int], b: int, before: int, after: int, times: int) -> Iterator[tuple[int, int, int]]:
    """(start, end, period) of the runs that touch ``b``, where a factor of ``before`` words ends and one of ``after`` begins, and end with it or earlier."""
    most = (before + after - 1) // (times - 1)
    if most < 1:
        return
    back, end = min(b, before + most + 1), b + after
    left, right = min(most, b), min(most, after)
    ahead = w[b : end + 1]
    forth = common_prefixes([*ahead, -1, *w[b - left : end + 1]])
    behind = w[b - back : b][::-1]
    aback = common_prefixes([*behind, -1, *w[b - back : b + right][::-1]])
    for p in range(1, right + 1):  # one period lies to the right
        s, t = b - aback[back + 1 + right - p], b + p + (forth[p] if p < len(ahead) else 0)
        if t - s >= times * p and t <= end:
            yield s, t, p
    for p in range(1, left + 1):  # or to the left
        s, t = b - p - (aback[p] if p < back else 0), b + forth[len(ahead) + 1 + left - p]
        if t - s >= times * p and t <= end and (t > b or s >= b - before):
            yield s, t, p


def runs(w: list[int], times: int = 2, least: int = 2) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of at least ``times`` >= 2 periods and ``least`` words, by start and period."""
    if times < 2:
        raise ValueError("a run has two periods at least")
    cut = factors(w)
    at: dict[int, dict[int, int]] = defaultdict(dict)  # by start, then end
    spans = [e - b for b, e, _ in cut] + [0]
    for k, (_, b, _) in enumerate(cut):
        for s, t, p in _touching(w, b, spans[k], spans[k + 1], times):
            at[s][t] = min(p, at[s].get(t, p))
    for b, e, d in cut:
        if d >= 0 and e - b > times:
            for s in range(d + 1, d + e - b - 1):
                for t, p in at[s].items() if s in at else ():
                    if t < d + e - b:
                        at[s + b - d][t + b - d] = p
    return sorted((s, t - s, p) for s, ends in at.items() for t, p in ends.items() if t - s >= least)


def runs_of_words(words: list[bytes], times: int = 4, least: int = 6) -> list[tuple[int, int, int]]:
    """The runs of a whole text's words."""
    out = []
    for s, e in stretches(np.fromiter(map(hash, words), np.int64, len(words)), times, least):
        names: dict[bytes, int] = {}
        w = [names.setdefault(x, len(names)) for x in words[s:e]]
        out += ((s + a, n, p) for a, n, p in runs(w, times, least))
    return out


def collapse(words: list[bytes], found: list[tuple[int, int, int]]) -> list[bytes]:
    """The words without those that a run holds after its first period."""
    if not found:
        return words
    gone = np.zeros(len(words) + 1, np.int64)
    for s, n, p in found:
        gone[s + p] += 1
        gone[s + n] -= 1
    return [x for x, g in zip(words, np.cumsum(gone).tolist()) if not g]


def _find(batches: Iterator[pa.RecordBatch], times: int, least: int, change: Callable | None) -> Iterator[pa.RecordBatch]:
    for b in batches:
        counts, found, left = [], [], []
        for i, doc_id in enumerate(b.column(0).to_pylist()):
            words = b.column(1)[i].as_py().split()
            if change:
                words = change(doc_id, words)
            r = runs_of_words(words, times, least)
            counts.append(len(words))
            found.append([dict(zip(("start", "length", "period"), x)) for x in r])
            left.append(b" ".join(collapse(words, r)))
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(counts, pa.int64()), pa.array(found, pa.list_(_RUN)), pa.array(left, pa.binary())], schema=_ARROW)


def find(docs: DataFrame, times: int = 4, least: int = 6, change: Callable[[int | None, list[bytes]], list[bytes]] | None = None) -> DataFrame:
    """(doc_id, n_words, runs, collapsed) of every document: its runs by start and period, and its words without repeats,
    joined by one space. Words are what ASCII white space separates; ``change`` may alter a document's words first."""
    d = texts(docs).select("doc_id", F.col("text").cast("binary").alias("text"))
    return d.mapInArrow(partial(_find, times=times, least=least, change=change), _SCHEMA).withColumn("collapsed", F.col("collapsed").cast("string"))


def planted(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """A tenth of the documents, by the checksum of their ids, go on with one of their passages over and over."""
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if doc_id is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * (-(-(n - a) // p)))[: n - a]


def op11_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Count and digest of the runs, the longest one, and digest of the collapsed text, of every document."""
    d = find(table(spark, sf_dir, "documents"), change=planted)
    line = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n")))
    longest = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period"))))
    d = d.withColumn("longest", longest)
    length, period = -F.col("longest.less"), F.col("longest.period")
    return d.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("longest.start").alias("start"), length.alias("length"), period.alias("period"),
        F.expr("(1000 * -longest.less) div longest.period").alias("exponent_milli"), F.sha2(F.array_join(line, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


#: crc32 of the decimal id bit by bit; equal words at each distance q, islands of them per distance, the least q per island.
OP11_SQL = r"""
WITH c AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
    xor(list_reduce(list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT),
      lambda crc, x: list_reduce([1, 2, 3, 4, 5, 6, 7, 8], lambda r, k: xor(r >> 1, 3988292384 * (r & 1)), xor(crc, x)), 4294967295::BIGINT), 4294967295::BIGINT) AS h
  FROM documents),
g AS (SELECT doc_id, w, len(w) AS n, h % 10 = 0 AND len(w) > 0 AS planted, CASE WHEN len(w) > 0 THEN (h // 10) % len(w) ELSE 0 END AS a, 3 + (h // 10) % 8 AS k FROM c),
v AS (SELECT doc_id, n, i, w[CASE WHEN planted AND i >= a THEN a + (i - a) % (1 + (n - a) // k) ELSE i END + 1] AS word FROM (SELECT *, unnest(range(n)) AS i FROM g)),
e AS (SELECT x.doc_id, x.n, x.i, y.i - x.i AS q FROM v x JOIN v y ON x.doc_id = y.doc_id AND x.word = y.word AND y.i > x.i AND 4 * (y.i - x.i) <= x.n),
s AS (SELECT doc_id, q, min(i) AS start, count(*) + q AS length FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM e) GROUP BY doc_id, q, island),
r AS (SELECT doc_id, start, length, min(q) AS q FROM s WHERE length >= greatest(6, 4 * q) GROUP BY doc_id, start, length),
d AS (SELECT DISTINCT doc_id, unnest(range(start + q, start + length)) AS i FROM r),
t AS (SELECT v.doc_id, string_agg(word, ' ' ORDER BY i) AS kept FROM v ANTI JOIN d USING (doc_id, i) GROUP BY v.doc_id),
o AS (SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || q || chr(10), '' ORDER BY start, q) AS lines, min({'l': -length, 's': start, 'q': q}) AS longest FROM r GROUP BY doc_id)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, longest.s AS start, -longest.l AS length, longest.q AS period, 1000 * -longest.l // longest.q AS exponent_milli,
  sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM documents LEFT JOIN o USING (doc_id) LEFT JOIN t USING (doc_id)
"""
