"""Where the sources of a language diverge, term by term, from byte tries that partitions count in and ranges merge.

1. Each task counts terms in a byte radix trie for each language: a leaf has a counter of occurrences and of documents for
   each source. Few leaves below a node are one table, which becomes a node as it grows. A trie that grows beyond ``LEAVES`` is handed on and begun anew.
2. Tries are handed on as subtries, one for each prefix of ``DEPTH`` bytes. Where the subtries of one prefix hold more than
   ``ROOM`` leaves over all tasks, they are cut again, two bytes deeper, until none does. So no prefix, however common, is
   more than a task takes, and a term in every document is one leaf for each trie.
3. Prefixes go to tasks by range, and the subtries of a prefix are merged one after the other. The walk of the merged trie
   gives its terms in UTF-8 order; those in at least ``least`` documents of the language are kept, in blocks of bounded size.
4. Each block of terms meets the totals of its language's sources: it gives, for each pair of sources, the sum of the
   divergences of its terms, and for each source its ``top`` terms. Sums and a cut by rank, partial ones first, do the rest.

All arithmetic is on integers: with N the occurrences of kept terms and V their number, a count has the share
p = 1 + floor(10^9 (count + 2) / (N + 2 V)), and two shares diverge by floor((p - q)^2 / (p + q)).

Defined cases: null text, lang and source are empty strings, and these a language and a source like others; rows count as
documents, whether or not ids repeat; ties of a rank go by the item's UTF-8 bytes; a language without kept terms has pairs
of value 0 and no terms; a source alone in its language has no pairs; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import batch, materialize, small, table

#: Leaves of a task's tries, of all subtries of a prefix, and bytes of the first prefixes.
LEAVES, ROOM, DEPTH = 1 << 18, 1 << 15, 3
#: Leaves that a trie in memory keeps in one table before it gives them a node.
TABLE = 256
#: Bytes of text counted at once; counters of a block of terms, or more, if its sources make more pairs; cells of terms by sources compared at once; sources whose pairs one task sums.
SLICE, ENTRIES, CELLS, TILE = 1 << 22, 1 << 14, 1 << 20, 256

#: ASCII letters in lower case and all bytes beyond ASCII stay, the rest are spaces.
_LETTERS = bytes(c if c > 127 else ord(chr(c).lower()) if chr(c).isalpha() else 32 for c in range(256))

_TRIE = pa.schema([("lang", pa.string()), ("prefix", pa.binary()), ("leaves", pa.int32()), ("sources", pa.list_(pa.string())), ("rest", pa.list_(pa.binary())), ("many", pa.list_(pa.int32())), ("source", pa.list_(pa.int32())), ("n", pa.list_(pa.int64())), ("docs", pa.list_(pa.int64()))])
_TRIE_DDL = "lang string, prefix binary, leaves int, sources array<string>, rest array<binary>, many array<int>, source array<int>, n array<long>, docs array<long>"
_NUMBERS = ("many", "source", "n", "docs")
_KEPT = pa.schema([("lang", pa.string()), ("block", pa.string()), ("place", pa.int32()), ("term", pa.string()), ("source", pa.string()), ("n", pa.int64()), ("total", pa.int64())])
_KEPT_DDL = "lang string, block string, place int, term string, source string, n long, total long"
_FOUND_DDL = "lang string, part string, source string, item string, value long"
_FOUND = pa.schema([("lang", pa.string()), ("part", pa.string()), ("source", pa.string()), ("item", pa.string()), ("value", pa.int64())])


class Trie:
    """Byte radix trie that numbers its leaves. A node is [label, number of its leaf or -1, children by first byte].

    A child with ``TABLE`` leaves or fewer is a table from what is left of its terms, first byte included, to their numbers;
    one more, and it becomes a node whose label is what its terms begin with, with tables below (a burst trie).
    """

    def __init__(self):
        self.root, self.size = [b"", -1, {}], 0

    def leaf(self, term: bytes) -> int:
        """The number of the term's leaf, which is made if it is missing."""
        node, i, n = self.root, 0, len(term)
        while i < n:
            kids, c = node[2], term[i]
            kid = kids.get(c)
            if kid is None:
                kid = kids[c] = {}
            if type(kid) is dict:
                rest = term[i:]
                number = kid.get(rest)
                if number is None:
                    number = kid[rest] = self.size
                    self.size += 1
                    if len(kid) > TABLE:
                        kids[c] = _node(kid)
                return number
            label = kid[0]
            m = len(label)
            if m > 1 and not term.startswith(label, i):
                m = _common(label, term[i : i + m])
                mid = kids[c] = [label[:m], -1, {label[m]: kid}]
                kid[0], kid = label[m:], mid
            node, i = kid, i + m
        if node[1] < 0:
            node[1], self.size = self.size, self.size + 1
        return node[1]

    def walk(self) -> Iterator[tuple[bytes, int]]:
        """Terms in the order of their bytes, with the numbers of their leaves."""
        todo = [(b"", self.root)]
        while todo:
            above, node = todo.pop()
            if type(node) is dict:
                rests = sorted(node)
                yield from zip(map(above.__add__, rests), map(node.__getitem__, rests))
                continue
            label, number, kids = node
            here = above + label
            if number >= 0:
                yield here, number
            todo += [(here, kids[c]) for c in sorted(kids, reverse=True)]


def _common(a: bytes, b: bytes) -> int:
    """The number of bytes that both begin with."""
    return next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


def _node(leaves: dict[bytes, int]) -> list:
    """The node of a table that has grown too large."""
    low = min(leaves)
    m = _common(low, max(leaves))
    node = [low[:m], leaves.pop(low[:m], -1), {}]
    for rest, number in leaves.items():
        node[2].setdefault(rest[m], {})[rest[m:]] = number
    return node


class Leaves:
    """A trie with a counter of occurrences and of documents for each leaf and source."""

    def __init__(self):
        self.trie, self.names, self.parts = Trie(), {}, []
        #: Numbers of leaves that other subtries of a merge may ask for again.
        self.known: dict[bytes, int] | None = None

    def sources(self, names: list[str]) -> np.ndarray:
        return np.array([self.names.setdefault(s, len(self.names)) for s in names], np.int64)

    def add(self, terms: list[bytes], which: np.ndarray, source: np.ndarray, n: np.ndarray, docs: np.ndarray) -> None:
        """Adds to the counters of (term number ``which``, source); a pair may come more than once."""
        if self.known is None:
            leaf = np.fromiter(map(self.trie.leaf, terms), np.int64, len(terms))
        else:
            known = self.known
            for t in terms:
                if t not in known:
                    known[t] = self.trie.leaf(t)
            leaf = np.fromiter(map(known.__getitem__, terms), np.int64, len(terms))
        self.parts.append((leaf[which], source, n, docs))

    def sorted(self) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Terms in byte order, and (term number, source, n, docs) by term and source, each pair once."""
        walked = list(self.trie.walk())
        rank = np.empty(self.trie.size, np.int64)
        rank[[x for _, x in walked]] = np.arange(len(walked))
        leaf, source, n, docs = (np.concatenate(x) if self.parts else np.zeros(0, np.int64) for x in (zip(*self.parts) if self.parts else [()] * 4))
        key = rank[leaf] * len(self.names) + source
        order = np.argsort(key, kind="stable")
        starts = np.flatnonzero(np.diff(key[order], prepend=-1))
        key = key[order][starts]
        return [t for t, _ in walked], key // max(1, len(self.names)), key % max(1, len(self.names)), np.add.reduceat(n[order], starts), np.add.reduceat(docs[order], starts)


def _bytes(values: pa.Array) -> list[bytes]:
    return values.to_numpy(zero_copy_only=False).tolist()


def _split(text: pa.Array) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Distinct terms of the texts, and for each occurrence the number of its term and of its text."""
    _, offsets, data = text.buffers()
    letters = pa.Array.from_buffers(pa.string(), len(text), [None, offsets, pa.py_buffer(data.to_pybytes().translate(_LETTERS) if data else b"")], offset=text.offset)
    found = pc.ascii_split_whitespace(letters)
    coded = found.flatten().dictionary_encode()
    code = coded.indices.to_numpy()
    of = np.repeat(np.arange(len(text)), pc.list_value_length(found).to_numpy())
    terms = _bytes(coded.dictionary.cast(pa.binary()))
    if b"" in terms:
        some = code != terms.index(b"")
        code, of = code[some], of[some]
    return terms, code, of


def _count(leaves: Leaves, text: pa.Array, source: np.ndarray) -> None:
    """Counts the terms of texts whose sources are in ascending order."""
    terms, code, of = _split(text)
    if not len(code):
        return
    key = np.sort(code.astype(np.int64) * len(text) + of)
    first = np.flatnonzero(np.diff(key, prepend=-1))  # of each term in each text
    times, which, by = np.diff(first, append=len(key)), key[first] // len(text), source[key[first] % len(text)]
    new = np.flatnonzero((np.diff(which, prepend=-1) != 0) | (np.diff(by, prepend=-1) != 0))
    which, by = which[new], by[new]
    other = np.diff(which, prepend=-1) != 0
    leaves.add([terms[i] for i in which[other].tolist()], np.cumsum(other) - 1, by, np.add.reduceat(times, new), np.diff(new, append=len(first)))


def _subtries(lang: str, leaves: Leaves, depth: int, above: bytes = b"") -> Iterator[pa.RecordBatch]:
    """A row for each prefix of ``depth`` bytes; ``above`` comes before all terms."""
    terms, leaf, source, n, docs = leaves.sorted()
    if not terms:
        return
    names = list(leaves.names)
    prefixes = [(above + t)[:depth] for t in terms]
    starts = [0, *(i for i in range(1, len(terms)) if prefixes[i] != prefixes[i - 1]), len(terms)]
    bounds = np.searchsorted(leaf, starts)
    many = np.bincount(leaf, minlength=len(terms))
    of = np.repeat(np.arange(len(starts) - 1), np.diff(bounds))
    own, source = np.unique(of * len(names) + source, return_inverse=True)
    sources = np.bincount(own // len(names), minlength=len(starts) - 1)
    ends = lambda sizes: pa.array(np.append(0, np.cumsum(sizes)), pa.int32())
    leaf_ends, counter_ends = pa.array(starts, pa.int32()), pa.array(bounds, pa.int32())
    yield pa.RecordBatch.from_arrays([
        pa.array([lang] * len(sources)), pa.array([prefixes[i] for i in starts[:-1]], pa.binary()), pa.array(np.diff(starts), pa.int32()),
        pa.ListArray.from_arrays(ends(sources), pa.array(names, pa.string()).take(pa.array(own % len(names)))),
        pa.ListArray.from_arrays(leaf_ends, pa.array([(above + t)[depth:] for t in terms], pa.binary())),
        pa.ListArray.from_arrays(leaf_ends, pa.array(many, pa.int32())),
        pa.ListArray.from_arrays(counter_ends, pa.array(source - (np.cumsum(sources) - sources)[of], pa.int32())),
        pa.ListArray.from_arrays(counter_ends, pa.array(n)), pa.ListArray.from_arrays(counter_ends, pa.array(docs)),
    ], schema=_TRIE)


def _tries(batches: Iterator[pa.RecordBatch], depth: int, most: int) -> Iterator[pa.RecordBatch]:
    """Subtries of a task's documents (lang, source, text)."""
    held: dict[str, Leaves] = {}
    for b in batches:
        t = pa.Table.from_batches([b]).sort_by([("lang", "ascending"), ("source", "ascending")]).combine_chunks()
        sizes = pc.binary_length(t["text"]).to_numpy()
        lang, names = t["lang"].to_pylist(), t["source"].to_pylist()
        text = t["text"].chunk(0) if len(t) else pa.array([], pa.binary())
        i = 0
        while i < len(t):
            j, room = i + 1, SLICE - sizes[i]
            while j < len(t) and lang[j] == lang[i] and sizes[j] <= room:
                room -= sizes[j]
                j += 1
            own = held.setdefault(lang[i], Leaves())
            _count(own, text.slice(i, j - i).take(pa.array(range(j - i))), own.sources(names[i:j]))
            i = j
            if sum(x.trie.size for x in held.values()) > most:
                for k, x in held.items():
                    yield from _subtries(k, x, depth)
                held = {}
    for k, x in held.items():
        yield from _subtries(k, x, depth)


def _read(row: dict, into: Leaves, above: bytes = b"") -> None:
    """Merges a subtrie into a trie."""
    many, own = row["many"], into.sources(row["sources"])
    into.add([above + x for x in row["rest"]] if above else row["rest"], np.repeat(np.arange(len(many)), many), own[row["source"]], row["n"], row["docs"])


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for b in batches:
        plain = {name: b.column(name).to_pylist() for name in ("lang", "prefix")}
        lists = {name: (b.column(name).offsets.to_pylist(), b.column(name).values) for name in ("sources", "rest", *_NUMBERS)}
        for i in range(len(b)):  # one subtrie in memory at a time
            own = {name: values.slice(ends[i], ends[i + 1] - ends[i]) for name, (ends, values) in lists.items()}
            yield {name: x[i] for name, x in plain.items()} | {name: x.to_numpy() if name in _NUMBERS else x.to_pylist() if name == "sources" else _bytes(x) for name, x in own.items()}


def _deeper(batches: Iterator[pa.RecordBatch], depth: int) -> Iterator[pa.RecordBatch]:
    for row in _rows(batches):
        leaves = Leaves()
        _read(row, leaves)
        yield from _subtries(row["lang"], leaves, depth, row["prefix"])


def subtries(docs: DataFrame, depth: int = DEPTH, room: int = ROOM, leaves: int = LEAVES) -> DataFrame:
    """The tries of all tasks, cut at prefixes that hold ``room`` leaves or fewer over all tasks, or one term alone."""
    d = docs.select(*(F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source")), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    cut, done = materialize(d.mapInArrow(partial(_tries, depth=depth, most=leaves), _TRIE_DDL), "tries"), None
    while True:
        large = cut.where(F.length("prefix") == depth).groupBy("lang", "prefix").agg(F.sum("leaves").alias("n")).where(F.col("n") > room)
        large = small(large.select("lang", "prefix"), 1 << 18)
        rest = cut.join(large, ["lang", "prefix"], "left_anti")
        done = rest if done is None else done.unionByName(rest)
        if large.isEmpty():
            return done
        depth += 2
        hot = cut.join(large, ["lang", "prefix"], "left_semi").select(*_TRIE.names)
        cut = materialize(hot.mapInArrow(partial(_deeper, depth=depth), _TRIE_DDL), "tries")


def _kept(prefix: bytes, leaves: Leaves, least: int) -> tuple[list[bytes], np.ndarray, pa.Array, np.ndarray]:
    """The terms in ``least`` documents or more, and (number of the term, source, occurrences) of each."""
    terms, leaf, source, n, docs = leaves.sorted()
    many = np.bincount(leaf, docs, len(terms)) >= least
    some, place = many[leaf], np.cumsum(many) - 1
    return [prefix + t for t, x in zip(terms, many.tolist()) if x], place[leaf[some]], pa.array(list(leaves.names), pa.string()).take(pa.array(source[some])), n[some]


def _block(lang: str, held: list[tuple[list[bytes], np.ndarray, pa.Array, np.ndarray]]) -> pa.RecordBatch:
    terms = [t.decode("utf-8", "replace") for x in held for t in x[0]]
    shift = np.cumsum([0, *(len(x[0]) for x in held)])
    place, n = np.concatenate([x[1] + s for x, s in zip(held, shift)]), np.concatenate([x[3] for x in held])
    total = np.zeros(len(terms), np.int64)
    np.add.at(total, place, n)
    return batch(_KEPT, {"lang": [lang] * len(n), "block": [terms[0]] * len(n), "place": place, "term": pa.array(terms, pa.string()).take(pa.array(place)), "source": pa.concat_arrays([x[2] for x in held]), "n": n, "total": total[place]})


def _merge(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """Counters of the kept terms, in blocks of neighbours, from subtries sorted by language and prefix."""
    held, size, sources = [], 0, set()
    for (lang, prefix, last), leaves in _merged(batches):
        kept = _kept(prefix, leaves, least)
        if kept[0]:
            held.append(kept)
            size += len(kept[3])
            sources.update(kept[2].unique().to_pylist())
        if held and (last or size > max(ENTRIES, len(sources) * min(len(sources), TILE))):
            yield _block(lang, held)
            held, size, sources = [], 0, set()


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, bytes, bool], Leaves]]:
    """(language, prefix, whether it is the language's last here) and the merged trie of each prefix."""
    now, leaves = None, Leaves()
    leaves.known = {}
    for row in _rows(batches):
        key = (row["lang"], row["prefix"])
        if now and key != now:
            yield (*now, key[0] != now[0]), leaves
            leaves = Leaves()
            leaves.known = {}
        now = key
        _read(row, leaves)
    if now:
        yield (*now, True), leaves


def _share(count: np.ndarray, size: np.ndarray | int, kept: int) -> np.ndarray:
    """1 + floor(10^9 (count + 2) / (size + 2 kept)) by long division, three digits at a time, as products of whole counts could overflow."""
    rest, whole, out = count + 2, size + 2 * kept, np.zeros_like(count)
    for _ in range(3):
        out, rest = out * 1000 + rest * 1000 // whole, rest * 1000 % whole
    return out + 1


def _divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // (p + q)


def _compare(leaves: pa.Table, totals: pa.Table, top: int) -> pa.Table:
    """Sums for the pairs of sources, the smaller one in the tile, and the best terms of the tile's sources, of one block of terms."""
    totals = totals.sort_by("source")
    names, size, own = totals["source"].to_pylist(), totals["size"].to_numpy(), totals["own"].to_numpy().astype(bool)
    out: list[tuple[str, str, str, int]] = []
    if len(leaves):
        lang, kept, lang_size = totals["lang"][0].as_py(), totals["kept"][0].as_py(), totals["lang_size"][0].as_py()
        leaves = leaves.sort_by("place")
        place, n, total = (leaves[c].to_numpy() for c in ("place", "n", "total"))
        source = pc.index_in(leaves["source"], pa.array(names, pa.string())).to_numpy()
        sums = np.zeros((len(names), len(names)), np.int64)
        step = max(1, CELLS // len(names))
        for low in range(0, int(place[-1]) + 1, step):
            i, j = np.searchsorted(place, [low, low + step])
            row = place[i:j] - low
            terms = int(row[-1]) + 1
            count, lang_count = np.zeros((terms, len(names)), np.int64), np.zeros((terms, 1), np.int64)
            count[row, source[i:j]], lang_count[row, 0] = n[i:j], total[i:j]
            first = i + np.searchsorted(row, np.arange(terms))
            p, q = _share(count, size, kept), _share(lang_count, lang_size, kept)
            for g in np.flatnonzero(own).tolist():
                sums[g, g + 1 :] += _divergence(p[:, g : g + 1], p[:, g + 1 :]).sum(axis=0)
            value = np.where((count > 0) & (p > q), _divergence(p, q), -1)
            for g in np.flatnonzero(own).tolist():
                best = np.argsort(-value[:, g], kind="stable")[:top]
                out += ((names[g], "term", leaves["term"][int(first[x])].as_py(), int(value[x, g])) for x in best if value[x, g] >= 0)
        out += ((names[g], "pair", names[h], int(sums[g, h])) for g in np.flatnonzero(own).tolist() for h in range(g + 1, len(names)))
    columns = list(zip(*out)) or [()] * 4
    return pa.table([pa.array([lang] * len(out) if out else [], pa.string()), *(pa.array(columns[k], t) for k, t in ((1, pa.string()), (0, pa.string()), (2, pa.string()), (3, pa.int64())))], schema=_FOUND)


def _ranked(found: DataFrame, top: int | None = None) -> DataFrame:
    w = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = found.withColumn("rank", F.row_number().over(w))
    return ranked.where(F.col("rank") <= top) if top else ranked


def divergence(docs: DataFrame, least: int = 10, top: int = 10, **cut: int) -> DataFrame:
    """(lang, source, part, item, value, rank): for each source of a language the others (part ``pair``) and its ``top`` terms (part ``term``)."""
    parts = subtries(docs, **cut)
    merged = parts.repartitionByRange("lang", "prefix").sortWithinPartitions("lang", "prefix")
    leaves = materialize(merged.mapInArrow(partial(_merge, least=least), _KEPT_DDL), "leaves")

    groups = materialize(docs.select(*(F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source"))).distinct(), "groups")
    sizes = leaves.groupBy("lang", "source").agg(F.sum("n").alias("size"))
    blocks = leaves.groupBy("lang", "block").agg((F.max("place") + 1).cast("long").alias("terms"), F.sum("n").alias("n"))
    langs = blocks.groupBy("lang").agg(F.sum("terms").alias("kept"), F.sum("n").alias("lang_size"))
    number = F.row_number().over(Window.partitionBy("lang").orderBy("source"))
    known = groups.join(sizes, ["lang", "source"], "left").join(langs, "lang").withColumn("size", F.coalesce("size", F.lit(0))).withColumn("own_tile", F.floor((number - 1) / TILE))
    known = materialize(known, "totals")
    tiles = known.select("lang", F.col("own_tile").alias("tile")).distinct()
    totals = known.join(blocks.select("lang", "block"), "lang").join(tiles, "lang").withColumn("own", (F.col("own_tile") == F.col("tile")).cast("int"))
    key = ["lang", "block", "tile"]
    left, right = (x.toDF(*x.columns) for x in (leaves.join(tiles, "lang"), totals))  # columns of their own
    met = left.groupBy(*key).cogroup(right.groupBy(*key))
    found = materialize(met.applyInArrow(lambda x, y: _compare(x, y, top), _FOUND_DDL), "found")

    sums = found.where("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    both = sums.union(sums.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value"))
    others = groups.select("lang", F.col("source").alias("item"))
    pairs = groups.join(others, "lang").where("source <> item").join(both, ["lang", "source", "item"], "left").withColumn("value", F.coalesce("value", F.lit(0)))
    terms = found.where("part = 'term'").drop("part")
    part = lambda name: F.lit(name).alias("part")
    return _ranked(pairs).select("lang", "source", part("pair"), "item", "value", "rank").union(_ranked(terms, top).select("lang", "source", part("term"), "item", "value", "rank"))


def op13_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Divergence of the sources of each language: all pairs, and ten terms for each."""
    return divergence(table(spark, sf_dir, "documents"))


OP13_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term, count(*) AS total FROM w GROUP BY lang, term HAVING count(DISTINCT r) >= 10),
c AS (SELECT lang, source, term, count(*) AS n FROM w JOIN k USING (lang, term) GROUP BY lang, source, term),
g AS (SELECT DISTINCT lang, source FROM d),
v AS (SELECT lang, count(*) AS v, sum(total) AS size FROM k GROUP BY lang),
s AS (SELECT lang, source, coalesce(sum(n), 0) AS size FROM g LEFT JOIN c USING (lang, source) GROUP BY lang, source),
p AS (SELECT lang, source, term, coalesce(n, 0) AS n, (1 + 1000000000::HUGEINT * (coalesce(n, 0) + 2) // (s.size::HUGEINT + 2 * v))::HUGEINT AS p,
  (1 + 1000000000::HUGEINT * (total + 2) // (v.size::HUGEINT + 2 * v))::HUGEINT AS q
  FROM s JOIN k USING (lang) JOIN v USING (lang) LEFT JOIN c USING (lang, source, term)),
pairs AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
part AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN pairs x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
  UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q) // (p + q))::BIGINT FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM part) x WHERE part = 'pair' OR rank <= 10
"""
