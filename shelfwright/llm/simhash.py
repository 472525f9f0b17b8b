"""SimHash near-duplicates found by a segment-popcount embedding.

A 64-bit fingerprint is cut into 16 segments of 4 bits and mapped to the vector of their bit counts. One differing bit
changes one coordinate by one, so the Manhattan distance of two vectors is a lower bound of the Hamming distance of the
fingerprints. Vectors at a distance of 2 or less have a lattice point within 1 of both: each distinct fingerprint is
therefore entered in the grid cell of its own vector and in those one step away (33 at most), and fingerprints meet in a
cell. The cells keep about 30 of the 64 bits, which leaves few chance meetings; those that meet are verified on the bits.

A cell gives the edges of a spanning forest of its links, never all pairs, and copies of a fingerprint count once, so
a group of thousands costs no more than its members. Large cells are cut by equal thirds of the bits first (two
differing bits leave one third equal), which loses no link.

Defined cases: null text is empty, an empty text has fingerprint zero and links like any other; documents with a null
doc_id link classes like others but never name one (the component of a class of null ids alone is null); rows that repeat a doc_id are one node.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, batch, materialize, table, texts
from .components import components

SEGMENTS = 16
#: Shingles hashed at once, and fingerprints of a cell compared without cutting it.
BLOCK, LARGE = 1 << 16, 2048
THIRDS = tuple(np.uint64(x) for x in (0x1FFFFF, 0x1FFFFF << 21, 0x3FFFFF << 42))

#: From here on numbers stand for fingerprints whose rows have null ids only: above all ids, they name no component with others.
NAMELESS = (1 << 63) - (1 << 48)

_FP = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])
_EDGE = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def fingerprint(text: str, width: int = 3, seed: int = 42) -> int:
    """Bit i is set if it is set in over half of the XXH64 of the word shingles, repeats included."""
    w = text.encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not w:
        return 0
    shingles = map(b" ".join, zip(*(w[i:] for i in range(width)))) if len(w) > width else iter([b" ".join(w)])
    n, ones = max(1, len(w) - width + 1), np.zeros(64, np.int64)
    hashes = map(xxhash.xxh64_intdigest, shingles, repeat(seed))
    for at in range(0, n, BLOCK):
        ones += _ones(np.fromiter(hashes, np.uint64, min(BLOCK, n - at)))
    return _majority(ones, n)


def _ones(h: np.ndarray) -> np.ndarray:
    return np.unpackbits(h.view(np.uint8), bitorder="little").reshape(-1, 64).sum(axis=0, dtype=np.int64)


def _majority(ones: np.ndarray, n: int) -> int:
    return int(np.packbits(ones * 2 > n, bitorder="little").view(np.uint64)[0])


def of_hashes(h: np.ndarray) -> int:
    """The fingerprint of 64-bit hashes; of none, zero."""
    return _majority(sum((_ones(h[at : at + BLOCK]) for at in range(0, len(h), BLOCK)), np.zeros(64, np.int64)), len(h))


def _fingerprints(batches: Iterator[pa.RecordBatch], width: int, seed: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        fp = np.array([fingerprint(t, width, seed) for t in b.column(1).to_pylist()], np.uint64)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], schema=_FP)


def fingerprints(docs: DataFrame, width: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed long."""
    return texts(docs).mapInArrow(partial(_fingerprints, width=width, seed=seed), "doc_id long, fp long")


def cells(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the fingerprint and key of the cell, for each cell that a fingerprint is entered in."""
    at, keys = [np.arange(len(fp))], [np.zeros(len(fp), np.int64)]
    counts = [np.bitwise_count((fp >> np.uint64(4 * s)) & np.uint64(15)).astype(np.int64) for s in range(SEGMENTS)]
    for s, c in enumerate(counts):
        keys[0] |= c << (3 * s)
    for s, c in enumerate(counts):
        for step, ok in ((1, c < 4), (-1, c > 0)):
            at.append(np.flatnonzero(ok))
            keys.append(keys[0][ok] + (step << (3 * s)))
    return np.concatenate(at), np.concatenate(keys)


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        fp = b.column(0).to_numpy().view(np.uint64)
        at, key = cells(fp)
        yield pa.RecordBatch.from_arrays([pa.array(key), b.column(0).take(pa.array(at)), b.column(1).take(pa.array(at))], names=["cell", "fp", "rep"])


def forest(fp: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Spanning forest of the links between the fingerprints, as index pairs."""
    if len(fp) > LARGE and most == 2:
        found = []
        for mask in THIRDS:
            order = np.argsort(fp & mask, kind="stable")
            cut = np.flatnonzero(np.diff(fp[order] & mask)) + 1
            for run in np.split(order, cut):
                if len(run) > 1:
                    found += [(int(run[i]), int(run[j])) for i, j in _walk(fp[run], most)]
        return found
    return _walk(fp, most)


def _walk(fp: np.ndarray, most: int) -> list[tuple[int, int]]:
    left, found = np.arange(len(fp)), []
    while len(left) > 1:
        todo, left = [int(left[0])], left[1:]
        while todo and len(left):
            i = todo.pop()
            near = np.bitwise_count(fp[left] ^ fp[i]) <= most
            if near.any():
                new, left = left[near].tolist(), left[~near]
                found += [(i, j) for j in new]
                todo += new
    return found


def _links(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Edges of the cells; the rows come sorted by cell, and one cell may reach over several batches."""

    def edges(cell: np.ndarray, fp: np.ndarray, rep: np.ndarray):
        ends = np.append(np.flatnonzero(np.diff(cell)) + 1, len(cell))
        starts = np.append(0, ends[:-1])
        two = ends - starts == 2
        s = starts[two]
        s = s[np.bitwise_count(fp[s] ^ fp[s + 1]) <= most]
        a, b = [rep[s]], [rep[s + 1]]
        for i, j in zip(starts[ends - starts > 2].tolist(), ends[ends - starts > 2].tolist()):
            if pairs := forest(fp[i:j], most):
                p = np.array(pairs) + i
                a.append(rep[p[:, 0]])
                b.append(rep[p[:, 1]])
        return batch(_EDGE, {"a": np.concatenate(a), "b": np.concatenate(b)})

    held: list[tuple] = []
    for x in batches:
        cell, fp, rep = x.column(0).to_numpy(), x.column(1).to_numpy().view(np.uint64), x.column(2).to_numpy()
        if not len(cell):
            continue
        cut = int(np.searchsorted(cell, cell[-1], "left"))
        if cut:
            held.append((cell[:cut], fp[:cut], rep[:cut]))
            yield edges(*map(np.concatenate, zip(*held)))
            held = []
        held.append((cell[cut:], fp[cut:], rep[cut:]))
    if held:
        yield edges(*map(np.concatenate, zip(*held)))


def links(reps: DataFrame, most: int = 2) -> DataFrame:
    """(a, b): spanning forests of the links between distinct fingerprints (fp, rep), as pairs of their representatives."""
    if most > 2:
        raise ValueError("cells one step wide find links of up to 2 differing bits")
    entered = reps.select("fp", "rep").mapInArrow(_entries, "cell long, fp long, rep long")
    return entered.repartition("cell").sortWithinPartitions("cell").mapInArrow(partial(_links, most=most), "a long, b long")


def classes(prints: DataFrame, most: int = 2) -> DataFrame:
    """(doc_id, fp, component_id) from (doc_id, fp): fingerprints link at ``most`` (2 at most) or fewer differing bits."""
    rep = F.coalesce(F.min("doc_id"), NAMELESS + F.pmod(F.xxhash64("fp"), F.lit((1 << 48) - 1)))
    reps = materialize(prints.groupBy("fp").agg(rep.alias("rep")), "reps")
    same = prints.groupBy("doc_id").agg(F.min("fp").alias("x"), F.max("fp").alias("y")).where("doc_id is not null and x <> y").select("doc_id")
    repeated = prints.join(same, "doc_id").join(reps, "fp").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    comps = components(links(reps, most).union(repeated))
    component = F.coalesce("component", "rep")
    named = reps.join(comps, reps["rep"] == comps["id"], "left").select("fp", F.when(component < NAMELESS, component).alias("component_id"))
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")


def near_duplicates(docs: DataFrame, width: int = 3, most: int = 2) -> DataFrame:
    """(doc_id, fp, component_id) of every document."""
    return classes(materialize(fingerprints(docs, width), "prints"), most)


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and class of every document."""
    d = near_duplicates(table(spark, sf_dir, "documents"))
    return d.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
