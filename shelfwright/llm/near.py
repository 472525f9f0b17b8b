"""Near copies by the Jaccard similarity of their word shingles, one row kept of each class.

Candidates come from two sides:

1. SimHash: the fingerprint of the distinct shingles, linked at ``simhash``'s radius through its grid of segment popcounts.
2. MinHash, for near copies out of that radius (a similarity of 0.8 leaves about 10 of 64 bits different, and grid cells over
   popcounts that cover 10 bits hold a few hundredths of all pairs): the minima of ``BANDS`` x ``ROWS`` permutations are
   taken, and sets that agree in all ``ROWS`` minima of a band meet in a cell. Sets at a similarity of 0.8 fail to meet in
   all cells with a chance of 6e-6, closer ones less.

What shares a cell or a SimHash link is put together to groups, each distinct set travels once to the task of its group,
and there similarity is computed on the sets themselves: none below the threshold is linked.

A group is walked by breadth from one set to those near it, so near copies of one text cost no more than their words; only
sets that stay apart are compared with each other. A group of more than ``LARGE`` sets is cut into blocks: each block is
walked together with the group's first set, and only the sets that are in no class with it there are then compared with the
other blocks, block by block.

Defined cases: null text is empty, and empty texts are one class; a text shorter than a shingle is one shingle as a whole;
A-Z is lowered; rows are kept by row, so rows with a null doc_id or a repeated one stand for themselves; ties go to the
smallest hash of the text, then to the first row read; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, partial
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import simhash
from .common import LOWER, free, materialize
from .components import components

WIDTH, LEAST = 5, 0.8
BANDS, ROWS, SEED = 40, 6, 31
#: Shingles whose permutations are computed at once, and sets that a task compares with each other.
BLOCK, LARGE = 1024, 2048


def shingles(text: str | None, width: int = WIDTH) -> np.ndarray:
    """XXH64 of the distinct word shingles, in order."""
    w = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not w:
        return np.zeros(0, np.uint64)
    words = map(b" ".join, zip(*(w[i:] for i in range(width)))) if len(w) > width else iter([b" ".join(w)])
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, words, repeat(SEED)), np.uint64))


@lru_cache(maxsize=1)
def _permutations() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rng = np.random.default_rng(SEED)
    draw = lambda *n: rng.integers(1, 1 << 63, n, dtype=np.int64).astype(np.uint64)
    return draw(BANDS * ROWS, 1), draw(BANDS * ROWS, 1) << np.uint64(1) | np.uint64(1), draw(BANDS, ROWS) | np.uint64(1)


def cells(s: np.ndarray) -> np.ndarray:
    """Keys of the cells that a set of shingles is entered in."""
    if not len(s):
        return np.zeros(0, np.int64)
    flip, times, mix = _permutations()
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(s), BLOCK):
        np.minimum(least, ((s[at : at + BLOCK] ^ flip) * times).min(axis=1), out=least)
    h = least.reshape(BANDS, ROWS)
    h = ((h ^ (h >> np.uint64(29))) * mix).sum(axis=1, dtype=np.uint64)
    return (h ^ (h >> np.uint64(32))).view(np.int64)


def _sign(batches: Iterator[pa.RecordBatch], text: int, width: int, names: list[str]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        sets = [shingles(t, width) for t in b.column(text).to_pylist()]
        keys = np.array([xxhash.xxh64_intdigest(s.tobytes()) for s in sets], np.uint64).view(np.int64)
        prints = np.array([simhash.of_hashes(s) for s in sets], np.uint64).view(np.int64)
        found = [cells(s) for s in sets]
        offsets = np.append(0, np.cumsum([len(c) for c in found])).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*found, np.zeros(0, np.int64)])))
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(keys), pa.array(prints), lists], names=names)


def walk(sets: list[np.ndarray], least: float = LEAST) -> np.ndarray:
    """The number of the first set of its class, for each set: sets link at a similarity of ``least`` or more."""
    size, label = np.array([len(s) for s in sets]), np.arange(len(sets))
    _, flat = np.unique(np.concatenate(sets), return_inverse=True)
    start = np.append(0, np.cumsum(size))
    other, owner, left = flat, np.repeat(label, size), label.copy()
    mark = np.zeros(int(flat.max(initial=0)) + 1, bool)
    while len(left):
        first, gone, todo = int(left[0]), [int(left[0])], [int(left[0])]
        left = left[1:]
        while todo and len(left):
            i = todo.pop()
            own = flat[start[i] : start[i + 1]]
            mark[own] = True
            both = np.bincount(owner[mark[other]], minlength=len(sets))[left]
            mark[own] = False
            near = both / (size[i] + size[left] - both) >= least
            if near.any():
                new, left = left[near].tolist(), left[~near]
                label[new] = first
                gone += new
                todo += new
                out = np.zeros(len(sets), bool)
                out[gone] = True
                stay = ~out[owner]
                other, owner = other[stay], owner[stay]
    return label


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """The rows of each run of one value of the first column; one is held at a time."""
    held: list[tuple] = []
    for b in batches:
        for row in zip(*(c.to_pylist() for c in b.columns)):
            if held and held[0][0] != row[0]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def _classes(batches: Iterator[pa.RecordBatch], width: int, least: float) -> Iterator[pa.RecordBatch]:
    """Rows (group, key, text) come sorted by group and key; out go the keys and the first key of their class."""
    for rows in _groups(batches):
        at = np.array([k for _, k, _ in rows], np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(at[walk([shingles(t, width) for *_, t in rows], least)])], names=["key", "class"])


def _across(batches: Iterator[pa.RecordBatch], width: int, least: float) -> Iterator[pa.RecordBatch]:
    """Rows (tile, apart, key, class, text) come sorted by tile: sets that stand apart meet the others, and link with the
    classes of those near them, once with each."""
    for rows in _groups(batches):
        one, other = ([r for r in rows if r[1] == x] for x in (True, False))
        if not one or not other:
            continue
        sets = [shingles(r[4], width) for r in other]
        size = np.array(list(map(len, sets)))
        values, flat = np.unique(np.concatenate(sets), return_inverse=True)
        owner, of = np.repeat(np.arange(len(sets)), size), np.array([r[3] for r in other], np.int64)
        a, b = [], []
        for r in one:
            s = shingles(r[4], width)
            mark = np.isin(values, s, assume_unique=True)
            both = np.bincount(owner[mark[flat]], minlength=len(sets))
            for c in np.unique(of[both / (len(s) + size - both) >= least]).tolist():
                a.append(r[2])
                b.append(c)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["key", "class"])


def _large(found: DataFrame, sizes: DataFrame, width: int, least: float, large: int) -> DataFrame:
    """(key, class) of the groups in ``sizes`` (grp, blocks), from found (grp, key, text)."""
    rows = found.join(sizes, "grp").withColumn("b", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
    rows = materialize(rows, "large")
    # the group's first set goes to each of its blocks
    blocks = F.sequence(F.lit(0), F.col("blocks") - 1)
    first = rows.where("key = grp").select("grp", "key", "text", F.explode(blocks).alias("b"))
    dealt = rows.where("key <> grp").select("grp", "key", "text", "b").unionByName(first).select(F.xxhash64("grp", "b").alias("tile"), "key", "text", (F.col("key") != F.col("grp")).alias("rest"))
    dealt = dealt.repartition("tile").sortWithinPartitions("tile", "rest", "key").select("tile", "key", "text")
    near = materialize(dealt.mapInArrow(partial(_classes, width=width, least=least), "key long, class long"), "blocks")
    named = materialize(rows.join(near.where("key <> class"), "key", "left").withColumn("class", F.coalesce("class", "key")), "named")
    apart = named.where(F.col("class") != F.col("grp"))
    portions = apart.groupBy("grp").agg(F.ceil(F.count("*") / large).cast("int").alias("portions"))
    # tiles of a portion of those that stand apart and a block of all
    one = apart.join(portions, "grp").select("grp", F.pmod(F.xxhash64("key"), F.col("portions")).cast("int").alias("p"), F.explode(blocks).alias("b"), F.lit(True).alias("apart"), "key", "class", "text")
    other = named.join(portions, "grp").select("grp", F.explode(F.sequence(F.lit(0), F.col("portions") - 1)).alias("p"), "b", F.lit(False).alias("apart"), "key", "class", "text")
    tiles = one.unionByName(other).select(F.xxhash64("grp", "p", "b").alias("tile"), "apart", "key", "class", "text")
    met = tiles.repartition("tile").sortWithinPartitions("tile").mapInArrow(partial(_across, width=width, least=least), "key long, class long")
    edges = near.unionByName(met).where("key <> class").select(F.col("key").alias("a"), F.col("class").alias("b"))
    return components(edges).select(F.col("id").alias("key"), F.col("component").alias("class"))


def keep_one(docs: DataFrame, width: int = WIDTH, least: float = LEAST, large: int = LARGE) -> DataFrame:
    """The rows of docs, with all their columns, that stand for their class: those with the smallest doc_id, null ids last.

    ``least`` may not be below 0.8, for which the bands are laid out.
    """
    if least < LEAST:
        raise ValueError("the bands are laid out for a similarity of 0.8 or more")
    key, fp, cell, row = free(docs.columns, "near_key", "near_print", "near_cells", "near_row")
    schema = T.StructType([*docs.schema.fields, T.StructField(key, T.LongType()), T.StructField(fp, T.LongType()), T.StructField(cell, T.ArrayType(T.LongType()))])
    signed = docs.mapInArrow(partial(_sign, text=docs.columns.index("text"), width=width, names=schema.names), schema)
    signed = materialize(signed.withColumn(row, F.monotonically_increasing_id()), "signed")

    reps = materialize(signed.groupBy(F.col(fp).alias("fp")).agg(F.min(key).alias("rep"), F.max(key).alias("last")), "prints")
    prints = signed.select(F.col(key).alias("b"), F.col(fp).alias("fp"))
    same = prints.join(reps.where("rep <> last"), "fp").where("rep <> b").select(F.col("rep").alias("a"), "b")
    entries = signed.select(F.col(key).alias("key"), F.explode(cell).alias("cell"))
    shared = entries.groupBy("cell").agg(F.min("key").alias("a"), F.max("key").alias("z")).where("a <> z").select("cell", "a")
    met = entries.join(shared, "cell").where("key <> a").select("a", F.col("key").alias("b"))
    comps = materialize(components(simhash.links(reps).unionByName(same).unionByName(met)), "groups")
    groups = comps.select(F.col("id").alias("key"), F.col("component").alias("grp"))
    groups = groups.union(comps.select(F.col("component").alias("key"), F.col("component").alias("grp")).distinct())

    sizes = comps.groupBy(F.col("component").alias("grp")).count().where(F.col("count") >= large)
    sizes = materialize(sizes.select("grp", F.ceil(F.col("count") * 2 / large).cast("int").alias("blocks")), "sizes")
    one = signed.groupBy(F.col(key).alias("key")).agg(F.min(row).alias("row")).join(groups, "key")
    found = one.join(signed.select(F.col(row).alias("row"), "text"), "row").select("grp", "key", "text")
    dealt = found.join(sizes, "grp", "left_anti").repartition("grp").sortWithinPartitions("grp", "key")
    named = dealt.mapInArrow(partial(_classes, width=width, least=least), "key long, class long").where("key <> class")
    if not sizes.isEmpty():
        named = named.unionByName(_large(found, sizes, width, least, large))
    named = materialize(named, "classes")

    rows = signed.select(F.col(key).alias("key"), F.col("doc_id").isNull().alias("n"), F.col("doc_id").cast("long").alias("i"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"), F.col(row).alias("row"))
    rows = rows.join(named, "key", "left").withColumn("class", F.coalesce("class", "key"))
    kept = rows.groupBy("class").agg(F.min(F.struct("n", "i", "h", "row")).alias("x")).select(F.col("x.row").alias(row))
    return signed.join(kept, row, "left_semi").select(docs.columns)
