"""Embedding near-duplicates by hashing to the E8 lattice.

Equal vectors are put together first. Each distinct direction is projected to ``BLOCKS`` times 8 dimensions at random, scaled
and shifted, each 8 are decoded to the nearest point of E8, and the points together name a cell; that is done ``TABLES``
times. A vector is entered in its cell and in the ``PROBES`` cells that come from moving one of the points to a neighbouring
lattice point, the nearest ones first; vectors meet in a cell and are verified by cosine in double precision. The entries are
wide enough that pairs at the threshold itself meet with a chance of about 0.97, closer ones almost surely, while random
pairs meet with one of 2e-6 (measured in the tests); none below the threshold is linked.

Cells travel as numbers first. Those with one member go, and of cells with the same members one stays; only to these are the
vectors sent. A cell compares its members by blocks of a matrix product and gives sums, not pairs: for each member the links
for which this is the smallest cell that both vectors are entered in, so that each link counts once over all cells, and the
edges of a spanning forest. Cells of more than ``LARGE`` members are dealt out by pairs of blocks to tasks of their own.

Defined cases: vectors that are null, zero, empty, or hold null or non-finite components link with nothing, as do vectors
of different length; copies link with each other; rows that repeat a vec_id are one node with links of their own; a null
vec_id counts as a link of others but names no component (its own is then null, as kept); components of any finite size
count; an empty table gives an empty one; other columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, partial
from itertools import combinations, product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, table
from .components import components

TABLES, BLOCKS, PROBES, SCALE, SEED = 4, 3, 16, 1.7, 29
LARGE, TILE = 4096, 1024
#: From here on numbers stand for the ids of vectors whose rows have null ids only: above all ids, they name no component with others.
NAMELESS = (1 << 63) - (1 << 48)


def _minimal() -> np.ndarray:
    """The 240 shortest vectors of E8."""
    out = []
    for (i, j), signs in product(combinations(range(8), 2), product((1, -1), repeat=2)):
        v = np.zeros(8)
        v[[i, j]] = signs
        out.append(v)
    out += [np.array(s) for s in product((0.5, -0.5), repeat=8) if sum(x < 0 for x in s) % 2 == 0]
    return np.array(out)


def _d8(x: np.ndarray) -> np.ndarray:
    """Nearest points with integer coordinates of even sum."""
    f, row = np.rint(x), np.arange(len(x))
    worst = np.abs(x - f).argmax(axis=1)
    odd = f.sum(axis=1) % 2 != 0
    f[row[odd], worst[odd]] += np.where(x[row, worst] >= f[row, worst], 1, -1)[odd]
    return f


def decode(x: np.ndarray) -> np.ndarray:
    """Nearest E8 points."""
    a, b = _d8(x), _d8(x - 0.5) + 0.5
    return np.where((((x - a) ** 2).sum(axis=1) <= ((x - b) ** 2).sum(axis=1))[:, None], a, b)


@lru_cache(maxsize=8)
def _projections(dim: int, tables: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    rng = np.random.default_rng([SEED, dim])
    mix = rng.integers(1, 1 << 62, (BLOCKS, 8), dtype=np.int64) | 1
    return rng.normal(size=(tables, BLOCKS, dim, 8)) / np.sqrt(8), rng.uniform(0, 2, (tables, BLOCKS, 8)), _minimal(), mix


def entries(unit: np.ndarray, tables: int = TABLES, probes: int = PROBES) -> np.ndarray:
    """(vectors, tables, probes + 1) cell keys, those of each table in an interval of its own."""
    planes, shifts, minimal, mix = _projections(unit.shape[1], tables)
    moves = np.concatenate([(np.rint(2 * minimal).astype(np.int64) * m).sum(axis=1) for m in mix])
    out = np.empty((len(unit), tables, probes + 1), np.int64)
    for t in range(tables):
        h, gain = np.zeros(len(unit), np.int64), []
        for k in range(BLOCKS):
            p = SCALE * (unit @ planes[t, k]) + shifts[t, k]
            c = decode(p)
            h += (np.rint(2 * c).astype(np.int64) * mix[k]).sum(axis=1)
            gain.append((p - c) @ minimal.T)
        near = np.argpartition(-np.concatenate(gain, axis=1), probes - 1, axis=1)[:, :probes]
        h = np.concatenate([h[:, None], h[:, None] + moves[near]], axis=1)
        h ^= (h >> 31) & 0xFFFFFFFF
        out[:, t] = (h * 0x2545F4914F6CDD1D & ((1 << 56) - 1)) + (t << 56)
    return out


def units(keys: list[bytes], kind: str) -> np.ndarray:
    """Unit vectors from the bytes of vectors of one length."""
    x = np.frombuffer(b"".join(keys), kind).reshape(len(keys), -1).astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)  # so that no square overflows or vanishes
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _keys(batches: Iterator[pa.RecordBatch], kind: str) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = []
        for v in b.column(1).to_pylist():
            x = np.array(v, kind) if v and None not in v else np.zeros(1)
            out.append(x.tobytes() if np.isfinite(x).all() and x.any() else None)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], names=["vec_id", "key"])


def _enter(batches: Iterator[pa.RecordBatch], kind: str, tables: int, probes: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        keys = b.column(0).to_pylist()
        for n in sorted(set(map(len, keys))):
            for at in range(0, len(own := [i for i, k in enumerate(keys) if len(k) == n]), 2048):
                some = own[at : at + 2048]
                cells = entries(units([keys[i] for i in some], kind), tables, probes).reshape(len(some), -1)
                yield pa.RecordBatch.from_arrays([pa.array(cells.ravel()), b.column(1).take(pa.array(np.repeat(some, cells.shape[1])))], names=["cell", "uid"])


def _first_here(e: np.ndarray, i: np.ndarray, j: np.ndarray, cell: int) -> np.ndarray:
    """Whether no smaller cell than ``cell`` holds both vectors, for index pairs into the entries ``e``."""
    own, ok = cell >> 56, np.ones(len(i), bool)
    for t in range(own + 1):
        live = np.flatnonzero(ok)
        for at in range(0, len(live), 1 << 16):
            some = live[at : at + (1 << 16)]
            a, b = e[i[some], t], e[j[some], t]
            same = np.zeros(len(some), bool)
            for p in range(a.shape[1]):
                hit = (b == a[:, p : p + 1]).any(axis=1)
                same |= hit & (a[:, p] < cell) if t == own else hit
            ok[some[same]] = False
    return ok


def _compare(cell: int, keys: list[bytes], rep: np.ndarray, copies: np.ndarray, side: np.ndarray, kind: str, least: float, tables: int, probes: int):
    """(representatives, links first found here, edge ends) of a cell's members; sides 1 and 2 meet each other only."""
    links, ends, own = np.zeros(len(keys), np.int64), np.arange(len(keys)), np.array([len(k) for k in keys])
    for n in np.unique(own):
        m = np.flatnonzero(own == n)
        if len(m) < 2:
            continue
        x, pairs = units([keys[k] for k in m], kind), []
        for a in range(0, len(m), TILE):
            for b in range(a, len(m), TILE):
                i, j = np.nonzero(x[a : a + TILE] @ x[b : b + TILE].T >= least)
                i, j = i + a, j + b
                ok = (i < j) & ((side[m[i]] == 0) | (side[m[i]] != side[m[j]]))
                pairs.append((i[ok], j[ok]))
        i, j = (np.concatenate(p) for p in zip(*pairs))
        if not len(i):
            continue
        used = np.unique(np.concatenate([i, j]))
        e = np.zeros((len(m), tables, probes + 1), np.int64)
        e[used] = entries(x[used], tables, probes)
        first = _first_here(e, i, j, cell)
        np.add.at(links, m[i[first]], copies[m[j[first]]])
        np.add.at(links, m[j[first]], copies[m[i[first]]])
        label = np.arange(len(m))
        while True:
            new = label.copy()
            np.minimum.at(new, j, label[i])
            np.minimum.at(new, i, label[j])
            new = new[new]
            if (new == label).all():
                break
            label = new
        ends[m] = m[label]
    return rep, links, rep[ends]


def _cells(batches: Iterator[pa.RecordBatch], kind: str, least: float, tables: int, probes: int) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by (cell, p, q); one group is held at a time."""
    group, held = None, []

    def done():
        if len(held) > 1:
            _, keys, rep, copies, uid, side = zip(*held)
            r, n, e = _compare(group[0], list(keys), np.array(rep), np.array(copies), np.array(side), kind, least, tables, probes)
            keep = (n > 0) | (r != e)
            if keep.any():
                yield pa.RecordBatch.from_arrays([pa.array(x[keep], pa.int64()) for x in (np.array(uid), n, r, e)], names=["uid", "links", "rep", "other"])

    for b in batches:
        cell, p, q = (b.column(k).to_numpy() for k in range(3))
        cut = [0, *(np.flatnonzero((np.diff(cell) != 0) | (np.diff(p) != 0) | (np.diff(q) != 0)) + 1).tolist(), len(cell)]
        for s, e in zip(cut, cut[1:]):
            if s == e:
                continue
            if group != (now := (int(cell[s]), int(p[s]), int(q[s]))):
                yield from done()
                group, held = now, []
            if e - s > 1 or held or e == len(cell):
                held += zip(*(b.column(k).slice(s, e - s).to_pylist() for k in (0, 3, 4, 5, 6, 7)))
    yield from done()


def links(vectors: DataFrame, least: float = 0.95, tables: int = TABLES, probes: int = PROBES, large: int = LARGE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) per row of vectors (vec_id, embedding)."""
    kind = "<f4" if dict(vectors.dtypes)["embedding"] == "array<float>" else "<f8"
    source = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding" if kind == "<f4" else F.col("embedding").cast("array<double>"))
    v = materialize(source.mapInArrow(partial(_keys, kind=kind), "vec_id long, key binary"), "vectors")
    d = v.where("key is not null").groupBy("key").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"))
    rep = F.coalesce("rep", NAMELESS + F.pmod(F.xxhash64("key"), F.lit((1 << 48) - 1)))
    d = materialize(d.select("key", rep.alias("rep"), "copies", F.monotonically_increasing_id().alias("uid")), "distinct")
    entered = materialize(d.select("key", "uid").mapInArrow(partial(_enter, kind=kind, tables=tables, probes=probes), "cell long, uid long"), "entries")
    h = F.xxhash64("uid")
    shared = entered.groupBy("cell").agg(F.count("*").alias("n"), F.bit_xor(h).alias("x"), F.sum(F.shiftright(h, 24)).alias("y")).where("n > 1")
    shared = shared.groupBy("n", "x", "y").agg(F.min("cell").alias("cell"))  # cells with the same members tell the same
    shared = shared.select("cell", F.when(F.col("n") > large, F.ceil(F.col("n") * 2 / large)).otherwise(1).cast("int").alias("blocks"))
    rows = entered.join(shared, "cell").join(d, "uid")
    rows = rows.withColumn("b", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    side = F.when(F.col("b") == F.col("o"), 0).when(F.col("b") < F.col("o"), 1).otherwise(2)
    rows = rows.select("cell", F.least("b", "o").alias("p"), F.greatest("b", "o").alias("q"), "key", "rep", "copies", "uid", side.alias("side"))
    dealt = rows.repartition("cell", "p", "q").sortWithinPartitions("cell", "p", "q")
    run = partial(_cells, kind=kind, least=least, tables=tables, probes=probes)
    found = materialize(dealt.mapInArrow(run, "uid long, links long, rep long, other long"), "links")
    n = found.groupBy("uid").agg(F.sum("links").alias("links"))
    same = v.where("key is not null").groupBy("vec_id").agg(F.min("key").alias("x"), F.max("key").alias("y")).where("vec_id is not null and x <> y").select("vec_id")
    repeated = v.join(same, "vec_id").join(d, "key").select(F.col("vec_id").alias("rep"), F.col("rep").alias("other"))
    comps = components(found.select("rep", "other").union(repeated), "rep", "other")
    d = d.join(n, "uid", "left").join(comps.withColumnRenamed("id", "rep"), "rep", "left")
    d = d.select("key", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component"))
    out = v.join(d, "key", "left")
    component = F.when(F.col("component") >= NAMELESS, F.col("vec_id")).otherwise(F.coalesce("component", "vec_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), component.alias("component_id"), (F.col("vec_id") == component).alias("kept"))


def op9_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all vectors."""
    return links(table(spark, sf_dir, "embeddings"))


OP9_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
), u AS (
  SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS norm FROM v WHERE e IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_dot_product(e, e) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id < b.vec_id AND len(a.e) = len(b.e) AND list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.95
), both_ways AS (
  SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach AS (
  SELECT a, b FROM both_ways UNION SELECT reach.a, both_ways.b FROM reach JOIN both_ways ON reach.b = both_ways.a
), least AS (
  SELECT a, min(b) AS m FROM reach GROUP BY 1
), n AS (
  SELECT a, count(*) AS n FROM both_ways GROUP BY 1
)
SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, coalesce(m, vec_id)) AS component_id, coalesce(m, vec_id) >= vec_id AS kept
FROM embeddings LEFT JOIN n ON n.a = vec_id LEFT JOIN least ON least.a = vec_id
"""
