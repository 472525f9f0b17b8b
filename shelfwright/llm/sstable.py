"""Token ids in sorted-string-table shards.

Documents are dealt to ranges of doc_id, sorted, encoded, and written as shards of about ``SHARD_BYTES`` each, in ascending
doc_id order over all shards. A shard's sections are rows of a Parquet table in their order (part, file, section, first and
last id, counts, bytes), as only Spark's writers reach every store: one row for each block, then index, Bloom filter and
footer. ``export`` makes plain files of them, the sections one after the other.

Shard layout, little-endian:
  blocks   a zstandard frame and its crc32 (4 bytes); inside, entries of varint(shared key bytes) varint(own key bytes)
           varint(value bytes) key value
  index    per block: last key (8 bytes), offset (8), length (4), ids before the block (8)
  bloom    bits of a Bloom filter over the keys
  footer   offsets of index and bloom, blocks, documents, ids (8 bytes each), id width (4), hashes (4), magic (8)
Keys are the doc_id with its sign bit flipped, big-endian, so that bytes sort as numbers. A lookup asks the Bloom filters of
the shards in range, binary-searches their index for the block, and reads the rows of those blocks alone.

Defined cases: null text is empty and gets the end id alone; a null doc_id has the empty key and comes first; rows that
repeat a doc_id are entries of their own, in order of a hash of the text; ranges are cut by id and hash, so many rows of one
id fill several; very long texts are entries like others; an empty table gives no shard.

Encoding splits the text at single spaces. This pre-tokenizer never joins what stands before such a space to what follows
it, so the pieces' ids, kept in a bounded cache, are the text's ids; texts with adjoining white space or with one of the
tokenizer's special strings are encoded whole.
"""

from __future__ import annotations

import gc
import os
import re
import struct
import zlib
from array import array
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize, table, texts

SHARD_BYTES, BLOCK_BYTES, CACHE, END = 16 << 20, 64 << 10, 400_000, 2
INDEX, BLOOM, FOOTER = 1 << 30, (1 << 30) + 1, (1 << 30) + 2
LONG, PIECE = 64, 8 << 20
ADJOINING = r"[\t-\r\x1c-\x20\x{85}\p{Z}]{2}"
MAGIC = b"SSTIDS02"
_INDEX, _FOOTER = struct.Struct("<8sqIq"), struct.Struct("<qqqqqII8s")
SHARDS = "part int, file int, section int, first_id long, last_id long, n_docs long, n_ids long, bytes binary"
_SHARDS = pa.schema([("part", pa.int32()), ("file", pa.int32()), ("section", pa.int32()), ("first_id", pa.int64()), ("last_id", pa.int64()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("bytes", pa.binary())])


#: Latin letters, then marks without the apostrophe, which opens pre-tokens of its own.
_PLAIN = re.compile("([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+)([.,;:!?$%&*#|]*)").fullmatch


#: The byte-level alphabet: bytes that are not printable Latin-1 move to U+0100 on.
_MOVED = {b: 256 + i for i, b in enumerate(b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255))}


def _visible(text: str) -> str:
    return text.encode().decode("latin-1").translate(_MOVED)


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class Encoder:
    """Ids of texts as little-endian bytes of ``width`` each, the end id last."""

    def __init__(self, path: str, end: int = END):
        self.tokenizer = _tokenizer(path)
        self.width = 2 if max(self.tokenizer.get_vocab_size(), end + 1) <= 1 << 16 else 4
        self.end = end.to_bytes(self.width, "little")
        self.model = self.tokenizer.model
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.pack = partial(array, "H" if self.width == 2 else "I")
        self.marks: dict[str, bytes] = {}
        self.recent: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _bytes(self, texts: list[str]) -> list[bytes]:
        return [self.pack(e.ids).tobytes() for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def _learn(self, pieces: list[str], ids: list[bytes | None]) -> None:
        """Fills in the ids of pieces with a space before each, which are None so far. Letters and then marks are two pre-tokens, which the model takes as they are."""
        run, pack, marks, get, rest = self.model.tokenize, self.pack, self.marks, self.recent.get, []
        for k in [k for k, x in enumerate(ids) if x is None]:
            p = pieces[k]
            if (x := self.old.get(p)) is None and (m := _PLAIN(p)):
                word, mark = m.groups()
                if not mark or (x := get(word)) is None:
                    x = pack([t.id for t in run("\u0120" + (word if word.isascii() else _visible(word)))]).tobytes()
                if mark:
                    if mark not in marks:
                        marks[mark] = pack([t.id for t in run(mark)]).tobytes()
                    x += marks[mark]
            if x is None:
                rest.append(k)
            else:
                ids[k] = x
                if len(p) <= LONG:
                    self.recent[p] = x
        for k, x in zip(rest, self._bytes([" " + pieces[k] for k in rest])):
            ids[k] = x
            if len(pieces[k]) <= LONG:
                self.recent[pieces[k]] = x
        if len(self.recent) > CACHE:  # what was met since the last time stays
            self.old, self.recent = self.recent, {}

    def encode(self, texts: pa.Array) -> pa.Array:
        """A binary array of the ids of a string array; splitting, deduplication and joining stay in Arrow."""
        gap = pc.match_substring_regex(texts, ADJOINING)
        for x in self.special:
            gap = pc.or_(gap, pc.match_substring(texts, x))
        lists = pc.split_pattern(pc.if_else(gap, "", texts), " ")
        values, edge = lists.values, lists.offsets.to_numpy()
        coded = values.dictionary_encode()
        pieces = coded.dictionary.to_pylist()
        ids = list(map(self.recent.get, pieces))
        self._learn(pieces, ids)
        heads = values.take(pa.array(edge[:-1])).to_pylist()
        whole = np.flatnonzero(gap.to_numpy(zero_copy_only=False)).tolist()
        for k in whole:
            heads[k] = texts[k].as_py()
        code = coded.indices.to_numpy().copy()
        first: dict[str, int] = {}
        code[edge[:-1]] = [first.setdefault(h, len(ids) + len(first)) for h in heads]
        ids += self._bytes(list(first))
        code = np.insert(code, edge[1:], len(ids))
        joined = pa.array([*ids, self.end], pa.large_binary()).take(pa.array(code))
        at = np.frombuffer(joined.buffers()[1], np.int64)[: len(joined) + 1][np.append(edge, 0)[: len(edge)] + np.arange(len(edge))]
        return pa.Array.from_buffers(pa.binary(), len(texts), [None, pa.py_buffer(at.astype(np.int32).tobytes()), joined.buffers()[2]])


@lru_cache(maxsize=1)
def _encoder(path: str, end: int) -> Encoder:
    return Encoder(path, end)


def key_of(doc_id: int | None) -> bytes:
    return b"" if doc_id is None else (doc_id + (1 << 63)).to_bytes(8, "big")


def id_of(key: bytes) -> int | None:
    return int.from_bytes(key, "big") - (1 << 63) if key else None


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(b: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        c = b[at]
        at += 1
        n |= (c & 127) << shift
        if c < 128:
            return n, at
        shift += 7


def _probes(key: bytes, bits: int, hashes: int) -> list[int]:
    h = xxhash.xxh64_intdigest(key)
    return [((h & 0xFFFFFFFF) + i * (h >> 32 | 1)) % bits for i in range(hashes)]


class Writer:
    """Builds one shard from entries in key order; ``sections`` are (section, first key, last key, documents, ids, bytes)."""

    def __init__(self, width: int):
        self.width, self.block, self.sections, self.index, self.keys = width, bytearray(), [], [], []
        self.last, self.ids, self.at, self.before, self.packer = b"", 0, 0, (0, 0), zstandard.ZstdCompressor(level=1)

    def add(self, key: bytes, ids: bytes) -> None:
        if len(self.block) >= BLOCK_BYTES:
            self._close()
        shared = 0
        if self.block:
            while shared < min(len(key), len(self.last)) and key[shared] == self.last[shared]:
                shared += 1
        self.block += _varint(shared) + _varint(len(key) - shared) + _varint(len(ids)) + key[shared:] + ids
        self.last = key
        self.keys.append(key)
        self.ids += len(ids) // self.width

    def _close(self) -> None:
        frame = self.packer.compress(bytes(self.block))
        frame += zlib.crc32(frame).to_bytes(4, "little")
        docs, ids = self.before
        self.index.append(_INDEX.pack(self.last.rjust(8, b"\0"), self.at, len(frame), ids))
        self.sections.append((len(self.sections), self.keys[docs], self.last, len(self.keys) - docs, self.ids - ids, frame))
        self.at += len(frame)
        self.block, self.before = bytearray(), (len(self.keys), self.ids)

    def size(self) -> int:
        return self.at + len(self.block)

    def finish(self) -> list[tuple]:
        if self.block:
            self._close()
        bits, hashes = max(64, -(-len(self.keys) * 10 // 8) * 8), 7
        bloom = bytearray(bits // 8)
        for k in self.keys:
            for p in _probes(k, bits, hashes):
                bloom[p >> 3] |= 1 << (p & 7)
        index = b"".join(self.index)
        footer = _FOOTER.pack(self.at, self.at + len(index), len(self.index), len(self.keys), self.ids, self.width, hashes, MAGIC)
        more = [(n, self.keys[0], self.last, len(self.keys), self.ids, x) for n, x in ((INDEX, index), (BLOOM, bytes(bloom)), (FOOTER, footer))]
        return self.sections + more


def entries(block: bytes, width: int) -> Iterator[tuple[bytes, np.ndarray]]:
    """Keys and ids of a block."""
    if zlib.crc32(block[:-4]) != int.from_bytes(block[-4:], "little"):
        raise ValueError("a block is damaged")
    b, at, key = zstandard.ZstdDecompressor().decompress(block[:-4]), 0, b""
    while at < len(b):
        shared, at = _read_varint(b, at)
        own, at = _read_varint(b, at)
        n, at = _read_varint(b, at)
        key = key[:shared] + b[at : at + own]
        yield key, np.frombuffer(b[at + own : at + own + n], f"<u{width}")
        at += own + n


class Reader:
    """One shard; ``bytes`` may be a memory map. Without its blocks (``tail``: index, Bloom filter and footer) it tells where to read."""

    def __init__(self, data: bytes, tail: bool = False):
        self.data = memoryview(data)
        index_at, bloom_at, self.blocks, self.n_docs, self.n_ids, self.width, self.hashes, magic = _FOOTER.unpack_from(self.data, len(data) - _FOOTER.size)
        if magic != MAGIC:
            raise ValueError("not a shard")
        self.bloom_at = bloom_at - index_at * tail
        self.index = [_INDEX.unpack_from(self.data, index_at * (not tail) + i * _INDEX.size) for i in range(self.blocks)]

    def _block(self, k: int) -> Iterator[tuple[bytes, np.ndarray]]:
        _, at, n, _ = self.index[k]
        return entries(bytes(self.data[at : at + n]), self.width)

    def __iter__(self) -> Iterator[tuple[int | None, np.ndarray]]:
        for k in range(self.blocks):
            for key, ids in self._block(k):
                yield id_of(key), ids

    def may_hold(self, key: bytes) -> bool:
        bits = (len(self.data) - _FOOTER.size - self.bloom_at) * 8
        return all(self.data[self.bloom_at + (p >> 3)] >> (p & 7) & 1 for p in _probes(key, bits, self.hashes))

    def blocks_of(self, key: bytes) -> range:
        """The blocks that may hold the key: from the first that ends at or after it to the first that ends after it."""
        if not self.may_hold(key):
            return range(0)
        padded, last = key.rjust(8, b"\0"), lambda e: e[0]
        return range(bisect_left(self.index, padded, key=last), min(self.blocks, bisect_right(self.index, padded, key=last) + 1))

    def get(self, doc_id: int | None) -> list[np.ndarray]:
        """The ids of every entry with that doc_id."""
        key = key_of(doc_id)
        return [ids for k in self.blocks_of(key) for own, ids in self._block(k) if own == key]


def _write(batches: Iterator[pa.RecordBatch], path: str, end: int, shard_bytes: int) -> Iterator[pa.RecordBatch]:
    gc.disable()  # many small objects, no cycles
    encoder, part, file = _encoder(path, end), TaskContext.get().partitionId(), 0
    writer = Writer(encoder.width)

    def done() -> pa.RecordBatch:
        rows = [(part, file, n, id_of(first), id_of(last), docs, ids, x) for n, first, last, docs, ids, x in writer.finish()]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _SHARDS)], schema=_SHARDS)

    for b in batches:
        size = np.cumsum(pc.binary_length(b.column(1)).to_numpy(zero_copy_only=False)) // PIECE
        cut = [0, *(np.flatnonzero(np.diff(size)) + 1).tolist(), b.num_rows]
        for start, stop in zip(cut, cut[1:]):
            if stop == start:
                continue
            x = b.slice(start, stop - start)
            for doc_id, ids in zip(x.column(0).to_pylist(), encoder.encode(x.column(1)).to_pylist()):
                if writer.size() >= shard_bytes:
                    yield done()
                    writer, file = Writer(encoder.width), file + 1
                writer.add(key_of(doc_id), ids)
    if writer.keys:
        yield done()


def write_shards(docs: DataFrame, path: str, end: int = END, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Encodes (doc_id, text) with the tokenizer file at ``path`` and returns the written table of shards."""
    docs = texts(docs)
    total = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    order = [F.col("doc_id"), F.xxhash64("text")]
    dealt = docs.repartitionByRange(int(max(1, -(-total // shard_bytes))), *order).sortWithinPartitions(*order, "text")
    return materialize(dealt.mapInArrow(partial(_write, path=path, end=end, shard_bytes=shard_bytes), SHARDS), "shards")


_READ = pa.schema([("part", pa.int32()), ("file", pa.int32()), ("section", pa.int32()), ("doc_id", pa.int64()), ("before", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


def _digest(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for part, file, section, n, data in zip(*(c.to_pylist() for c in b.columns)):
            out, before = [], 0
            for key, ids in entries(data, width):
                out.append((part, file, section, id_of(key), before, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                before += len(ids)
            if before != n:
                raise ValueError(f"block {part}/{file}/{section}: table and entries disagree")
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _READ)], schema=_READ)


def documents_of(shards: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) read from the blocks; start counts the ids of all documents before, by sums over parts, then over a part's blocks."""
    footer = shards.where(F.col("section") == FOOTER).select("bytes").first()
    width = _FOOTER.unpack(footer["bytes"])[5] if footer else 2
    blocks = shards.where(F.col("section") < INDEX)
    sizes = blocks.groupBy("part").agg(F.sum("n_ids").alias("n"))
    parts = sizes.select(F.col("part").alias("p"), F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    within = W.partitionBy("part").orderBy("file", "section").rowsBetween(W.unboundedPreceding, -1)
    base = blocks.select("part", "file", "section", F.coalesce(F.sum("n_ids").over(within), F.lit(0)).alias("own"))
    base = base.join(parts, base["part"] == parts["p"]).select("part", "file", "section", (F.col("base") + F.col("own")).alias("base"))
    read = blocks.select("part", "file", "section", "n_ids", "bytes").mapInArrow(partial(_digest, width=width), "part int, file int, section int, doc_id long, before long, n_tokens long, ids_crc32 long")
    return read.join(base, ["part", "file", "section"]).select("doc_id", (F.col("base") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def lookup(shards: DataFrame, ids: list[int]) -> DataFrame:
    """(doc_id, ids) of the listed documents. Index, Bloom filter and footer of the shards whose range holds one tell the blocks; only their rows are read."""
    want, spark = sorted(set(ids)), shards.sparkSession
    inside = (F.col("first_id") <= max(want, default=0)) & (F.col("last_id") >= min(want, default=0))  # reaches the scan
    cond = F.col("first_id").isNull() | inside & F.exists(F.array(*map(F.lit, want)).cast("array<long>"), lambda i: (F.col("first_id") <= i) & (F.col("last_id") >= i))
    tails = shards.where((F.col("section") >= INDEX) & cond).groupBy("part", "file").agg(F.sort_array(F.collect_list(F.struct("section", "bytes"))).alias("x"))
    blocks: list[tuple[int, int, int]] = []  # a few for each id
    width = 2
    for r in tails.toLocalIterator():
        reader = Reader(b"".join(bytes(x["bytes"]) for x in r["x"]), True)
        width = reader.width
        blocks += ((r["part"], r["file"], k) for k in sorted({k for i in want for k in reader.blocks_of(key_of(i))}))
    wanted = F.broadcast(spark.createDataFrame(blocks, shards.select("part", "file", "section").schema))

    def get(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = {key_of(i) for i in want}
        for b in batches:
            out = [(id_of(key), x.tolist()) for data in b.column(0).to_pylist() for key, x in entries(data, width) if key in keys]
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in out], pa.int64()), pa.array([x for _, x in out], pa.list_(pa.int64()))], names=["doc_id", "ids"])

    return shards.join(wanted, ["part", "file", "section"], "left_semi").select("bytes").mapInArrow(get, "doc_id long, ids array<long>")


def export(shards: DataFrame, folder: str) -> list[str]:
    """Plain files of the shards in a folder of the driver, section by section."""
    os.makedirs(folder, exist_ok=True)
    names: list[str] = []
    for r in shards.orderBy("part", "file", "section").select("part", "file", "bytes").toLocalIterator():
        name = f"{folder}/{r['part']:06d}-{r['file']:04d}.sst"
        new = not names or names[-1] != name
        names += [name] * new
        with open(name, "wb" if new else "ab") as f:
            f.write(r["bytes"])
    return names


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op2_sstable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place and digest, read back from the shards written of all documents."""
    return documents_of(write_shards(table(spark, sf_dir, "documents"), default_tokenizer()))
