"""Page indexes of archives, and plans to split omnibus files. Central directories are read, never whole archives."""

from __future__ import annotations

import re
import struct
import zipfile
from collections.abc import Iterator
from datetime import datetime

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from ..functions.schema import ddl
from ..functions.volumes import find_volume

_IMAGE = re.compile(r"\.(jpe?g|png|gif|webp|avif|bmp)$", re.I)
_NESTED = re.compile(r"\.(zip|cbz|rar|cbr)$", re.I)


class ArchiveError(ValueError):
    """An archive that cannot be read, with the reason."""


def natural_order(name: str) -> list:
    """Digit runs as numbers, case folded, the spelling itself last."""
    return [*((0, int(p), "") if p.isdigit() else (1, 0, p.lower()) for p in re.findall("[0-9]+|[^0-9]+", name)), (2, 0, name)]


def _name(info: zipfile.ZipInfo) -> str:
    """Names without the UTF-8 flag are CP932 unless they are plain."""
    if info.flag_bits & 0x800:
        return info.filename
    raw = info.filename.encode("cp437", "replace")
    for code in ("utf-8", "cp932"):
        try:
            return raw.decode(code)
        except UnicodeDecodeError:
            continue
    return info.filename


def members(path: str) -> list[dict]:
    """name, bytes, packed, method, crc of each file in a ZIP; an encrypted member refuses the whole."""
    try:
        with zipfile.ZipFile(path) as z:
            infos = [i for i in z.infolist() if not i.is_dir()]
    except (OSError, zipfile.BadZipFile) as e:
        raise ArchiveError(str(e)) from e
    if any(i.flag_bits & 1 for i in infos):
        raise ArchiveError("encrypted")
    return [{"name": _name(i), "bytes": i.file_size, "packed": i.compress_size, "method": i.compress_type, "crc": i.CRC} for i in infos]


def read_member(path: str, name: str) -> bytes:
    """The bytes of a stored or deflated member."""
    with zipfile.ZipFile(path) as z:
        info = next((i for i in z.infolist() if _name(i) == name), None)
        if info is None or info.flag_bits & 1 or info.compress_type not in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED):
            raise ArchiveError(f"cannot read {name}")
        return z.read(info)


def packed_member(path: str, name: str) -> tuple[int, int, int]:
    """Where a member's packed bytes begin in the file, how many they are, and how they are packed."""
    with zipfile.ZipFile(path) as z, open(path, "rb") as f:
        info = next((i for i in z.infolist() if _name(i) == name), None)
        if info is None or info.flag_bits & 1:
            raise ArchiveError(f"cannot read {name}")
        f.seek(info.header_offset + 26)
        sizes = f.read(4)  # of the name and of what follows it
        return info.header_offset + 30 + int.from_bytes(sizes[:2], "little") + int.from_bytes(sizes[2:], "little"), info.compress_size, info.compress_type


def extract_member(path: str, name: str, target: str, chunk: int = 1 << 20) -> int:
    """Streams one member, such as an archive within an archive, to a file that must not exist; returns its size."""
    with zipfile.ZipFile(path) as z:
        info = next((i for i in z.infolist() if _name(i) == name), None)
        if info is None or info.flag_bits & 1:
            raise ArchiveError(f"cannot read {name}")
        with z.open(info) as source, open(target, "xb") as out:
            while block := source.read(chunk):
                out.write(block)
    return info.file_size


def page_index(found: list[dict]) -> dict:
    """Images in natural order, the names of the rest, and whether an archive is among them."""
    pages = sorted((m for m in found if _IMAGE.search(m["name"])), key=lambda m: natural_order(m["name"]))
    rest = [m["name"] for m in found if not _IMAGE.search(m["name"])]
    return {"pages": pages, "skipped": rest, "nested": any(map(_NESTED.search, rest))}


@udtf(returnType=ddl("ordinal int, name string, bytes long, packed long, method int, crc long, page boolean, error string"))
class ArchivePages:
    """``archive_pages(path)``: the members, pages first in reading order; one row with the error if there is one."""

    def eval(self, path: str):
        try:
            index = page_index(members(path))
        except ArchiveError as e:
            yield 0, None, None, None, None, None, False, str(e)
            return
        for n, m in enumerate(index["pages"]):
            yield n, m["name"], m["bytes"], m["packed"], m["method"], m["crc"], True, None
        for n, name in enumerate(index["skipped"], len(index["pages"])):
            yield n, name, None, None, None, None, False, None


def register(spark: SparkSession) -> None:
    spark.udtf.register("archive_pages", ArchivePages)


INDEX = "path string, pages array<struct<name:string,bytes:bigint>>, skipped array<string>, nested boolean, error string"


def _index(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        rows = []
        for path in f["path"]:
            try:
                x = page_index(members(path))
                rows.append((path, [{"name": m["name"], "bytes": m["bytes"]} for m in x["pages"]], x["skipped"], x["nested"], None))
            except ArchiveError as e:
                rows.append((path, [], [], False, str(e)))
        yield pd.DataFrame(rows, columns=["path", "pages", "skipped", "nested", "error"])


def index_files(files: DataFrame) -> DataFrame:
    """Page indexes of the files in the column ``path``, which executors must be able to open; errors are rows."""
    return files.select("path").mapInPandas(_index, INDEX)


def fresh_index(files: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(files whose index is known for their size and mtime, files to index)."""
    keys = ["file_id", "size", "mtime"]
    return files.join(known, keys), files.join(known.select(keys), keys, "left_anti")


@F.pandas_udf(ddl("binary"))
def page_bytes(path: pd.Series, name: pd.Series) -> pd.Series:
    return pd.Series([read_member(p, n) for p, n in zip(path, name)])


def _single(label: str) -> int | None:
    found = find_volume(label)
    if found:
        return found.lo if found.lo == found.hi else None
    m = re.fullmatch(r"[^0-9]*([0-9]{1,4})[^0-9]*", label)
    return int(m[1]) if m else None


def split_plan(names: list[str], skipped: list[str], nested: bool, lo: int, hi: int) -> tuple[str, list[tuple[int, list[str]]], str | None]:
    """(kind, parts (volume, members), reason): how a file of volumes lo..hi comes apart, or why it does not.

    Archives within it, or its folders below any folder that holds all, must be the volumes lo..hi, each once.
    """
    want = list(range(lo, hi + 1))
    if len(want) < 2:
        return "refuse", [], "holds one volume"
    if nested:
        parts = [(_single(re.split(r"[\\/]", n)[-1].rsplit(".", 1)[0]), [n]) for n in skipped if _NESTED.search(n)]
        kind = "nested"
    else:
        paths = [re.split(r"[\\/]", n) for n in names]
        while paths and all(len(p) > 1 for p in paths) and len({p[0] for p in paths}) == 1:
            paths = [p[1:] for p in paths]
        if not paths or any(len(p) < 2 for p in paths):
            return "refuse", [], "pages stand outside of folders"
        by: dict[str, list[str]] = {}
        for p, n in zip(paths, names):
            by.setdefault(p[0], []).append(n)
        parts, kind = [(_single(k), own) for k, own in by.items()], "folders"
    if sorted(v for v, _ in parts if v is not None) != want or len(parts) != len(want):
        return "refuse", [], "the parts are not the volumes"
    return kind, sorted((v, sorted(own, key=natural_order)) for v, own in parts), None


PLAN = "file_id long, kind string, parts array<struct<volume:int,members:array<string>>>, reason string"


def _plans(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        rows = []
        for r in f.itertuples():
            kind, parts, why = split_plan(list(r.names), list(r.skipped), bool(r.nested), int(r.lo), int(r.hi))
            rows.append((r.file_id, kind, [{"volume": v, "members": m} for v, m in parts], why))
        yield pd.DataFrame(rows, columns=["file_id", "kind", "parts", "reason"])


def split_plans(index: DataFrame) -> DataFrame:
    """Plans for (file_id, names, skipped, nested, lo, hi)."""
    return index.select("file_id", "names", "skipped", "nested", "lo", "hi").mapInPandas(_plans, PLAN)


#: What the plain format can tell (fixed values).
MOST_BYTES, MOST_MEMBERS = 0xFFFFFFFF, 0xFFFF
_LOCAL, _CENTRAL, _END = struct.Struct("<IHHHHHIIIHH"), struct.Struct("<IHHHHHHIIIHHHHHII"), struct.Struct("<IHHHHIIH")


def dos_time(at: datetime) -> tuple[int, int]:
    """Time and date as archives write them: two-second steps, years from 1980."""
    return at.hour << 11 | at.minute << 5 | at.second // 2, max(0, at.year - 1980) << 9 | at.month << 5 | at.day


def write_zip(target: str, source: str, chosen: list[str], at: datetime | None = None) -> int:
    """A new archive of some members of another, their packed bytes copied as they are; returns how many. Names are UTF-8.

    What the plain format cannot hold is refused before anything is written.
    """
    found = {m["name"]: m for m in members(source)}
    size = sum(found[n]["packed"] + 2 * len(n.encode()) + _LOCAL.size + _CENTRAL.size for n in chosen) + _END.size
    if len(chosen) > MOST_MEMBERS or size > MOST_BYTES:
        raise ArchiveError("too large for a plain ZIP")
    clock = dos_time(at or datetime.now())
    directory = []
    with open(source, "rb") as f, open(target, "xb") as out:
        for n in chosen:
            start, packed, method = packed_member(source, n)
            name, offset = n.encode(), out.tell()
            shared = (20, 0x800, method, *clock, found[n]["crc"], packed, found[n]["bytes"], len(name), 0)
            out.write(_LOCAL.pack(0x04034B50, *shared) + name)
            f.seek(start)
            while packed:
                block = f.read(min(packed, 1 << 20))
                if not block:
                    raise ArchiveError(f"{n} is cut off")
                out.write(block)
                packed -= len(block)
            directory.append(_CENTRAL.pack(0x02014B50, 20, *shared, 0, 0, 0, 0, offset) + name)
        begin = out.tell()
        out.write(b"".join(directory))
        out.write(_END.pack(0x06054B50, 0, 0, len(chosen), len(chosen), out.tell() - begin, begin, 0))
    return len(chosen)
