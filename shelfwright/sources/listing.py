"""A data source over folders of files: ``spark.read.format("shelf_files")``, and the same as a stream.

For libraries on a file system that the workers have mounted. The driver lists one level; each folder there is walked by the
task that gets it, so that a listing of millions of files is no list on the driver. What cannot be read is a row with its
``error`` and does not end the listing; only a root that cannot be read does.

As a stream, a batch has the files whose status changed since the last (moved and renamed files have a new change time, if
an old modification time), up to ``settle`` seconds ago, so that a file is not taken while it is being written. The offset is
that time, and it is kept in the checkpoint: nothing is listed twice after a restart, and nothing is left out.
"""

from __future__ import annotations

import os
import time
from collections.abc import Iterator
from datetime import UTC, datetime
from stat import S_ISREG

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

SCHEMA = "root_id string, rel_path string, size long, mtime timestamp, error string"
FIRST = {"changed": -(1 << 62)}


class Part(InputPartition):
    """Some of the entries of a root, and the change times of the files that count: after ``after``, up to ``upto``."""

    def __init__(self, root: str, names: list[str], after: int, upto: int):
        self.root, self.names, self.after, self.upto = root, names, after, upto


def walk(part: Part) -> Iterator[tuple[str, int | None, datetime | None, str | None]]:
    """(path below the root, size, modification time, error) of the files below the part's entries. Links to folders are not followed."""
    todo = sorted(part.names, reverse=True)
    while todo:
        rel = todo.pop()
        path = os.path.join(part.root, rel)
        try:
            if os.path.isdir(path) and not os.path.islink(path):
                todo += sorted((f"{rel}/{name}" for name in os.listdir(path)), reverse=True)
                continue
            s = os.stat(path)
        except FileNotFoundError:  # it went meanwhile, or is a link to nothing
            continue
        except OSError as e:
            yield rel, None, None, f"{type(e).__name__}: {os.strerror(e.errno) if e.errno else e}"
            continue
        if S_ISREG(s.st_mode) and part.after < s.st_ctime_ns <= part.upto:
            yield rel, s.st_size, datetime.fromtimestamp(s.st_mtime, UTC), None


def parts_of(root: str, count: int, after: int, upto: int) -> list[Part]:
    """The entries of a root dealt to ``count`` parts at most. Raises where the root cannot be read."""
    names = sorted(os.listdir(root))
    return [Part(root, names[k::count], after, upto) for k in range(min(count, len(names)))]


class _Options:
    def __init__(self, options: dict[str, str]):
        self.root = options["path"].removeprefix("file://").rstrip("/")
        self.root_id, self.count = options.get("root_id", ""), int(options.get("parts", "64"))
        self.settle = int(float(options.get("settle", "2")) * 1e9)

    def rows(self, part: Part) -> Iterator[tuple]:
        return ((self.root_id, *found) for found in walk(part))


class Listing(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.o = _Options(options)

    def partitions(self) -> list[Part]:
        return parts_of(self.o.root, self.o.count, FIRST["changed"], 1 << 62)

    def read(self, partition: Part) -> Iterator[tuple]:
        return self.o.rows(partition)


class ListingStream(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.o = _Options(options)

    def initialOffset(self) -> dict:
        return FIRST

    def latestOffset(self) -> dict:
        return {"changed": time.time_ns() - self.o.settle}

    def partitions(self, start: dict, end: dict) -> list[Part]:
        return parts_of(self.o.root, self.o.count, start["changed"], end["changed"])

    def read(self, partition: Part) -> Iterator[tuple]:
        return self.o.rows(partition)

    def commit(self, end: dict) -> None:
        pass


class ShelfFiles(DataSource):
    """Options: ``path``; ``root_id``; ``parts`` (64), how many tasks share the folders; ``settle`` (2), seconds, for streams."""

    @classmethod
    def name(cls) -> str:
        return "shelf_files"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> Listing:
        return Listing(dict(self.options))

    def streamReader(self, schema: StructType) -> ListingStream:
        return ListingStream(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ShelfFiles)
