"""Structured Streaming: listings become snapshots and events, events become notifications."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from datetime import datetime
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQueryListener
from pyspark.sql.streaming.stateful_processor import TimerValues
from pyspark.sql.streaming.query import StreamingQuery

from ..operators.numbers import VOLUME

CHANGES = "series_id long, kind string, message string"
_STORE, _ROCKS = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def state_store(spark: SparkSession) -> Iterator[None]:
    """Streams started inside keep their state in RocksDB, on the workers' disks and the checkpoint, not on the heap."""
    before = spark.conf.get(_STORE, None)
    spark.conf.set(_STORE, _ROCKS)
    try:
        yield
    finally:
        spark.conf.unset(_STORE) if before is None else spark.conf.set(_STORE, before)


_ROWS = pa.schema([("series_id", pa.int64()), ("title", pa.string()), ("unit", pa.string()), ("volume_from", pa.int32()), ("volume_to", pa.int32()), ("completed", pa.bool_()), ("baseline", pa.bool_())])
_SERIES = pa.schema([("series_id", pa.int64()), ("completed", pa.bool_()), ("seen", pa.int64())])
_VOLUMES = pa.schema([("series_id", pa.int64()), ("unit", pa.string()), ("volume_from", pa.int32()), ("volume_to", pa.int32()), ("seen", pa.int64())])
#: Bytes of listed files that a task puts together before it hands them on by bucket.
AT_ONCE = 64 << 20


def _bytes(t: pa.Table) -> bytes:
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, t.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_table(t)
    return out.getvalue().to_pybytes()


def _table(b: bytes) -> pa.Table:
    return pa.ipc.open_stream(b).read_all()


def _codes(*columns: pa.ChunkedArray) -> tuple[pa.Array, list[np.ndarray]]:
    """The distinct values of the columns, and each column as places among them; null is a value."""
    d = pa.concat_arrays([c.combine_chunks() for c in columns]).dictionary_encode(null_encoding="encode")
    return d.dictionary, np.split(d.indices.to_numpy(), np.cumsum([len(c) for c in columns])[:-1])


def _ranks(texts: pa.Array) -> np.ndarray:
    out = np.empty(len(texts), np.int64)
    out[pc.sort_indices(texts).to_numpy()] = np.arange(len(texts))
    return out


def _on_line(group: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Numbers of several groups on one line, on which groups do not meet."""
    return (group.astype(np.int64) << 32) + (n.astype(np.int64) + (1 << 31))


def _covered(group: np.ndarray, lo: np.ndarray, hi: np.ndarray, by_group: np.ndarray, by_lo: np.ndarray, by_hi: np.ndarray) -> np.ndarray:
    """Which ranges lie whole in what the other ranges (``by_``) of their group cover together."""
    if not len(by_group):
        return np.zeros(len(group), bool)
    begin, end = _on_line(by_group, by_lo), _on_line(by_group, by_hi)
    order = np.argsort(begin)
    begin, end, of = begin[order], np.maximum.accumulate(end[order]), by_group[order]
    first = np.append(True, (begin[1:] > end[:-1] + 1) | (of[1:] != of[:-1]))
    begin, end = begin[first], end[np.append(first[1:], True)]
    at = np.searchsorted(begin, _on_line(group, lo), "right") - 1
    return (at >= 0) & (end[np.maximum(at, 0)] >= _on_line(group, hi)) & (begin[np.maximum(at, 0)] >> 32 == group)


def _labels(unit: pa.Array, lo: np.ndarray, hi: np.ndarray) -> pa.Array:
    a, b = pa.array(lo).cast(pa.string()), pa.array(hi).cast(pa.string())
    upto = pc.if_else(pa.array(lo == hi), "", pc.binary_join_element_wise("-", b, ""))
    return pc.binary_join_element_wise("第", a, upto, unit, "")


def step(series: pa.Table, volumes: pa.Table, listed: pa.Table, first_completed: bool = False, now: int = 0) -> tuple[pa.Table, pa.Table, pa.Table]:
    """Series and volumes that are known after the files ``listed`` of one batch, and the events that they tell."""
    ids, (known_at, held_at, at) = _codes(series["series_id"], volumes["series_id"], listed["series_id"])
    units, (held_unit, unit) = _codes(volumes["unit"], listed["unit"])
    names, (title,) = _codes(listed["title"])
    n, n_units, by_name = len(ids), max(1, len(units)), _ranks(names)
    known, was, done, baseline, listed_now = (np.zeros(n, bool) for _ in range(5))
    known[known_at], was[known_at] = True, series["completed"].to_numpy()
    done[at[listed["completed"].to_numpy()]] = True
    baseline[at[listed["baseline"].to_numpy()]] = True
    listed_now[at] = True
    seen = np.full(n, now, np.int64)
    seen[known_at] = np.where(listed_now[known_at], now, series["seen"].to_numpy())
    least = np.full(n, len(names), np.int64)
    np.minimum.at(least, at, by_name[title])
    told = names.take(pa.array(np.argsort(by_name))).take(pa.array(np.where(listed_now, least, 0)))

    ok = pc.fill_null(pc.less_equal(listed["volume_from"], listed["volume_to"]), False).to_numpy()
    lo, hi = (pc.fill_null(listed[c], 0).to_numpy()[ok] for c in ("volume_from", "volume_to"))
    held_lo, held_hi = volumes["volume_from"].to_numpy(), volumes["volume_to"].to_numpy()
    held_group, group = held_at.astype(np.int64) * n_units + held_unit, at[ok].astype(np.int64) * n_units + unit[ok]
    # volumes that are held come before those listed, and of equal ones the first stays
    g, x, y = np.append(held_group, group), np.append(held_lo, lo), np.append(held_hi, hi)
    order = np.lexsort((y, x, g))
    new = np.append(True, (np.diff(g[order]) != 0) | (np.diff(x[order]) != 0) | (np.diff(y[order]) != 0))[: len(order)]
    volume = np.cumsum(new) - 1
    again = np.zeros(int(new.sum()), bool)
    again[volume[order >= len(held_group)]] = True
    since = np.append(volumes["seen"].to_numpy(), np.full(len(group), now, np.int64))[order[new]]
    since[again] = now
    stays, fresh = order[new], order[new] >= len(held_group)
    g, x, y = g[stays], x[stays], y[stays]

    added = np.flatnonzero(fresh & known[g // n_units])
    added = added[~_covered(g[added], x[added], y[added], held_group, held_lo, held_hi) & ~baseline[g[added] // n_units]]
    added = added[np.lexsort((_ranks(units)[g[added] % n_units], y[added], x[added], g[added] // n_units))]
    of = g[added] // n_units
    first = np.flatnonzero(np.append(True, np.diff(of) != 0)[: len(of)])
    lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(of)), pa.int32()), _labels(units.take(pa.array(g[added] % n_units)), x[added], y[added]))
    more = pc.binary_join_element_wise(pc.binary_join(lists, " / "), " が増えました", "")

    loud = listed_now & ~baseline
    start, end = np.flatnonzero(loud & ~known), np.flatnonzero(loud & done & ~was & (known | first_completed))
    kinds = np.repeat(np.arange(3), [len(start), len(first), len(end)])
    events = pa.table(
        {
            "series_id": ids.take(pa.array(np.concatenate([start, of[first], end]))),
            "kind": pa.array(["series_added", "volume_added", "series_completed"]).take(pa.array(kinds)),
            "message": pa.concat_arrays([told.take(pa.array(start)), more, told.take(pa.array(end))]),
        }
    )
    whole = np.flatnonzero(known | listed_now)
    series = pa.Table.from_arrays([ids.take(pa.array(whole)), pa.array((was | done)[whole]), pa.array(seen[whole])], schema=_SERIES)
    return series, pa.Table.from_arrays([ids.take(pa.array(g // n_units)), units.take(pa.array(g % n_units)), pa.array(x), pa.array(y), pa.array(since)], schema=_VOLUMES), events


class SeriesChanges(StatefulProcessor):
    """Events of the series of one bucket. A series' first batch makes it known and is told once; later batches tell what they
    add. What is known of a bucket is two Arrow tables, read and written as a whole: a call of the state is a message to
    the JVM, and a few for each series cost far more than its rows.
    """

    def __init__(self, ttl_ms: int | None = None, first_completed: bool = False):
        self.ttl_ms, self.first_completed = ttl_ms, first_completed

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.known = handle.getValueState("known", "series binary, volumes binary", self.ttl_ms)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        listed = pa.concat_tables([_table(x) for frame in rows for x in frame["listed"]])
        state = self.known.get()
        series, volumes = (_SERIES.empty_table(), _VOLUMES.empty_table()) if state is None else map(_table, state)
        now = 0
        if self.ttl_ms:
            now = timerValues.getCurrentProcessingTimeInMs()
            series, volumes = (x.filter(pc.greater(x["seen"], now - self.ttl_ms)) for x in (series, volumes))
        series, volumes, events = step(series, volumes, listed, self.first_completed, now)
        self.known.update((_bytes(series), _bytes(volumes)))
        out = {c: events[c].to_pandas() for c in ("kind", "message")}
        yield pd.DataFrame({"series_id": pd.Series(events["series_id"].to_pandas(integer_object_nulls=True), dtype="Int64" if events["series_id"].null_count else None)} | out)

    def close(self) -> None:
        pass


def _by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Files put together by bucket, a portion at a time, those that say the same once."""

    def rows(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(held)
        t = t.group_by(t.schema.names).aggregate([]).sort_by("bucket").combine_chunks()
        bucket, t = t["bucket"].to_numpy(), t.select(_ROWS.names).cast(_ROWS)
        edges = np.append(np.flatnonzero(np.append(True, np.diff(bucket) != 0)), len(bucket)).tolist()
        for k in range(0, len(edges) - 1, 64):
            some = edges[k : k + 65]
            yield pa.RecordBatch.from_arrays([pa.array(bucket[some[:-1]], pa.int32()), pa.array([_bytes(t.slice(i, j - i)) for i, j in pairwise(some)], pa.binary())], ["bucket", "listed"])

    held: list[pa.RecordBatch] = []
    size = 0
    for b in batches:
        if b.num_rows:
            held.append(b)
            size += b.nbytes
        if size >= AT_ONCE:
            yield from rows(held)
            held, size = [], 0
    if held:
        yield from rows(held)


def change_events(listing: DataFrame, ttl_ms: int | None = None, first_completed: bool = False, buckets: int = 1024) -> DataFrame:
    """Events of a stream of files (series_id, title, volume_from, volume_to, completed, baseline, and unit, volumes by default).

    What a batch tells is judged against all batches before it. A batch that brings a series' first files tells that it is
    new, and that it is complete too only with ``first_completed``. Files of one volume are one row for each task before they
    meet, so a series with very many files is no hot key. Series are known by hash in so many ``buckets``, which holds for
    the life of a checkpoint; a bucket that a batch touches is read and written whole. With ``ttl_ms`` a series and its
    volumes are forgotten when no batch has brought them for so long. The stream must be started inside ``state_store``.
    """
    unit = F.coalesce("unit", F.lit(VOLUME)) if "unit" in listing.columns else F.lit(VOLUME)
    bucket = F.pmod(F.xxhash64(F.col("series_id").cast("long")), F.lit(buckets)).cast("int")
    listed = listing.select(bucket.alias("bucket"), F.col("series_id").cast("long").alias("series_id"), F.coalesce("title", F.lit("")).alias("title"), unit.alias("unit"), F.col("volume_from").cast("int").alias("volume_from"), F.col("volume_to").cast("int").alias("volume_to"), F.coalesce("completed", F.lit(False)).alias("completed"), F.coalesce("baseline", F.lit(False)).alias("baseline"))
    few = listed.mapInArrow(_by_bucket, "bucket int, listed binary")
    return few.groupBy("bucket").transformWithStateInPandas(SeriesChanges(ttl_ms, first_completed), CHANGES, "Append", "ProcessingTime" if ttl_ms else "None")


def outbox(events: DataFrame, send: Callable[[DataFrame], list[int]], log: Callable[[DataFrame, int], None], checkpoint: str, most: int = 20) -> StreamingQuery:
    """At least once: all of each batch is offered in portions of ``most``, and only what ``send`` says went out is logged as sent."""

    def run(batch: DataFrame, epoch: int) -> None:
        columns = batch.columns
        batch = batch.dropDuplicates().withColumn("_h", F.xxhash64(*columns)).persist()  # events may share an id: they are told apart by what they hold
        last, done = None, False
        while not done:
            portion = batch if last is None else batch.where((F.col("id") > last["id"]) | (F.col("id") == last["id"]) & (F.col("_h") > last["_h"]))
            portion = portion.orderBy("id", "_h").limit(most)
            rows = portion.select("id", "_h").collect()  # ``most`` at a time
            done = len(rows) < most
            if rows:
                last, own = rows[-1], portion.select(columns)
                log(own.withColumn("sent", F.col("id").isin(send(own))), epoch)
        batch.unpersist()

    return events.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_counts(events: DataFrame, at: str = "ts", late: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """Windowed counts of an event stream with a bound on lateness."""
    return events.withWatermark(at, late).groupBy(F.window(at, width), "event_type").agg(F.count("*").alias("n"))


def snapshots(listing: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str, minutes: int | None = None) -> StreamingQuery:
    """Scans as micro-batches: ``apply`` writes the next snapshot version for each. At once over what is there, or every so many minutes."""
    trigger = {"availableNow": True} if minutes is None else {"processingTime": f"{minutes} minutes"}
    return listing.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(**trigger).start()


CLAIMS = "id long, at timestamp, batch long"


class Rounds:
    """Background work in micro-batches of bounded size, with its ledger in a folder.

    Each batch claims what is due first, ``budget`` rows by the order of ``due`` (id, due), and writes the claims before anything is
    tried: what is claimed was visited, whether or not the attempt ends. A batch that runs again after a failure finds its
    claims and tries none of them a second time; they come up again when they are due again. Results are a partition for
    each batch.
    """

    def __init__(self, spark: SparkSession, folder: str, budget: int):
        self.spark, self.folder, self.budget = spark, folder.rstrip("/"), budget

    def _read(self, name: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.folder}/{name}")
        except AnalysisException:  # none yet
            return self.spark.createDataFrame([], schema)

    def claims(self) -> DataFrame:
        return self._read("claims", CLAIMS)

    def results(self, schema: str) -> DataFrame:
        return self._read("results", f"{schema}, batch long")

    def step(self, batch: int, at: datetime, due: Callable[[datetime, DataFrame], DataFrame], attempt: Callable[[DataFrame], DataFrame]) -> None:
        """One batch. ``due`` gets the time and the claims so far; ``attempt`` gives a row for each id that it could do."""
        claims = self.claims()
        if not claims.where(F.col("batch") == batch).isEmpty():
            return
        chosen = due(at, claims).orderBy("due", "id").limit(self.budget).select("id", F.lit(at).cast("timestamp").alias("at"))
        own = f"{self.folder}/claims/batch={batch}"
        chosen.write.mode("overwrite").parquet(own)
        attempt(self.spark.read.schema("id long, at timestamp").parquet(own).select("id")).write.mode("overwrite").parquet(f"{self.folder}/results/batch={batch}")

    def run(self, ticks: DataFrame, checkpoint: str, clock: Callable[[int], datetime], due: Callable, attempt: Callable, minutes: int | None = None) -> StreamingQuery:
        """A batch for each tick of a stream, now or every so many minutes; ``clock`` tells a batch's time from its number."""
        trigger = {"availableNow": True} if minutes is None else {"processingTime": f"{minutes} minutes"}
        step = lambda _, batch: self.step(batch, clock(batch), due, attempt)
        return ticks.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(**trigger).start()

    def progress(self) -> DataFrame:
        """batch, tried, done of the batches so far."""
        done = self.results("id long").groupBy("batch").agg(F.count("*").alias("done"))
        tried = self.claims().groupBy("batch").agg(F.count("*").alias("tried"))
        return tried.join(done, "batch", "left").select("batch", "tried", F.coalesce("done", F.lit(0)).alias("done"))


class Progress(StreamingQueryListener):
    """Hands what each batch of this session's streams did to ``tell``: name, batch, rows and milliseconds, or why a stream ended."""

    def __init__(self, tell: Callable[[dict], None]):
        self.tell = tell

    def onQueryStarted(self, event: object) -> None:
        self.tell({"name": event.name, "state": "started"})

    def onQueryProgress(self, event: object) -> None:
        p = event.progress
        self.tell({"name": p.name, "state": "running", "batch": p.batchId, "rows": p.numInputRows, "ms": p.batchDuration})

    def onQueryIdle(self, event: object) -> None:
        pass

    def onQueryTerminated(self, event: object) -> None:
        self.tell({"state": "failed" if event.exception else "ended", "why": event.exception})


def stream_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A stream of the files of a Parquet table, which may be one file or a folder."""
    at = f"{folder}/{name}.parquet"
    known = spark.read.parquet(at)
    reader = spark.readStream.schema(known.schema)
    if all(f.rstrip("/").endswith(f"/{name}.parquet") for f in known.inputFiles()):
        return reader.option("pathGlobFilter", f"{name}.parquet").parquet(folder)
    return reader.parquet(at)


def drain(stream: DataFrame, folder: str) -> DataFrame:
    """Runs a stream over what is there into a new table below ``folder``, and reads that."""
    at = f"{folder}/{uuid.uuid4().hex}"
    with state_store(stream.sparkSession):
        stream.writeStream.format("parquet").option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start(f"{at}/out").awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{at}/out")


def drain_in_turns(parts: Sequence[DataFrame], make: Callable[[DataFrame], DataFrame], folder: str) -> DataFrame:
    """What a stream gives when the parts arrive one after the other, with ``turn``: each is a micro-batch, and the stream
    ends and is begun again from its checkpoint between them, as from one scan to the next."""
    at = f"{folder}/{uuid.uuid4().hex}"
    spark = parts[0].sparkSession
    for k, part in enumerate(parts, 1):
        part.write.mode("append").parquet(f"{at}/in")
        out = make(spark.readStream.schema(part.schema).parquet(f"{at}/in"))
        write = lambda batch, _, k=k: batch.withColumn("turn", F.lit(k)).write.mode("overwrite").parquet(f"{at}/out/{k}")  # noqa: E731  a batch that is tried again replaces itself
        with state_store(spark):
            out.writeStream.foreachBatch(write).option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(*(f"{at}/out/{k}" for k in range(1, len(parts) + 1)))
