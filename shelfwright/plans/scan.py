"""A scan: a listing of a root, or of one folder of it, becomes the next snapshot of the catalogue and its events.

Ids are hashes of natural keys and of the scan that saw them first, so they need no counter, are the same when a scan is
run again, and are not given twice when a folder is renamed and its old name comes back. The listing is read and parsed
before anything is written: an unreadable root changes nothing.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import format_volume
from ..operators import numbers, snapshot
from ..sources.files import parse_files
from ..sources.layout import Rooted, shelf_of
from ..sources.store import Store

SERIES = "id long, root_id string, folder string, series_key string, title string, author string, completed boolean, completed_user boolean, present boolean, first_seen_at timestamp, last_seen_at timestamp, enriched_at timestamp"
VOLUMES = "id long, series_id long, unit string, volume_from int, volume_to int, completed boolean, present boolean, first_seen_at timestamp, last_seen_at timestamp"
FILES = "id long, root_id string, rel_path string, series_id long, volume_id long, size long, mtime timestamp, ext string, part string, part_no int, side_label string, tags array<string>, care boolean, care_note string, present boolean, first_seen_at timestamp, last_seen_at timestamp"
EVENTS = "id long, series_id long, kind string, message string, created_at timestamp, read_at timestamp, notified_at timestamp"
SCANS = "root_id string, folder string, started_at timestamp, seen long, baseline boolean"


class Refused(ValueError):
    """A folder of a root that was never scanned as a whole."""


def batches(listing: DataFrame, at: F.Column, known: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(series, volumes, files) of a parsed listing, each by its natural key. A folder that ``known`` series have keeps its id, also after a rename."""
    d = listing.withColumn("folder", F.coalesce("folder", F.concat(F.lit("/"), F.col("rel_path"))))
    d = d.join(known.select("root_id", "folder", F.col("id").alias("_id")), ["root_id", "folder"], "left")
    d = d.withColumn("series_id", F.coalesce("_id", F.xxhash64("root_id", "folder", at))).drop("_id")
    d = d.withColumn("volume_id", F.when(F.col("volume_from").isNotNull(), F.xxhash64("series_id", "unit", "volume_from", "volume_to")))
    seen = [F.lit(True).alias("present"), at.alias("first_seen_at"), at.alias("last_seen_at")]
    first = lambda c: F.min_by(c, "rel_path").alias(c)
    s = d.groupBy("root_id", "folder").agg(F.first("series_id").alias("id"), first("series_key"), first("title"), first("author"), F.bool_or("completed").alias("completed")).select("*", *seen)
    v = d.where("volume_id is not null").groupBy("series_id", "unit", "volume_from", "volume_to").agg(F.first("volume_id").alias("id"), F.bool_or("volume_completed").alias("completed")).select("*", *seen)
    f = d.select("root_id", "rel_path", F.xxhash64("root_id", "rel_path", at).alias("id"), "series_id", "volume_id", "size", "mtime", "ext", "part", "part_no", "side_label", "tags", *seen)
    return s, v, f


def _gone(df: DataFrame, files: DataFrame, id_: str, ref: str) -> DataFrame:
    return snapshot.roll_up_presence(df, files, id_, ref)


def advance(old: dict[str, DataFrame], parsed: DataFrame, root_id: str, at: F.Column, folder: str | None, baseline: bool) -> dict[str, DataFrame]:
    """The next series, volumes and files, and the events between, of the last ones and a parsed listing of a root or of a folder of it."""
    s, v, f = batches(parsed, at, old["series"])
    series = snapshot.upsert(old["series"], s, ["root_id", "folder"], sticky=["completed"], keep=["id", "first_seen_at"])
    volumes = snapshot.upsert(old["volumes"], v, ["series_id", "unit", "volume_from", "volume_to"], sticky=["completed"], keep=["id", "first_seen_at"])
    files = snapshot.upsert(old["files"], f, ["root_id", "rel_path"], keep=["id", "first_seen_at"])
    files = files.withColumn("care", F.coalesce("care", F.lit(False)))
    files = snapshot.mark_gone(files, root_id, at, f"{folder}/" if folder else None)
    kept = _gone(series, files, "id", "series_id")
    # A volume counts as added if it was not there and other present volumes did not hold all of its numbers.
    added = volumes.where("change = 'created'").join(kept.where(F.col("root_id") == root_id).select(F.col("id").alias("series_id")), "series_id", "left_semi")
    was = old["volumes"].where("present").select("series_id", "unit", F.col("volume_from").alias("_from"), F.col("volume_to").alias("_to"))
    left = numbers.uncovered_ranges(added, was, ["series_id", "unit"], "volume_from", "volume_to", "_from", "_to")
    fresh = left.where(F.size("uncovered") > 0).join(old["series"].select(F.col("id").alias("series_id")), "series_id", "left_semi")
    fresh = fresh.withColumn("label", format_volume(F.col("volume_from"), F.col("volume_to"), F.col("unit")))
    fresh = fresh.withColumn("label", F.regexp_replace("label", "^第0(?=[0-9])", "第"))
    events = snapshot.series_events(series, old["series"], at).unionByName(snapshot.volume_events(fresh, at)).where(F.lit(not baseline))
    events = events.withColumn("id", F.xxhash64("series_id", "kind", "message", "created_at")).withColumn("read_at", F.lit(None).cast("timestamp")).withColumn("notified_at", F.lit(None).cast("timestamp"))
    return {"series": _named(kept, SERIES), "volumes": _named(_gone(volumes, files, "id", "volume_id"), VOLUMES), "files": _named(files, FILES), "events": _named(events, EVENTS)}


def _named(df: DataFrame, schema: str) -> DataFrame:
    return df.select(*(c.split(" ")[0] for c in schema.split(", ")))


def _first(scans: DataFrame, root_id: str, folder: str | None) -> bool:
    """Whether a root has never been scanned as a whole; a folder of such a root is refused."""
    baseline = scans.where((F.col("root_id") == root_id) & F.col("folder").isNull()).isEmpty()
    if folder is not None and baseline:
        raise Refused(f"{root_id} was never scanned")
    return baseline


def scan(store: Store, listing: DataFrame, root_id: str, started: datetime, folder: str | None = None) -> dict:
    """Commits the next snapshot. A root's first scan is its baseline and makes no events."""
    with store.writing():
        ledger = store.read("scans", SCANS)
        baseline = _first(ledger, root_id, folder)
        parsed = parse_files(listing).cache()
        seen = parsed.count()  # fails before anything is written
        old = {n: store.read(n, schema) for n, schema in (("series", SERIES), ("volumes", VOLUMES), ("files", FILES))}
        new = advance(old, parsed, root_id, F.lit(started), folder, baseline)
        new["events"] = _named(store.read("events", EVENTS), EVENTS).unionByName(new["events"])
        scans = ledger.unionByName(store.spark.createDataFrame([(root_id, folder, started, seen, baseline)], SCANS))
        batch = store.commit(new | {"scans": scans})
        parsed.unpersist()
        return {"batch": batch, "seen": seen, "baseline": baseline}


def scan_root(tables: Rooted, listing: DataFrame, root_id: str, started: datetime, folder: str | None = None) -> dict:
    """A scan that reads and writes the partitions of its root alone, or those of its folder's shelf.

    Events go out before the tables change: a scan that is cut short is run again with the same ``started`` and may tell an
    event a second time, under the same id (``events`` gives each once), but loses none.
    """
    at = F.lit(started)
    baseline = _first(tables.log("scans", SCANS), root_id, folder)
    parsed = parse_files(listing).cache()
    seen = parsed.count()  # fails before anything is written
    old = {n: tables.read(n, schema, root_id, folder) for n, schema in (("series", SERIES), ("volumes", VOLUMES), ("files", FILES))}
    new = advance({n: _named(d, schema) for (n, d), schema in zip(old.items(), (SERIES, VOLUMES, FILES))}, parsed, root_id, at, folder, baseline)
    tables.append("events", new["events"])
    series = new["series"].withColumn("shelf", shelf_of(F.col("folder"), tables.shelves))
    place = series.select(F.col("id").alias("series_id"), "root_id", "shelf")
    tables.replace({"series": series, "volumes": new["volumes"].join(place, "series_id"), "files": new["files"].drop("root_id").join(place, "series_id")})
    tables.append("scans", tables.spark.createDataFrame([(root_id, folder, started, seen, baseline)], SCANS))
    parsed.unpersist()
    return {"seen": seen, "baseline": baseline}


def events(tables: Rooted) -> DataFrame:
    """The events of all scans, each once."""
    return tables.log("events", EVENTS).dropDuplicates(["id"])


def probe(parsed: DataFrame) -> DataFrame:
    """(name, n): how well names are read: files, readable volumes, side stories, works, keys that several folders share."""
    one = parsed.agg(
        F.count("*").alias("files"),
        F.count_if(F.col("volume_from").isNotNull()).alias("volumes"),
        F.count_if(F.col("volume_from").isNull() & (F.col("side_label") != "")).alias("side"),
        F.count_if(F.col("volume_from").isNull() & (F.col("side_label") == "")).alias("single"),
        F.count_if(F.col("volume_from").isNull() & F.col("side_label").isNull()).alias("unreadable"),
        F.count_if((F.col("folder").isNotNull()) & (F.col("file_title") != F.col("title"))).alias("drift"),
    )
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("name"), F.col(c).alias("n")) for c in one.columns)))
    shared = parsed.where("folder is not null").groupBy("series_key").agg(F.count_distinct("folder").alias("n")).where("n > 1").agg(F.count("*").alias("n")).select(F.lit("collisions").alias("name"), "n")
    return one.select(pairs.alias("x")).select("x.*").union(shared)
