"""Versioned snapshots: upserts as full outer joins, soft deletes, roll-ups, and the events between two of them.

Parquet has no row-level merge, so an upsert makes the next snapshot from the last one and a batch. Both sides shuffle on
the natural key once; a table bucketed by it need not shuffle at all.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str], sticky: Sequence[str] = (), keep: Sequence[str] = ()) -> DataFrame:
    """The next snapshot with ``change``: created, updated (also revived rows), or null for rows the batch does not have.

    Columns of new win; ``sticky`` booleans stay true once they were; ``keep`` columns are the old ones where a row exists
    (first_seen_at, human marks). old may have columns that new lacks: they stay, null for created rows.
    """
    o = old.select(*keys, F.struct(*(c for c in old.columns if c not in keys), F.lit(1).alias("_")).alias("_o"))
    n = new.select(*keys, F.struct(*(c for c in new.columns if c not in keys), F.lit(1).alias("_")).alias("_n"))
    d = o.join(n, list(keys), "full")
    out = []
    for c in (c for c in old.columns if c not in keys):
        if c not in new.columns:
            out.append(F.col(f"_o.{c}").alias(c))
        elif c in sticky:
            out.append((F.coalesce(f"_o.{c}", F.lit(False)) | F.coalesce(f"_n.{c}", F.lit(False))).alias(c))
        elif c in keep:
            out.append(F.when(F.col("_o").isNotNull(), F.col(f"_o.{c}")).otherwise(F.col(f"_n.{c}")).alias(c))
        else:
            out.append(F.when(F.col("_n").isNotNull(), F.col(f"_n.{c}")).otherwise(F.col(f"_o.{c}")).alias(c))
    change = F.when(F.col("_o").isNull(), "created").when(F.col("_n").isNotNull(), "updated")
    return d.select(*keys, *out, change.alias("change"))


def mark_gone(df: DataFrame, root: str, started: Column, under: str | None = None) -> DataFrame:
    """present becomes false for rows of a root (below a path prefix, taken literally) not seen since the scan began."""
    gone = (F.col("root_id") == root) & (F.col("last_seen_at") < started)
    if under is not None:
        gone = gone & F.startswith(F.col("rel_path"), F.lit(under))
    return df.withColumn("present", F.col("present") & ~F.coalesce(gone, F.lit(False)))


def roll_up_presence(parents: DataFrame, children: DataFrame, parent_id: str, ref: str) -> DataFrame:
    """A parent is present while one of its children is."""
    live = children.where("present").select(F.col(ref).alias(parent_id)).where(F.col(parent_id).isNotNull()).distinct().withColumn("_live", F.lit(True))
    return parents.join(live, parent_id, "left").withColumn("present", F.col("present") & F.coalesce("_live", F.lit(False))).drop("_live")


def diff(old: DataFrame, new: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """keys and ``change`` (added, removed, changed, same) between two snapshots."""
    o = old.select(*keys, F.struct(*values).alias("_o"))
    n = new.select(*keys, F.struct(*values).alias("_n"))
    change = F.when(F.col("_o").isNull(), "added").when(F.col("_n").isNull(), "removed").when(F.col("_o") == F.col("_n"), "same").otherwise("changed")
    return o.join(n, list(keys), "full").select(*keys, change.alias("change"))


def volume_events(added: DataFrame, at: Column, baseline: Column | bool = False) -> DataFrame:
    """One ``volume_added`` event per series of added volumes (series_id, volume_from, label), in numeric order.

    The first scan of a root is its baseline and tells nothing.
    """
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("volume_from", "label"))), lambda x: x["label"]), " / ")
    d = added.where(~(F.lit(baseline) if isinstance(baseline, bool) else baseline)).groupBy("series_id").agg(text.alias("_text"))
    return d.select("series_id", F.lit("volume_added").alias("kind"), F.concat(F.col("_text"), F.lit(" が増えました")).alias("message"), at.alias("created_at"))


def series_events(snapshot: DataFrame, before: DataFrame, at: Column) -> DataFrame:
    """``series_added`` for created rows and ``series_completed`` for rows that became complete."""
    b = before.select(F.col("id").alias("_id"), F.col("completed").alias("_was"))
    d = snapshot.join(b, snapshot["id"] == b["_id"], "left")
    kind = F.when(F.col("change") == "created", "series_added").when(F.col("completed") & ~F.coalesce("_was", F.lit(False)), "series_completed")
    return d.withColumn("kind", kind).where("kind is not null").select(F.col("id").alias("series_id"), "kind", F.col("title").alias("message"), at.alias("created_at"))


def pending(events: DataFrame, most: int = 20) -> DataFrame:
    """Events not notified yet, oldest first."""
    return events.where("notified_at is null").orderBy("created_at", "id").limit(most)


def newest(events: DataFrame, limit: int = 50, unread: bool = False, most: int = 500) -> DataFrame:
    """Events newest first, all or those not read yet."""
    d = events.where("read_at is null") if unread else events
    return d.orderBy(F.desc("created_at"), F.desc("id")).limit(max(1, min(limit, most)))


def stamp(events: DataFrame, sent: DataFrame, column: str, at: Column) -> DataFrame:
    """Sets a stamp (read_at, notified_at) on the events whose ids are in ``sent``, once."""
    s = sent.select("id").distinct().withColumn("_sent", F.lit(True))
    value = F.coalesce(F.col(column), F.when(F.col("_sent"), at))
    return events.join(s, "id", "left").withColumn(column, value).drop("_sent")


def latest_visit(ledger: DataFrame, key: str, at: str = "visited_at") -> DataFrame:
    """The last visit of each key from an append-only ledger."""
    return ledger.groupBy(key).agg(F.max(at).alias(at))


def due(df: DataFrame, visited: str, now: Column, days: int) -> DataFrame:
    """Never visited or longer ago than ``days``; never visited first, then the oldest."""
    ok = F.col(visited).isNull() | (F.col(visited) < now - F.make_dt_interval(F.lit(days)))
    return df.where(ok).orderBy(F.col(visited).isNotNull(), visited, "id")


def sessions(df: DataFrame, key: str, at: str, minutes: int) -> DataFrame:
    """Adds ``session``: numbered runs of rows of a key without a pause above ``minutes``."""
    w = W.partitionBy(key).orderBy(at, "event_id")
    pause = F.unix_micros(F.col(at).cast("timestamp")) - F.unix_micros(F.lag(at).over(w).cast("timestamp"))
    return df.withColumn("session", F.sum(F.coalesce((pause > minutes * 60_000_000).cast("int"), F.lit(1))).over(w))
