"""Covers: keyed slots, priority of sources, human choices before automatic ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import parse_slot, volume_slot
from .keyed import dedupe_pinned, first_per_key, merge_pinned, top_per_key
from .numbers import VOLUME

#: The order of the attempts: by ISBN, then by title, small images last.
TIERS = {"ndl:isbn": 0, "rakuten:isbn": 1, "openbd:isbn": 2, "google:isbn:large": 3, "rakuten:title": 4, "google:title:large": 5, "google:isbn:small": 6, "google:title:small": 7}


def write(covers: DataFrame, new: DataFrame) -> DataFrame:
    """covers with new ones in their slots; a pinned cover yields to pinned ones only."""
    return merge_pinned(covers, new, ["series_id", "slot"])


def migrate(covers: DataFrame) -> DataFrame:
    """Of covers without slots, each series keeps the pinned one, else the newest, as its own."""
    return dedupe_pinned(covers, ["series_id"]).withColumn("slot", F.lit(""))


def elect(covers: DataFrame) -> DataFrame:
    """series_id, slot, file of the cover that stands for each series: pinned for it, else that of the lowest volume."""
    own = F.when((F.col("slot") == "") & F.col("pinned"), 0).when(F.col("volume_no").isNotNull(), 1).otherwise(2)
    return first_per_key(covers.withColumn("_own", own), ["series_id"], [F.col("_own"), F.asc_nulls_last("volume_no"), F.col("slot"), F.col("id")]).select("series_id", "slot", "file")


def for_volumes(volumes: DataFrame, covers: DataFrame) -> DataFrame:
    """Each volume with its own cover, else, for a range, the cover of its lowest volume that has one (``borrowed``)."""
    own = covers.select("series_id", F.col("slot").alias("_slot"), F.col("file").alias("_own"))
    v = volumes.withColumn("_slot", volume_slot(F.col("volume_from"), F.col("volume_to"), F.col("unit"))).join(own, ["series_id", "_slot"], "left")
    s = parse_slot(F.col("slot"))
    single = covers.withColumn("s", s).where("s.kind = 'volume' and s.volume_from = s.volume_to").select("series_id", F.col("s.unit").alias("unit"), F.col("s.volume_from").alias("_n"), F.col("file").alias("_file"))
    each = volumes.where("volume_from < volume_to").select("id", "series_id", "unit", F.explode(F.sequence("volume_from", "volume_to")).alias("_n"))
    lent = each.join(single, ["series_id", "unit", "_n"]).groupBy("id").agg(F.min_by("_file", "_n").alias("_lent"))
    d = v.join(lent, "id", "left")
    return d.withColumn("cover", F.coalesce("_own", "_lent")).withColumn("borrowed", F.col("_own").isNull() & F.col("_lent").isNotNull()).drop("_slot", "_own", "_lent")


def targets(bib: DataFrame, volumes: DataFrame, covers: DataFrame, visited: str = "cover_tried_at", budget: int | None = None) -> DataFrame:
    """Volumes that are known and owned but have no cover, those never tried first, at most ``budget`` per series."""
    slot = F.concat(F.lit(f"v:{VOLUME}:"), F.col("volume_no"))
    d = bib.where("volume_no is not null").withColumn("slot", slot)
    own = volumes.where(F.col("present") & (F.col("unit") == VOLUME)).select("series_id", F.explode(F.sequence("volume_from", "volume_to")).alias("volume_no")).distinct()
    d = d.join(own, ["series_id", "volume_no"], "left_semi").join(covers.select("series_id", "slot"), ["series_id", "slot"], "left_anti")
    order = [F.col(visited).isNotNull(), F.col(visited), F.col("volume_no")]
    return d.orderBy(*order) if budget is None else top_per_key(d, ["series_id"], order, budget)


def settled(volumes: DataFrame, covers: DataFrame, series: DataFrame) -> DataFrame:
    """The series all of whose volumes have slots; one without volumes is settled by its own cover."""
    have = parse_slot(F.col("slot"))
    slots = covers.withColumn("s", have).where("s.kind = 'volume'").select("series_id", F.col("s.unit").alias("unit"), F.explode(F.sequence("s.volume_from", "s.volume_to")).alias("n")).distinct()
    each = volumes.where("present").select("series_id", "unit", F.explode(F.sequence("volume_from", "volume_to")).alias("n"))
    lacking = each.join(slots, ["series_id", "unit", "n"], "left_anti").select("series_id").distinct()
    empty = series.select(F.col("id").alias("series_id")).join(each.select("series_id").distinct(), "series_id", "left_anti")
    bare = empty.join(covers.where("slot = ''").select("series_id"), "series_id", "left_anti")
    return series.join(lacking.union(bare).withColumnRenamed("series_id", "id"), "id", "left_anti")


def waterfall(attempts: DataFrame, valid: Column) -> DataFrame:
    """Of each (series_id, slot) the first valid attempt by tier, then by its own order."""
    tier = F.element_at(F.create_map(*(F.lit(x) for kv in TIERS.items() for x in kv)), F.col("tier"))
    return first_per_key(attempts.where(valid).withColumn("_tier", tier), ["series_id", "slot"], [F.asc_nulls_last("_tier"), F.col("ordinal")]).drop("_tier")


def write_bib(old: DataFrame, new: DataFrame) -> DataFrame:
    """Bibliography with new rows by (series_id, volume_no, provider), null volumes a key like any; visits survive if the ISBN is the same."""
    keys = ["series_id", "volume_no", "provider"]
    rest = [c for c in old.columns if c not in keys]
    stamps = ("cover_tried_at", "ndl_tried_at")
    o = old.select(*(F.col(k).alias(f"_{k}") for k in keys), F.struct(*rest).alias("_o"))
    on = None
    for k in keys:
        same = F.col(k).eqNullSafe(F.col(f"_{k}"))
        on = same if on is None else on & same
    d = new.select(*keys, F.struct(*(c for c in new.columns if c not in keys)).alias("_n")).join(o, on, "full")
    out = [F.when(F.col("_n").isNotNull(), F.col(k)).otherwise(F.col(f"_{k}")).alias(k) for k in keys]
    for c in rest:
        if c in stamps:
            kept = F.when(F.col("_o.isbn").eqNullSafe(F.col("_n.isbn")), F.col(f"_o.{c}"))
            out.append(F.when(F.col("_n").isNull(), F.col(f"_o.{c}")).otherwise(kept).alias(c))
        else:
            out.append(F.when(F.col("_n").isNotNull(), F.col(f"_n.{c}") if c in new.columns else F.col(f"_o.{c}")).otherwise(F.col(f"_o.{c}")).alias(c))
    return d.select(*out)


def side_targets(labels: DataFrame, records: DataFrame) -> DataFrame:
    """series_id, side_label with the record whose own label is the same (``key``), null without one; the work itself is none."""
    d = labels.where("side_label <> ''")
    r = records.groupBy("series_id", "key").agg(F.min_by(F.struct("isbn", "image_url"), "ordinal").alias("record"))
    return d.join(r, ["series_id", "key"], "left")
