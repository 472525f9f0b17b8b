"""From provider responses to bibliography and covers: search, pick, automatic enrichment, what is still to do."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.registry import title_keys
from ..operators import candidates, covers, folding, joins, snapshot
from ..operators.keyed import first_per_key
from ..operators.numbers import VOLUME

_ITEM = [x.strip().split(" ") for x in candidates.ITEM.split(",")]


def search(parts: dict[str, DataFrame]) -> DataFrame:
    """Groups of the records of several providers (each with query_id and ordinal); a provider that failed is left out."""
    d = joins.union_sources({k: v.drop("provider") for k, v in parts.items()})
    for name, kind in _ITEM:
        if name not in d.columns:
            d = d.withColumn(name, F.lit(None).cast(kind))
    rank = F.create_map(*(F.lit(x) for kv in candidates.RANK.items() for x in kv))
    d = d.withColumn("ordinal", (F.coalesce(F.element_at(rank, F.col("provider")), F.lit(9)) * 100_000 + F.col("ordinal")).cast("int"))
    return candidates.groups(folding.fold_candidates(candidates.normalise(d)))


def bib_of(group_items: DataFrame, at: F.Column) -> DataFrame:
    """Rows of bibliography from (series_id, volume, item)."""
    i = F.col("item")
    return group_items.select("series_id", F.col("volume").alias("volume_no"), i["provider"].alias("provider"), i["isbn"].alias("isbn"), i["title"].alias("title"), i["author"].alias("author"), i["publisher"].alias("publisher"), i["date"].alias("pubdate"), i["image_url"].alias("cover_url"), at.alias("fetched_at"))


def apply_pick(bib: DataFrame, groups: DataFrame, picks: DataFrame, at: F.Column) -> DataFrame:
    """bib with the picked groups (series_id, query_id, group_key) in place of all that was known of those series."""
    chosen = candidates.volume_map(groups).join(picks, ["query_id", "group_key"])
    new = bib_of(chosen, at)
    rest = bib.join(picks.select("series_id").distinct(), "series_id", "left_anti")
    return rest.unionByName(new, allowMissingColumns=True)


def enrich(records: DataFrame, series: DataFrame) -> DataFrame:
    """volume rows (series_id, volume, record) of provider records (series_id, title, volume, isbn, date ...): the oldest edition that has an ISBN and a title that fits."""
    d = records.where("isbn is not null and volume is not null").join(series.select(F.col("id").alias("series_id"), F.col("title").alias("_want")), "series_id")
    d = d.withColumn("_w", title_keys("_want")).withColumn("_g", title_keys("title"))
    d = d.where(joins.keys_compatible(F.col("_w"), F.col("_g")))
    return first_per_key(d, ["series_id", "volume"], [F.coalesce("date", F.lit("9999")), F.col("ordinal")]).drop("_want", "_w", "_g")


def works_to_visit(series: DataFrame, volumes: DataFrame, covers_: DataFrame, now: F.Column, days: int, most: int) -> DataFrame:
    """Works that are not settled and due, never visited first."""
    todo = series.where("present").join(covers.settled(volumes, covers_, series).select("id"), "id", "left_anti")
    return snapshot.due(todo, "enriched_at", now, days).limit(most)


def remaining(bib: DataFrame, volumes: DataFrame, covers_: DataFrame) -> DataFrame:
    """How many owned volumes with bibliography have no cover."""
    return covers.targets(bib, volumes, covers_).agg(F.count("*").alias("remaining"))


def written(covers_: DataFrame) -> DataFrame:
    return covers_.groupBy("provider").agg(F.count("*").alias("n"))


def paste(targets: DataFrame, attempts: DataFrame, covers_: DataFrame, valid: F.Column) -> DataFrame:
    """covers_ with the first valid image of each target's attempts (series_id, slot, tier, ordinal, file ...); pinned ones stay."""
    won = covers.waterfall(attempts.join(targets.select("series_id", "slot"), ["series_id", "slot"], "left_semi"), valid)
    cols = covers_.columns
    new = won.select(*(F.col(c) if c in won.columns else F.lit(None).cast(dict(covers_.dtypes)[c]).alias(c) for c in cols))
    return covers.write(covers_, new.withColumn("pinned", F.lit(False)))


def slot_of(volume: F.Column) -> F.Column:
    return F.when(volume.isNull(), "").otherwise(F.concat(F.lit(f"v:{VOLUME}:"), volume))
