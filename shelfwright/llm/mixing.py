"""Mixing sources to target weights by capped water-filling.

Each source may be repeated at most ``max_epochs`` times. A target above that is clamped and the excess goes to the
others in proportion to their weights, until no target is above its clamp. That fixpoint is a water level L: a source
gets min(clamp, L x weight). Sorted by clamp / weight the clamped sources are a prefix, so the level follows from prefix
sums over one row per source; nothing is iterated and nothing reaches the driver.

Documents then take their source's whole repetitions, and those that come first in the order of a seeded hash take one
repetition more until the target is met; the document at the boundary takes the words that are still missing. The order
is cut into ``BUCKETS`` hash buckets per source, so that a source with a third of all rows is summed by many tasks.

Everything here is DataFrame operations. Defined cases: a null text has no words; a null source is a source of its own,
last in order; a document without words takes none; an empty table gives an empty one; repeated rows are separate
documents; other columns are kept aside.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import free, materialize, table

#: Hex digits of the hash that name a bucket: 4096 of them for each source.
BUCKET_DIGITS = 3
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def cyclic_weights(sources: DataFrame, cycle: tuple[int, ...] = (3, 1, 2)) -> DataFrame:
    """Adds ``weight``: the cycle's values over the sources in code point order, null last. One row per source."""
    n = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    return sources.withColumn("weight", F.element_at(F.array(*map(F.lit, cycle)), (n % len(cycle) + 1).cast("int")))


def water_fill(sources: DataFrame, share: float = 1.5, max_epochs: int = 2) -> DataFrame:
    """Adds ``target`` to (source, source_size, weight): weighted shares of share x all sizes, clamped at max_epochs."""
    cap = (F.col("source_size") * max_epochs).cast("double")
    every = W.partitionBy()
    upto = W.orderBy("_ratio", F.col("source").asc_nulls_last()).rowsBetween(W.unboundedPreceding, 0)
    d = sources.withColumn("_cap", cap).withColumn("_ratio", F.col("_cap") / F.col("weight"))
    d = d.withColumn("_want", F.sum("source_size").over(every) * F.lit(float(share)))
    d = d.withColumn("_full", F.sum("_cap").over(upto) + F.col("_ratio") * (F.sum("weight").over(every) - F.sum("weight").over(upto)))
    d = d.withColumn("_clamped", F.col("_full") < F.col("_want"))
    held = F.sum(F.when(F.col("_clamped"), F.col("_cap")).otherwise(0.0)).over(every)
    free = F.sum(F.when(F.col("_clamped"), 0).otherwise(F.col("weight"))).over(every)
    level = F.when(F.col("_clamped"), F.col("_cap")).otherwise((F.col("_want") - held) / free * F.col("weight"))
    return d.withColumn("target", F.least(level, F.col("_cap"))).drop("_cap", "_ratio", "_want", "_full", "_clamped")


def sample(docs: DataFrame, sources: DataFrame, seed: int = 11) -> DataFrame:
    """Adds source_size, target, repeats (whole repetitions) and extra (words of one repetition more) to (doc_id, source, size)."""
    t = sources.withColumn("_whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    t = t.withColumn("_need", (F.round("target") - F.col("_whole") * F.col("source_size")).cast("long"))
    t = t.withColumnRenamed("source", "_source").drop("weight")
    h = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    d = docs.withColumn("_h", h).withColumn("_b", F.substring("_h", 1, BUCKET_DIGITS))
    sums = d.groupBy("source", "_b").agg(F.sum("size").alias("_sum"))
    before = W.partitionBy("source").orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select(F.col("source").alias("_s"), F.col("_b").alias("_sb"), F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base"))
    within = W.partitionBy("source", "_b").orderBy("_h", "doc_id", "size").rowsBetween(W.unboundedPreceding, 0)
    d = d.withColumn("_upto", F.sum("size").over(within))
    d = d.join(sums, d["source"].eqNullSafe(sums["_s"]) & (d["_b"] == sums["_sb"])).drop("_s", "_sb")
    d = d.join(t, d["source"].eqNullSafe(t["_source"])).drop("_source")
    extra = F.greatest(F.lit(0), F.least(F.col("size"), F.col("_need") - (F.col("_base") + F.col("_upto") - F.col("size"))))
    return d.withColumn("extra", extra).withColumn("repeats", F.col("_whole")).drop("_h", "_b", "_base", "_upto", "_whole", "_need")


def mix(docs: DataFrame, share: float = 1.5, max_epochs: int = 2, cycle: tuple[int, ...] = (3, 1, 2), seed: int = 11) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, repeats, extra, taken."""
    sized = materialize(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", word_count().alias("size")), "mix-sizes")
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    filled = water_fill(cyclic_weights(sources, cycle), share, max_epochs)
    return sample(sized, filled, seed).withColumn("taken", F.col("size") * F.col("repeats") + F.col("extra"))


def repeat(docs: DataFrame, share: float = 1.5, max_epochs: int = 2, cycle: tuple[int, ...] = (3, 1, 2), seed: int = 11) -> DataFrame:
    """The rows of docs as often as the mix takes them, with all their columns as they were; the boundary document's last repetition is whole or left out, whichever is nearer."""
    row, words, times, again = free(docs.columns, "mix_row", "mix_words", "mix_times", "mix_again")
    rows = materialize(docs.withColumn(row, F.monotonically_increasing_id()).withColumn(words, word_count()), "mix-rows")
    sized = rows.select(F.col(row).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "source", F.col(words).alias("size"))
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    taken = sample(sized, water_fill(cyclic_weights(sources, cycle), share, max_epochs), seed)
    once_more = ((F.col("size") > 0) & (2 * F.col("extra") >= F.col("size"))).cast("long")
    taken = taken.select(F.col("row").alias(row), (F.col("repeats") + once_more).cast("int").alias(times)).where(F.col(times) > 0)
    return rows.join(taken, row).withColumn(again, F.explode(F.sequence(F.lit(1), times))).select(docs.columns)


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of every document."""
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


OP6_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents
), sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source
), weighted AS (
  SELECT *, [3, 1, 2][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INT)] AS weight, 2.0::DOUBLE * source_size AS cap FROM sources
), filling AS (
  SELECT *, 1.5::DOUBLE * sum(source_size) OVER () AS want,
    CAST(sum(cap) OVER u AS DOUBLE) + cap / weight * (sum(weight) OVER () - sum(weight) OVER u) AS full_at
  FROM weighted WINDOW u AS (ORDER BY cap / weight, source NULLS LAST ROWS UNBOUNDED PRECEDING)
), filled AS (
  SELECT source, source_size, CASE WHEN full_at < want THEN cap ELSE least(cap,
    (want - sum(CASE WHEN full_at < want THEN cap ELSE 0 END) OVER ()) / sum(CASE WHEN full_at < want THEN 0 ELSE weight END) OVER () * weight) END AS target
  FROM filling
), rated AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM filled
), placed AS (
  SELECT d.doc_id, d.size, r.source_size, r.target, r.whole, CAST(round(r.target) AS BIGINT) - r.whole * r.source_size AS need,
    sum(d.size) OVER (PARTITION BY d.source ORDER BY md5('11:' || coalesce(CAST(d.doc_id AS VARCHAR), '')), d.doc_id, d.size ROWS UNBOUNDED PRECEDING) AS upto
  FROM sized d JOIN rated r ON d.source IS NOT DISTINCT FROM r.source
)
SELECT doc_id, size, source_size, target, CAST(size * whole + greatest(0, least(size, need - (upto - size))) AS BIGINT) AS taken FROM placed
"""
