"""From documents to token shards: each stage reads what the one before wrote, and its decisions take effect.

1. quality: documents that the subword classifier scores below 0.3 go.
2. near_duplicates: of documents that link at a five-word Jaccard similarity of 0.8 or more the one with the smallest id stays;
   candidates are the SimHash links of the popcount grid and, beyond its radius, MinHash cells.
3. decontaminate: documents that hold a benchmark phrase go.
4. mix: sources are brought to their target weights; documents are repeated or left out.
5. tokens: documents are encoded into sorted-string-table shards, and their entries are read back.

Defined cases: a null text is empty; without labels every document scores 0.5 and stays, with one class alone that class's
share; empty texts are one class of copies; an empty benchmark removes nothing; documents without words are not mixed in;
an empty table gives an empty result; columns of any name come back unchanged until the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from shelfwright.llm import decontaminate, mixing, near, sstable, subword
from shelfwright.llm.common import discard, fold_col, materialize, scope, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").where(fold_col() != 0)
    return subword.keep(docs, subword.fit(docs, labels))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near.keep_one(docs)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.repeat(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sstable.documents_of(sstable.write_shards(docs, sstable.default_tokenizer()))


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("decontaminate", clean), ("mix", mix), ("tokens", tokens)]

#: The classifier and the fingerprints cannot be said in SQL; tests/llm holds the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with scope(spark) as keep:  # what the stage writes for itself goes with it
            kept = keep(materialize(stage(spark, docs, sf_dir), name))
        discard(docs)  # the table of the stage before; the input is none that was written here
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)
