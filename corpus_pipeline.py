"""A corpus pipeline of five stages, each one operator of ``fiberlake.llm``.

Every stage works on all that its predecessor kept; all but the last return the
columns of documents. Between stages rows are written as Parquet and read again.

Decisions hold for rows, not for ids: rows are told apart by a hash of all their columns
(``_key``), so rows with a null id, rows that share an id and rows that repeat each have
their own. Rows that are equal in every column are interchangeable. Null and empty texts
are clean, have no lines and no near copies, and are never mixed in. Empty tables stay
empty through every stage. Columns beside those of documents are kept, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fiberlake.llm import line_dedup, mixing, packing, partenum, toxicity
from fiberlake.llm.common import WORD, bitmap, drop, free, marked, settle, table


def _key(docs: DataFrame) -> Column:
    """A hash of all columns; nulls and empty strings differ."""
    return F.xxhash64(*[x for c in docs.columns for x in (F.col(f"`{c}`").isNull(), F.col(f"`{c}`"))])


def _own(docs: DataFrame) -> list[Column]:
    return [F.col(f"`{c}`") for c in docs.columns]


def toxic_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose own toxicity score is below a half, whatever their ids and other rows of them; null texts stay."""
    return toxicity.below(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without repeated lines; a document all of whose words went is gone. Rows with a null id keep their lines."""
    lines, dropped = free(docs, "_lines"), free(docs, "_dropped")
    out = line_dedup.dedup_lines(docs, min_chars=1, lines=lines, dropped=dropped)
    out = out.filter((F.col(dropped) == 0) | F.col("text").rlike(WORD))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*_own(docs))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicate rows: that with the smallest id, null ids last.

    Rows are compared one by one, so those that share an id or have none are documents of
    their own; of rows that are equal in every column one stays.
    """
    key, maybe = free(docs, "__near_key"), free(docs, "__near_maybe")
    keyed = docs.withColumn(key, _key(docs))
    rows = keyed.groupBy(F.col(key).alias("key")).agg(F.first("doc_id").alias("id"), F.count(F.lit(1)).alias("copies"))
    near = partenum.near_duplicates(keyed, key).select(F.col("doc_id").alias("key"), "component_id")
    near = settle(rows.join(near, "key"), "near-rows")
    first = near.groupBy("component_id").agg(F.min(F.struct(F.col("id").isNull(), "id", "key")).alias("x")).select("component_id", F.col("x.key").alias("first"))
    some = near.join(first, "component_id").select("key", (F.col("key") == F.col("first")).alias("stays"), "copies").filter("not stays or copies > 1")
    some = settle(some, "near-decisions")
    drop(near)
    gone, repeated = some.filter("not stays").select(F.col("key").alias(key)), some.filter("stays and copies > 1").select(F.col("key").alias(key))
    told = marked(keyed, key, bitmap(gone, key), maybe)
    left = told.filter(~F.col(maybe)).drop(maybe).unionByName(told.filter(maybe).drop(maybe).join(gone, key, "leftanti").select(*_own(keyed)))
    if not repeated.isEmpty():
        told = marked(left, key, bitmap(repeated, key), maybe)  # a row too many in the bitmap has no copy to lose
        left = told.filter(~F.col(maybe)).unionByName(told.filter(maybe).dropDuplicates([key]))
    return left.select(*_own(docs))


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row as often as the mix takes it; texts without words go.

    Rows that are equal in every column are taken alike; where the mix takes only some
    of them, one of them has what is left.
    """
    key = free(docs, "__mix_key")
    return mixing.Mix(docs.withColumn(key, _key(docs)), key).taken().select(*_own(docs))


def pack_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document stands in the packed sequences."""
    return packing.pack(docs)


STAGES = [("toxicity", toxic_stage), ("line_dedup", line_stage), ("ngram_jaccard", near_stage), ("mixing", mix_stage), ("packing", pack_stage)]

#: Neither the field's marginals nor the tokenizer's ids can be had in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs, before = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), f"pipeline-{name}")
        drop(*before)
        before = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
