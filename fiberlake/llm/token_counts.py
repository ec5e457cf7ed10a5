"""Delta-maintained rollups of token counts by source, language and tokenizer version.

Changes to documents are signed deltas: an insert adds a document and its tokens, a
delete takes them away, a revision adds the difference of two counts. A batch is
aggregated to one row for each (source, lang, tokenizer), written as a try of its own
(``tries/batch=<id>/try=<name>``), and committed by a row of the log that names the try
(``log``, one small file, which appears as a whole). Of a batch the try that was
committed last counts, be its rows fewer or none, so retries do not count twice; a job that dies
before its row is written has changed nothing, and readers see the batch as it was. Tries
that no longer count go when the batch is next committed. Totals
are sums over the tries that count; a store without batches has none. A move to another tokenizer version is one batch that deletes
under the old and inserts under the new one. ``compact`` folds batches into one without
changing totals.

Nulls: a null source or language is a group of its own; a null text has 0 tokens; a
null count is 0. Repeated rows are changes of their own. Groups whose documents and
tokens are all 0 do not show in totals. An empty batch commits no rows and is no error.
Columns of other names are not looked at; the store's are fixed.
"""

from __future__ import annotations

import time
import uuid
from urllib.parse import quote

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import default_path, encoder
from .bytescan import pieces, released

KEYS = ["source", "lang", "tokenizer"]
SUMS = ["docs", "tokens", "chars"]
LOG = "no long, batch string, try string"
DELTAS = "source string, lang string, tokenizer string, docs long, tokens long, chars long"


def count_tokens(docs: DataFrame, keep: list[str], text_col: str = "text", path: str | None = None) -> DataFrame:
    """The columns ``keep`` with the text's ``tokens`` (by the public tokenizer) and ``chars``."""
    path = path or default_path()
    rows = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("_text"), *keep, F.coalesce(F.length(text_col), F.lit(0)).cast("long").alias("chars"))

    def count(batches):
        enc = encoder(path)
        for batch in batches:
            for part in pieces(batch, 0):
                _, bounds = enc.encode(part.column(0))
                yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array(np.diff(bounds), pa.int64())], names=[*part.schema.names[1:], "tokens"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[1:]) + ", tokens long"
    return rows.mapInArrow(released(count), schema)


def changes(rows: DataFrame, op: Column, tokenizer: Column) -> DataFrame:
    """Signed deltas of ``rows(source, lang, tokens, chars[, old_tokens])``.

    ``op`` is insert, delete or revise; a revision's delta is tokens - old_tokens.
    """
    old = F.coalesce(F.col("old_tokens"), F.lit(0)) if "old_tokens" in rows.columns else F.lit(0)
    sign = F.when(op == "insert", 1).when(op == "delete", -1).otherwise(0)
    tokens = F.coalesce("tokens", F.lit(0))
    return rows.select("source", "lang", tokenizer.alias("tokenizer"), sign.cast("long").alias("docs"), F.when(op == "revise", tokens - old).otherwise(sign * tokens).cast("long").alias("tokens"), (sign * F.coalesce("chars", F.lit(0))).cast("long").alias("chars"))


def _committed(spark: SparkSession, store: str) -> DataFrame:
    """(batch, try) that count: of each batch the one committed last. A few bytes for each commit."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{store}/log")
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], LOG).select("batch", "try")
    log = spark.read.schema(LOG).parquet(f"{store}/log")
    return log.groupBy("batch").agg(F.max(F.struct("no", "try")).alias("x")).select("batch", F.col("x.try").alias("try"))


def commit(deltas: DataFrame, store: str, batch: str) -> None:
    """Makes ``deltas`` all that the batch has in the store; the same again changes nothing.

    One job at a time may commit to a store.
    """
    spark, name, own = deltas.sparkSession, uuid.uuid4().hex, quote(batch, safe="")
    rows = deltas.groupBy(*KEYS).agg(*[F.sum(c).alias(c) for c in SUMS])
    rows.write.parquet(f"{store}/tries/batch={own}/try={name}")
    before = _committed(spark, store).filter(F.col("batch") == batch).collect()
    no = time.time_ns()
    spark.createDataFrame([(no, batch, name)], LOG).coalesce(1).write.mode("append").parquet(f"{store}/log")
    for old in before:  # at most one: what counted until now
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{store}/tries/batch={own}/try={old['try']}")
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def totals(spark: SparkSession, store: str, batches: list[str] | None = None) -> DataFrame:
    """(source, lang, tokenizer, docs, tokens, chars) over all batches, or those given."""
    told = _committed(spark, store)
    if batches is not None:
        told = told.filter(F.col("batch").isin(batches))
    if told.isEmpty():
        return spark.createDataFrame([], DELTAS)
    rows = spark.read.schema(DELTAS + ", batch string, try string").parquet(f"{store}/tries")
    rows = rows.join(told, ["batch", "try"], "leftsemi")
    return rows.groupBy(*KEYS).agg(*[F.sum(c).alias(c) for c in SUMS]).filter("docs <> 0 or tokens <> 0 or chars <> 0")


def compact(spark: SparkSession, store: str, into: str) -> None:
    """Writes the totals as the only batch of a new store."""
    commit(totals(spark, store), into, "compacted")
