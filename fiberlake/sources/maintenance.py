"""Maintenance of stored tiers: corrections by late rows, retention, compaction.

A tier lies under ``path/tier/fiber_id=../date=..`` (see ``sinks.write_tier``). Whatever
changes rows that are there is written aside first and then swapped in by partition
(dynamic overwrite), so partitions that nothing touches keep their files, and a job that dies
is run again. Names of partitions are listed on the driver, rows never are.
"""

from __future__ import annotations

import uuid
from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import rollups
from .sinks import RETENTION, partition_day, write_tier

PARTS = ["fiber_id", "date"]


def _fs(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def partitions(spark: SparkSession, path: str, tier: str) -> list[tuple[str, date, str, int, int]]:
    """(fiber, day, folder, files, bytes) of a tier's partitions: a listing, no rows."""
    fs, root = _fs(spark, f"{path}/{tier}")
    out = []
    if not fs.exists(root):
        return out
    unescape = spark.sparkContext._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.unescapePathName
    for fiber in fs.listStatus(root):
        if not fiber.isDirectory() or "=" not in fiber.getPath().getName():
            continue
        for day in fs.listStatus(fiber.getPath()):
            if "=" in day.getPath().getName():
                files = [f.getLen() for f in fs.listStatus(day.getPath()) if f.getPath().getName().endswith(".parquet")]
                name = lambda p: unescape(p.getPath().getName().split("=", 1)[1])
                out.append((name(fiber), date.fromisoformat(name(day)), day.getPath().toString(), len(files), sum(files)))
    return out


def _read(spark: SparkSession, path: str, schema) -> DataFrame:
    fs, at = _fs(spark, path)
    return spark.read.schema(schema).parquet(path) if fs.exists(at) else spark.createDataFrame([], schema)


def _swap(rows: DataFrame, path: str, tier: str) -> None:
    """Makes ``rows`` all that their partitions hold; other partitions are not touched."""
    spark, aside = rows.sparkSession, f"{path}/_aside/{tier}-{uuid.uuid4().hex}"
    rows.write.parquet(aside)
    again = spark.read.schema(rows.schema).parquet(aside)
    dealt = again.repartitionByRange(*PARTS, "ts").sortWithinPartitions(*PARTS, "ts", "ch", "direction")
    dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*PARTS).parquet(f"{path}/{tier}")
    fs, at = _fs(spark, aside)
    fs.delete(at, True)


# late rows ---------------------------------------------------------------------
def split_late(rows: DataFrame, sealed: datetime) -> tuple[DataFrame, DataFrame]:
    """(rows in time, rows behind the watermark ``sealed``); a null time is late for good and in neither."""
    return rows.filter(F.col("ts") >= F.lit(sealed)), rows.filter(F.col("ts") < F.lit(sealed))


def store_late(late: DataFrame, path: str, batch: int) -> None:
    """Keeps late rows by batch id; storing a batch again replaces it."""
    rows = late.withColumn("date", partition_day("hires")).withColumn("batch_id", F.lit(batch).cast("long"))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id", *PARTS).parquet(f"{path}/late")


def correct_tiers(spark: SparkSession, path: str, schema, batch: int | None = None) -> None:
    """Mends the minute and hour tiers by the late rows (of one batch, or of all).

    ``schema`` is that of the hires rows. Only the hours of the fibers that late rows fall
    in are computed anew, from their hires rows and all late ones, so running it again
    changes nothing. The other hours of their partitions are carried over, and other
    partitions keep their files. Rows that repeat by retries of one batch count once;
    hires rows are not changed.
    """
    stored = spark.createDataFrame([], schema).withColumn("date", F.lit(None).cast("date")).schema
    every = _read(spark, f"{path}/late", spark.createDataFrame([], stored).withColumn("batch_id", F.lit(0).cast("long")).schema)
    mine = every if batch is None else every.filter(F.col("batch_id") == batch)
    hour = F.date_trunc("hour", "ts")
    touched = mine.select("fiber_id", "date", hour.alias("hour")).distinct()
    hires = _read(spark, f"{path}/hires", stored).unionByName(every.select(*stored.names))
    rows = hires.withColumn("hour", hour).join(touched, ["fiber_id", "date", "hour"], "leftsemi").drop("hour", "date")
    fresh = rollups.rollup_1m(rows)
    for tier, new in (("1m", fresh), ("1h", rollups.rollup_1h(fresh))):
        new = new.withColumn("date", partition_day(tier))
        parts = touched.select("fiber_id", partition_day(tier, "hour").alias("date")).distinct()
        old = _read(spark, f"{path}/{tier}", new.schema).join(parts, PARTS, "leftsemi").withColumn("hour", hour)
        old = old.join(touched.select("fiber_id", "hour").distinct(), ["fiber_id", "hour"], "leftanti")
        _swap(old.select(*new.columns).unionByName(new), path, tier)


# retention and files --------------------------------------------------------------
def expire(spark: SparkSession, path: str, tier: str, now: datetime) -> dict[str, int]:
    """Drops what is older than the tier keeps: whole partitions as folders, and of the partition that the edge cuts the older rows.

    Gives the numbers of partitions dropped and rewritten.
    """
    age, done = RETENTION[tier], {"dropped": 0, "rewritten": 0}
    if age is None:
        return done
    edge = now - age
    cut = edge.date() if tier != "1h" else edge.date().replace(day=1)
    for _, day, folder, _, _ in partitions(spark, path, tier):
        if day < cut:
            fs, at = _fs(spark, folder)
            fs.delete(at, True)
            done["dropped"] += 1
    cut_in = [p for p in partitions(spark, path, tier) if p[1] == cut]
    if cut_in:
        rows = spark.read.parquet(f"{path}/{tier}").filter(F.col("date") == F.lit(cut))
        kept = rows.filter(F.col("ts") >= F.lit(edge))
        stale = {r.fiber_id for r in rows.filter(F.col("ts") < F.lit(edge)).select("fiber_id").distinct().collect()}
        left = {r.fiber_id for r in kept.select("fiber_id").distinct().collect()} if stale else set()
        for fiber, _, folder, _, _ in cut_in:  # nothing in it is young enough
            if fiber in stale - left:
                fs, at = _fs(spark, folder)
                fs.delete(at, True)
                done["dropped"] += 1
        if stale & left:
            _swap(kept.filter(F.col("fiber_id").isin(sorted(stale & left))), path, tier)
            done["rewritten"] += len(stale & left)
    return done


def compact(spark: SparkSession, path: str, tier: str, most: int = 4, target: int = 128 << 20) -> int:
    """Rewrites the partitions that have more than ``most`` files and more than their bytes ask for, in order of time.

    Gives the number of partitions rewritten; rows are the same.
    """
    poor = [(f, d) for f, d, _, files, size in partitions(spark, path, tier) if files > max(most, -(-size // target))]
    if poor:
        chosen = spark.createDataFrame(poor, "fiber_id string, date date")
        rows = spark.read.parquet(f"{path}/{tier}")
        _swap(rows.join(chosen, PARTS, "leftsemi").select(*rows.columns), path, tier)
    return len(poor)


def write_incidents(inc: DataFrame, path: str) -> None:
    """Incidents by month with a bloom filter of their ids, so that a look-up by id skips the files without it."""
    rows = inc.withColumn("month", F.trunc("timestamp", "month")).repartitionByRange("month", "timestamp").sortWithinPartitions("month", "timestamp")
    bloom = {"parquet.bloom.filter.enabled#incident_id": "true", "parquet.bloom.filter.adaptive.enabled": "true"}
    rows.write.mode("append").options(**bloom).partitionBy("month").parquet(path)


def rebuilt(spark: SparkSession, path: str, hires: DataFrame, late: DataFrame) -> DataFrame:
    """The minute tier after ``hires`` were stored and rolled up and ``late`` rows came behind: all steps of a store of its own."""
    write_tier(hires, "hires", path)
    minutes = rollups.rollup_1m(hires)
    write_tier(minutes, "1m", path)
    write_tier(rollups.rollup_1h(minutes), "1h", path)
    store_late(late, path, 0)
    correct_tiers(spark, path, hires.schema)
    return spark.read.parquet(f"{path}/1m").drop("date")
