"""Sinks and tier storage: writing, scanning, retention, exports."""

from __future__ import annotations

import tempfile
import uuid
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import filters

#: Age kept, longest range served, bytes a row in exports.
RETENTION = {"hires": timedelta(hours=48), "1m": timedelta(days=90), "1h": None}
SERVED = {"hires": timedelta(hours=48), "1m": timedelta(days=90)}
HIRES_MOST = timedelta(days=7)
ROW_BYTES = {"csv": {"hires": 80, "1m": 100, "1h": 100}, "json": {"hires": 200, "1m": 250, "1h": 250}}


def select_tier(start: datetime, end: datetime, explicit: str = "auto") -> str:
    """The tier that serves a range: up to 48 h hires, up to 90 d 1m, else 1h; explicit wins within limits."""
    if start >= end:
        raise ValueError("start must be before end")
    span = end - start
    if explicit != "auto":
        if explicit not in RETENTION:
            raise ValueError(f"unknown resolution {explicit}")
        if explicit == "hires" and span > HIRES_MOST:
            raise ValueError("hires serves at most 7 days")
        return explicit
    return next((t for t, most in SERVED.items() if span <= most), "1h")


def partition_day(tier: str, ts: str = "ts") -> Column:
    """The value of a tier's partition column: the day, of the hour tier the month's first."""
    return F.to_date(ts) if tier != "1h" else F.trunc(ts, "month")


def write_tier(df: DataFrame, tier: str, path: str) -> None:
    """Partitioned by fiber and day (1h: by month), sorted so that row groups skip by time.

    Tasks take ranges of (fiber, day, time), so a day of a fiber with very many rows is several
    files that follow each other in time, not one task.
    """
    rows = df.withColumn("date", partition_day(tier)).repartitionByRange("fiber_id", "date", "ts").sortWithinPartitions("fiber_id", "date", "ts", "ch", "direction")
    rows.write.mode("append").partitionBy("fiber_id", "date").parquet(f"{path}/{tier}")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below that of ``spark.checkpoint.dir``, which all executors share; a temporary one only where Spark runs in one process."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        at = tempfile.mkdtemp(prefix="spark-shared-")
    return f"{at}/{name}-{uuid.uuid4().hex}"


def scan_tier(spark: SparkSession, path: str, tier: str, start: datetime, end: datetime) -> DataFrame:
    """A tier's rows of a closed range; days outside are pruned as partitions."""
    rows = spark.read.parquet(f"{path}/{tier}")
    first = start.date() if tier != "1h" else start.date().replace(day=1)
    return filters.time_range(rows.filter(F.col("date").between(F.lit(first), F.lit(end.date()))), F.lit(start), F.lit(end)).drop("date")


def apply_retention(df: DataFrame, tier: str, now: datetime) -> DataFrame:
    """Rows younger than the tier's age; with a ``date`` partition column whole days are pruned."""
    age = RETENTION[tier]
    if age is None:
        return df
    keep = F.col("ts") >= F.lit(now - age)
    if "date" in df.columns:
        keep = keep & (F.col("date") >= F.lit((now - age).date()))
    return df.filter(keep)


def export_detections(df: DataFrame, start, end, fibers: list[str] | None = None, direction: int | None = None, lo: int | None = None, hi: int | None = None, most: int = 500_000) -> DataFrame:
    """Rows of an export in order of time, ``most`` at most (the export's own limit)."""
    rows = filters.by_channels(filters.by_direction(filters.time_range(df, start, end), direction), lo, hi)
    if fibers is not None:
        rows = filters.by_fibers(rows, fibers)
    return rows.orderBy("ts", "ch", "direction").limit(most)


def export_incidents(inc: DataFrame, start, end, most: int = 100_000) -> DataFrame:
    return filters.time_range(inc, start, end, "timestamp").orderBy(F.desc("timestamp"), "incident_id").limit(most)


def write_export(df: DataFrame, path: str, fmt: str) -> None:
    df.write.mode("overwrite").csv(path, header=True) if fmt == "csv" else df.write.mode("overwrite").json(path)


def estimate_export(df: DataFrame, tier: str, fmt: str) -> DataFrame:
    """(rows, bytes) an export would have."""
    return df.agg(F.count(F.lit(1)).alias("rows")).withColumn("bytes", F.col("rows") * ROW_BYTES[fmt][tier])


def storage_by_tier(spark: SparkSession, path: str, tiers: list[str]) -> DataFrame:
    """(tier, rows, bytes) of stored tiers."""
    out = None
    for t in tiers:
        n = spark.read.parquet(f"{path}/{t}").agg(F.count(F.lit(1)).alias("rows"))
        size = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(f"{path}/{t}").agg(F.sum("length").alias("bytes"))
        one = n.join(size).select(F.lit(t).alias("tier"), "rows", "bytes")  # one row each
        out = one if out is None else out.unionByName(one)
    return out
