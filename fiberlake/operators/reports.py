"""Reports: chosen parts over fibers and a range, as one long table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import filters, history, incidents


def build_report(det: DataFrame, inc: DataFrame, start: Column, end: Column, fibers: list[str], parts: list[str]) -> DataFrame:
    """(part, k1, k2, k3, metric, value): incidents by type and severity, speeds, hourly volumes."""
    d = filters.time_range(filters.by_fibers(det, fibers), start, end)
    i = filters.time_range(filters.by_fibers(inc, fibers), start, end, "timestamp")
    frames = {
        "incidents": lambda: incidents.incident_breakdown(i).select(F.col("incident_type").alias("k1"), F.col("severity").alias("k2"), F.lit("").alias("k3"), F.inline(_metrics("n"))),
        "speed": lambda: history.speed_stats(d).select(F.col("fiber_id").alias("k1"), F.col("direction").cast("string").alias("k2"), F.lit("").alias("k3"), F.inline(_metrics("avg", "min", "max", "samples"))),
        "volume": lambda: history.hourly_volume(d).select(F.col("fiber_id").alias("k1"), F.col("direction").cast("string").alias("k2"), F.col("hour_ms").cast("string").alias("k3"), F.inline(_metrics("vehicles", "detections"))),
    }
    out = None
    for p in parts:
        f = frames[p]().withColumn("part", F.lit(p)).select("part", "k1", "k2", "k3", "metric", "value")
        out = f if out is None else out.unionByName(f)
    if out is None:
        raise ValueError("a report has at least one part")
    return out


def _metrics(*cols: str) -> Column:
    return F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in cols])
