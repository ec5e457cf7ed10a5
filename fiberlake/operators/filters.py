"""Projections, filters and predicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S


def time_range(df: DataFrame, start: Column, end: Column, col: str = "ts") -> DataFrame:
    """Closed range."""
    return df.filter(F.col(col).between(start, end))


def by_direction(df: DataFrame, d: int | None) -> DataFrame:
    if d is None:
        return df
    if d not in (0, 1):
        raise ValueError("direction is 0 or 1")
    return df.filter(F.col("direction") == d)


def by_channels(df: DataFrame, lo: int | None, hi: int | None, col: str = "ch") -> DataFrame:
    for bound, cond in ((lo, F.col(col) >= lo if lo is not None else None), (hi, F.col(col) <= hi if hi is not None else None)):
        if bound is not None:
            df = df.filter(cond)
    return df


def by_fibers(df: DataFrame, ids: list[str]) -> DataFrame:
    return df.filter(F.col("fiber_id").isin(list(ids)))


def last(df: DataFrame, seconds: float, now: Column, col: str = "ts") -> DataFrame:
    """Rows no older than so many seconds before ``now``."""
    return df.filter(F.unix_micros(col) >= F.unix_micros(now) - int(seconds * 1_000_000))


def since(df: DataFrame, tier: str, since_ms: int) -> DataFrame:
    """Rows after a cursor: hires from the next second, rollups strictly after; 0 is no cursor."""
    if not since_ms:
        return df
    ms = F.unix_millis("ts")
    return df.filter(ms >= since_ms + 1000 if tier == "hires" else ms > since_ms)


def to_public_detection(df: DataFrame) -> DataFrame:
    r = lambda c, n, d=0.0: F.bround(F.coalesce(F.col(c).cast("double"), F.lit(d)), n)
    return df.select(
        F.col("fiber_id").alias("fiberId"), F.coalesce("direction", F.lit(0)).alias("direction"), F.coalesce("ch", F.lit(0)).cast("int").alias("channel"),
        F.bround(F.abs(F.coalesce("speed", F.lit(0.0))), 1).alias("speed"), r("vehicle_count", 1, 1.0).alias("count"), r("n_cars", 1).alias("nCars"), r("n_trucks", 1).alias("nTrucks"),
        r("glrt_max", 1).alias("glrtMax"), r("strain_peak", 6).alias("strainPeak"), r("strain_rms", 6).alias("strainRms"), S.ns_to_ms(F.coalesce("ts_ns", F.lit(0))).alias("timestamp"),
    )


def to_public_incident(df: DataFrame) -> DataFrame:
    return df.select(
        F.col("incident_id").alias("id"), F.col("incident_type").alias("type"), "severity", F.col("fiber_id").alias("fiberId"), F.coalesce("direction", F.lit(0)).alias("direction"),
        F.col("channel_start").alias("channel"), F.coalesce("channel_end", "channel_start").alias("channelEnd"), S.iso(F.col("timestamp")).alias("detectedAt"), "status",
        (F.nullif(F.col("duration_seconds"), F.lit(0.0)) * 1000).alias("duration"), F.col("speed_drop_percent").alias("speedDropPercent"),
    )


def validate(df: DataFrame, rules: dict[str, Column], defaults: dict[str, object] | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows that pass, (rule, dropped) by first broken rule); missing late-added fields get defaults."""
    for c, v in (defaults or {}).items():
        df = df.withColumn(c, F.coalesce(F.col(c), F.lit(v))) if c in df.columns else df.withColumn(c, F.lit(v))
    broken = F.coalesce(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(k)) for k, ok in rules.items()])
    rows = df.withColumn("_rule", broken)
    dropped = rows.filter("_rule is not null").groupBy(F.col("_rule").alias("rule")).agg(F.count(F.lit(1)).alias("dropped"))
    return rows.filter("_rule is null").drop("_rule"), dropped


def in_scope(fibers: Column, lo: Column, hi: Column, fiber: Column, ch: Column) -> Column:
    """Whether a rule's fibers (none: all) and channel bounds (null: open) hold a row."""
    everywhere = F.coalesce(F.size(fibers), F.lit(0)) <= 0
    return (everywhere | F.array_contains(fibers, fiber)) & (lo.isNull() | (ch >= lo)) & (hi.isNull() | (ch <= hi))


def filter_incidents(df: DataFrame, severity: list[str] | None = None, status: list[str] | None = None, hide_resolved: bool = False) -> DataFrame:
    if severity:
        df = df.filter(F.col("severity").isin(severity))
    if status:
        df = df.filter(F.col("status").isin(status))
    if hide_resolved:
        df = df.filter(F.coalesce(F.col("status") != "resolved", F.lit(True)))
    return df


def search(df: DataFrame, cols: list[str], term: str) -> DataFrame:
    """Rows with the term in any column, whatever the case; no character is special."""
    hit = F.lit(False)
    for c in cols:
        hit = hit | F.coalesce(F.contains(F.lower(c), F.lower(F.lit(term))), F.lit(False))
    return df.filter(hit)


def incidents_on(df: DataFrame, d: Column) -> DataFrame:
    return df.filter(F.to_date("timestamp") == d)


def in_coverage(df: DataFrame, ranges: DataFrame) -> DataFrame:
    """Rows whose channel lies in any range (both ends in) of its fiber; a small dimension as arrays."""
    r = ranges.groupBy("fiber_id").agg(F.collect_list(F.struct("start", "end")).alias("_r"))
    return df.join(F.broadcast(r), "fiber_id").filter(F.exists("_r", lambda x: F.col("ch").between(x["start"], x["end"]))).drop("_r")


def min_extent(df: DataFrame, keys: list[str], channels: int = 9, samples: int = 1) -> DataFrame:
    """Only groups with enough distinct channels and time indices."""
    big = df.groupBy(*keys).agg(F.countDistinct("ch").alias("c"), F.countDistinct("t_idx").alias("t")).filter((F.col("c") >= channels) & (F.col("t") >= samples))
    return df.join(big.select(*keys), keys, "leftsemi")


def drop_accounting(df: DataFrame, name: str, ok: Column) -> DataFrame:
    """Counts rows and failures as observed metrics beside the query's own work."""
    return df.observe(name, F.count(F.lit(1)).alias("rows"), F.count(F.when(~ok, 1)).alias("failed"))
