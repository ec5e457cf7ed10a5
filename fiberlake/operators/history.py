"""Range summaries, section histories, live figures and dashboard series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scalars as S
from . import joins
from .filters import last
from .rollups import finalize
from .signals import join_back


def summary_hires(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("detections"), F.sum("vehicle_count").alias("vehicles"), F.avg("speed").alias("speed_avg"), F.min("speed").alias("speed_min"), F.max("speed").alias("speed_max"), F.countDistinct("ch").alias("channels"))


def summary_tier(tier: DataFrame) -> DataFrame:
    """Over rollups: average, least and greatest of the cells' averages, not weighted."""
    cells = finalize(tier, ["fiber_id", "ts", "ch", "direction"])
    return cells.agg(F.sum("samples").alias("detections"), F.sum("vehicles").alias("vehicles"), F.avg("speed_avg").alias("speed_avg"), F.min("speed_avg").alias("speed_min"), F.max("speed_avg").alias("speed_max"), F.countDistinct("ch").alias("channels"))


def derive_traffic(df: DataFrame, bucket_s: int) -> DataFrame:
    """Public history points of (time_ms, speed_avg, speed_max, samples per channel)."""
    speed = F.coalesce(F.bround(F.bround("speed_avg", 6), 1), F.lit(0.0))  # 6 decimals first: sums have no order
    samples = F.coalesce("samples", F.lit(0.0))
    rows = df.withColumn("speed", speed).withColumn("flow", F.bround(samples * (3600 / bucket_s)))
    keep = [c for c in df.columns if c not in ("speed_avg", "speed_max", "samples")]
    return rows.select(*keep, "speed", F.coalesce(F.bround("speed_max", 1), F.lit(0.0)).alias("speed_max"), F.bround(samples, 4).alias("samples"), F.col("flow").cast("bigint").alias("flow"), S.occupancy(F.col("speed"), F.col("flow")).alias("occupancy"))


def _width(lo, hi) -> Column:
    lo, hi = (x if isinstance(x, Column) else F.lit(x) for x in (lo, hi))
    return F.greatest(F.lit(1), hi - lo + 1).cast("double")


def section_history_1s(det: DataFrame, lo: int, hi: int) -> DataFrame:
    """One point a second; samples are rows over all channels of the section."""
    rows = det.filter(F.col("ch").between(lo, hi)).groupBy(F.date_trunc("second", "ts").alias("s"))
    rows = rows.agg(F.avg("speed").alias("speed_avg"), F.max("speed").alias("speed_max"), (F.count(F.lit(1)) / _width(lo, hi)).alias("samples"))
    return derive_traffic(rows.select(F.unix_millis("s").alias("time_ms"), "speed_avg", "speed_max", "samples"), 1)


def section_history_1m(tier: DataFrame, lo: int, hi: int) -> DataFrame:
    """One point a minute from merged states, weighted by samples."""
    rows = finalize(tier.filter(F.col("ch").between(lo, hi)), ["ts"])
    return derive_traffic(rows.select(F.unix_millis("ts").alias("time_ms"), "speed_avg", "speed_max", (F.col("samples") / _width(lo, hi)).alias("samples")), 60)


def batch_history(det: DataFrame, sections: DataFrame, cursors: DataFrame | None = None) -> DataFrame:
    """Histories of all sections by one range join and one aggregate; each section has its cursor and width."""
    rows = joins.in_sections(det, sections)
    if cursors is not None:
        rows = rows.join(F.broadcast(cursors.select("section_id", "since_ms")), "section_id", "left")
        rows = rows.filter((F.coalesce("since_ms", F.lit(0)) == 0) | (F.unix_millis("ts") >= F.col("since_ms") + 1000))
    rows = rows.groupBy("section_id", F.date_trunc("second", "ts").alias("s")).agg(F.avg("speed").alias("speed_avg"), F.max("speed").alias("speed_max"), (F.count(F.lit(1)) / F.first(_width(F.col("channel_start"), F.col("channel_end")))).alias("samples"))
    return derive_traffic(rows.select("section_id", F.unix_millis("s").alias("time_ms"), "speed_avg", "speed_max", "samples"), 1)


def section_series(det: DataFrame, lo: int, hi: int) -> DataFrame:
    """Public series: mean speed, rows and distinct channels over the section's width."""
    n = _width(lo, hi)
    rows = det.filter(F.col("ch").between(lo, hi)).groupBy(F.date_trunc("second", "ts").alias("s"))
    rows = rows.agg(F.avg("speed").alias("speed"), (F.count(F.lit(1)) / n).alias("flow"), (F.countDistinct("ch") / n).alias("occupancy"))
    return rows.select(F.unix_millis("s").alias("time_ms"), "speed", "flow", "occupancy")


def section_series_tier(tier: DataFrame, lo: int, hi: int) -> DataFrame:
    n = _width(lo, hi)
    rows = tier.filter(F.col("ch").between(lo, hi)).groupBy("ts").agg((F.sum("speed_sum") / F.nullif(F.sum("speed_n"), F.lit(0))).alias("speed"), (F.sum("count_sum") / n).alias("flow"), (F.countDistinct("ch") / n).alias("occupancy"))
    return rows.select(F.unix_millis("ts").alias("time_ms"), "speed", "flow", "occupancy")


def live_stats(det: DataFrame, incidents: DataFrame, cables: DataFrame, now: Column) -> DataFrame:
    """One row of live figures; detections are read once."""
    age = F.unix_micros(now) - F.unix_micros("ts")
    d = last(det, 30, now).agg(F.count(F.when(age <= 10_000_000, 1)).alias("rows_10s"), F.coalesce(F.sum("vehicle_count"), F.lit(0)).alias("vehicles_30s"))
    i = incidents.agg(F.count(F.when(F.col("status") == "active", 1)).alias("active_incidents"))
    c = cables.agg(F.count(F.lit(1)).alias("fibers"), F.coalesce(F.sum(F.size("coordinates")), F.lit(0)).alias("channels"))
    return d.join(i).join(c)  # one row each


def traffic_totals(df: DataFrame) -> DataFrame:
    heavy = F.when(F.sum("vehicle_count") > 0, F.sum("n_trucks") / F.nullif(F.sum("vehicle_count"), F.lit(0))).otherwise(0.0)
    return df.agg(F.count(F.lit(1)).alias("detections"), F.coalesce(F.sum("vehicle_count"), F.lit(0)).alias("vehicles"), F.avg("speed").alias("speed_avg"), heavy.alias("truck_ratio"), F.countDistinct("fiber_id").alias("fibers"))


def traffic_series(df: DataFrame, seconds: int, *by: str) -> DataFrame:
    """Counts, mean and maximum by interval, by fiber if asked for."""
    rows = df.groupBy(*by, S.trunc_interval(F.col("ts"), seconds).alias("s")).agg(F.count(F.lit(1)).alias("n"), F.avg("speed").alias("speed_avg"), F.max("speed").alias("speed_max"))
    return rows.select(*by, F.unix_millis("s").alias("time_ms"), "n", "speed_avg", "speed_max")


def speed_stats(df: DataFrame) -> DataFrame:
    s = F.abs("speed")
    return df.groupBy("fiber_id", "direction").agg(F.bround(F.avg(s), 1).alias("avg"), F.bround(F.min(s), 1).alias("min"), F.bround(F.max(s), 1).alias("max"), F.count(F.lit(1)).alias("samples"))


def speed_stats_tier(tier: DataFrame) -> DataFrame:
    m = finalize(tier, ["fiber_id", "direction"])
    return m.select("fiber_id", "direction", F.bround("speed_avg", 1).alias("avg"), F.bround("speed_min", 1).alias("min"), F.bround("speed_max", 1).alias("max"), "samples")


def hourly_volume(df: DataFrame) -> DataFrame:
    rows = df.groupBy("fiber_id", "direction", F.date_trunc("hour", "ts").alias("h")).agg(F.sum("vehicle_count").alias("vehicles"), F.count(F.lit(1)).alias("detections"))
    return rows.select("fiber_id", "direction", F.unix_millis("h").alias("hour_ms"), "vehicles", "detections")


def availability(tier: DataFrame) -> DataFrame:
    return tier.groupBy("fiber_id").agg(F.unix_micros(F.min("ts")).alias("first_us"), F.unix_micros(F.max("ts")).alias("last_us"))


def live_cards(history: DataFrame, sections: DataFrame, n: int = 10) -> DataFrame:
    """Means of each section's last points, and its travel time."""
    w = W.partitionBy("section_id").orderBy(F.desc("time_ms"))
    rows = history.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).groupBy("section_id")
    rows = rows.agg(S.round_js(F.avg("speed")).alias("speed"), S.round_js(F.avg("flow")).alias("flow"), S.round_js(F.avg("occupancy")).alias("occupancy"))
    rows = sections.select("section_id", "channel_start", "channel_end").join(rows, "section_id", "left")
    return rows.select("section_id", "speed", "flow", "occupancy", S.travel_time(F.col("channel_end") - F.col("channel_start"), F.col("speed")).alias("travel_min"))


def tail_points(history: DataFrame, now_ms: Column, ms: int = 60_000, n: int = 60) -> DataFrame:
    """Each section's points of the last minute, at most the last n."""
    w = W.partitionBy("section_id").orderBy(F.desc("time_ms"))
    return history.filter(F.col("time_ms") >= now_ms - ms).withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")


def live_dots(det: DataFrame, now: Column, ttl_ms: int = 5_000) -> DataFrame:
    """Last detection of each (fiber, channel, direction) within the time to live, with its fade."""
    rows = det.groupBy("fiber_id", "ch", "direction").agg(F.max(F.struct("ts_ns", "speed")).alias("d"))
    age = F.unix_millis(now) - S.ns_to_ms(F.col("d.ts_ns"))
    return rows.select("fiber_id", "ch", "direction", F.col("d.speed").alias("speed"), (1 - age / ttl_ms).alias("opacity")).filter(F.col("opacity").between(0, 1) & (F.col("opacity") > 0))


def waterfall_window(det: DataFrame, ms: int = 120_000) -> DataFrame:
    """Detections of the last so many milliseconds before their fiber's latest."""
    top = det.groupBy("fiber_id").agg(F.max("ts_ns").alias("_top"))
    return det.join(F.broadcast(top), "fiber_id").filter(F.col("ts_ns") >= F.col("_top") - ms * 1_000_000).drop("_top")


def downsample_rows(df: DataFrame, k: int, order: str | list[str], *by: str) -> DataFrame:
    """k evenly spaced rows of each group, at indices int(i * (n - 1) / (k - 1)); all if there are no more."""
    if not by:
        raise ValueError("rows are numbered within groups: name a key")
    w = W.partitionBy(*by)
    rows = df.withColumn("_i", F.row_number().over(w.orderBy(order)) - 1).withColumn("_n", F.count(F.lit(1)).over(w))
    if k < 2:
        return rows.filter(F.col("_i") < k).drop("_i", "_n")
    # index i is chosen if some j has floor(j * step) = i: the first j at or after i / step
    step = (F.col("_n") - 1) / F.lit(float(k - 1))
    j = F.ceil(F.col("_i") / F.nullif(step, F.lit(0.0)))
    # by rounding the last row's may be k
    hit = ((j < k) & (F.floor(j * step) == F.col("_i"))) | (F.floor((j - 1) * step) == F.col("_i"))
    return rows.filter((F.col("_n") <= k) | hit).drop("_i", "_n")


def downsample_bins(arr: Column, k: int) -> Column:
    """k evenly spaced elements of an array."""
    n = F.size(arr)
    idx = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda j: F.floor(j * (n - 1) / F.lit(float(max(k - 1, 1)))).cast("int"))
    return F.when(n <= k, arr).otherwise(F.transform(idx, lambda i: F.get(arr, i)))


def slice_time(df: DataFrame, a: Column, b: Column, *by: str) -> DataFrame:
    """Rows of a closed range with ``t_rel`` in seconds from the first of each group."""
    rows = df.filter(F.col("ts").between(a, b))
    us = F.unix_micros("ts")
    first = rows.groupBy(*by).agg(F.min(us).alias("_first"))
    return join_back(rows, first, by).withColumn("t_rel", (us - F.col("_first")) / 1e6).drop("_first")
