"""Data-quality monitors over detections, window metrics, timings and dead letters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from .rollups import quantile_of, quantile_states


def window_metrics(windows: DataFrame, det: DataFrame) -> DataFrame:
    """(fiber_id, window, direction, n, glrt_max, speed): direction 0 of every window, 1 only where it has detections."""
    d = det.groupBy("fiber_id", "window", "direction").agg(F.count(F.lit(1)).alias("n"), F.max("glrt_max").alias("glrt_max"), F.median(F.abs("speed")).alias("speed"))
    fwd = windows.select("fiber_id", "window").distinct().withColumn("direction", F.lit(0)).join(d, ["fiber_id", "window", "direction"], "left")
    rows = fwd.unionByName(d.filter("direction = 1"))
    return rows.select("fiber_id", "window", "direction", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("glrt_max", F.lit(0.0)).alias("glrt_max"), F.coalesce("speed", F.lit(0.0)).alias("speed"))


def rate_monitor(df: DataFrame, start: Column, end: Column, minutes: int = 10, error: Column | None = None) -> DataFrame:
    """Rate a second and share of errors by fiber and interval; intervals without data show as rate 0."""
    step = minutes * 60
    n = df.groupBy("fiber_id", S.trunc_interval(F.col("ts"), step).alias("w")).agg(F.count(F.lit(1)).alias("n"), F.count(F.when(error if error is not None else F.lit(False), 1)).alias("bad"))
    n = n.select("fiber_id", F.unix_seconds("w").alias("sec"), "n", "bad")
    a, b = F.unix_seconds(start), F.unix_seconds(end)
    spine = df.select("fiber_id").distinct().withColumn("sec", F.explode(F.sequence(a - F.pmod(a, F.lit(step)), b - F.pmod(b, F.lit(step)), F.lit(step).cast("bigint"))))
    rows = spine.join(n, ["fiber_id", "sec"], "left")
    k = F.coalesce("n", F.lit(0))
    return rows.select("fiber_id", "sec", (k / F.lit(float(step))).alias("rate"), F.coalesce(F.col("bad") / F.nullif("n", F.lit(0)), F.lit(0.0)).alias("error_rate"), (k == 0).alias("no_data"))


def quality_vs_yesterday(metrics: DataFrame, share: float = 0.2) -> DataFrame:
    """Hourly medians of the window peak below a share of those 24 hours before, both above 0."""
    h = metrics.groupBy("fiber_id", F.floor(F.unix_seconds("ts") / 3600).alias("hour")).agg(F.median("glrt_max").alias("m"))
    before = h.select("fiber_id", (F.col("hour") + 24).alias("hour"), F.col("m").alias("m_before"))
    rows = h.join(before, ["fiber_id", "hour"])
    return rows.withColumn("degraded", (F.col("m") > 0) & (F.col("m_before") > 0) & (F.col("m") < share * F.col("m_before")))


def speed_shift(metrics: DataFrame, short_min: int = 15, long_min: int = 120, most: float = 15.0, exact: bool = False, k: int = 800) -> DataFrame:
    """At every quarter of an hour: medians of the last 15 and 120 minutes, and whether they differ by over 15 km/h.

    Each quarter's speeds become one sketch, and the sketches of the last quarters are merged
    (see ``rollups.quantile_states`` for their error). With ``exact`` each row is dealt to the
    quarters whose trailing window holds it and the medians are exact.
    """
    step, n = short_min * 60, long_min // short_min
    rows = metrics.filter("speed is not null").select("fiber_id", F.floor(F.unix_seconds("ts") / step).alias("k"), "speed")
    if exact:
        rows = rows.withColumn("at", F.explode(F.sequence(F.col("k"), F.col("k") + n - 1)))
        m = rows.groupBy("fiber_id", "at").agg(F.median(F.when(F.col("at") == F.col("k"), F.col("speed"))).alias("short"), F.median("speed").alias("long"))
    else:
        quarters = quantile_states(rows, ["fiber_id", "k"], "speed", k)
        # sketches, not rows, are dealt to the windows
        dealt = quarters.withColumn("at", F.explode(F.sequence(F.col("k"), F.col("k") + n - 1)))
        own = F.max(F.when(F.col("at") == F.col("k"), F.col("sketch")))
        m = dealt.groupBy("fiber_id", "at").agg(own.alias("own"), F.kll_merge_agg_double("sketch", k).alias("all"))
        m = m.filter("own is not null").select("fiber_id", "at", quantile_of("own", 0.5).alias("short"), quantile_of("all", 0.5).alias("long"))
    m = m.filter("short is not null")
    return m.select("fiber_id", ((F.col("at") + 1) * step).alias("sec"), "short", "long", ((F.abs(F.col("short") - F.col("long")) > most) & (F.col("short") > 10) & (F.col("long") > 10)).alias("shifted"))


def stage_percentiles(timings: DataFrame, exact: bool = False, k: int = 800) -> DataFrame:
    """Medians and 95th percentiles of each stage's times, from sketches unless ``exact``."""
    n = F.count(F.lit(1)).alias("n")
    if exact:
        return timings.groupBy("fiber_id", "stage").agg(F.percentile("ms", 0.5).alias("p50"), F.percentile("ms", 0.95).alias("p95"), n)
    s = timings.groupBy("fiber_id", "stage").agg(F.kll_sketch_agg_double(F.when(~F.isnan("ms"), F.col("ms").cast("double")), k).alias("sketch"), n)
    return s.select("fiber_id", "stage", quantile_of("sketch", 0.5).alias("p50"), quantile_of("sketch", 0.95).alias("p95"), "n")


def dlq_stats(dlq: DataFrame) -> DataFrame:
    return dlq.groupBy("source", "error_type").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "source", "error_type")
