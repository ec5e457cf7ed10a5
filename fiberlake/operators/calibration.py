"""Calibration of thresholds and coupling from quiet recordings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .signals import dense_channels, explode_windows


def glrt_corr(sig: DataFrame, w: int = 20, nch: int = 9, step: int = 1) -> DataFrame:
    """(fiber_id, section_idx, t, g): sum over adjacent channels of squared correlation in a sliding window.

    Groups of ``nch`` channels every ``step``; the box is [t - w/2, t + w/2), the statistic
    0 within w samples of either end; constant series count 0. A correlation is a pair's own:
    it is computed once, and only then dealt to the overlapping groups that hold both channels.
    """
    dense = dense_channels(sig).join(sig.groupBy("fiber_id").agg((F.max("t_idx") + 1).alias("_end")), "fiber_id")
    # dealt by channel: Spark takes a signal from a small file for small, and would broadcast its samples and go on in one task
    rows = sig.join(dense.hint("shuffle_hash"), ["fiber_id", "ch"]).select("fiber_id", "_i", "_n", "_end", F.col("t_idx").alias("t"), "v")
    # a pair is two neighbours among all channels; where one has no row at t, there is no pair
    at = W.partitionBy("fiber_id", "t").orderBy("_i")
    rows = rows.withColumn("v2", F.when(F.lead("_i").over(at) == F.col("_i") + 1, F.lead("v").over(at))).filter("v2 is not null")
    rows = rows.withColumn("v2", F.when(F.col("v").isNotNull(), F.col("v2")))
    box = W.partitionBy("fiber_id", "_i").orderBy("t").rowsBetween(-(w // 2), w // 2 - 1)
    # not F.corr, which fails on constant series
    c = F.try_divide(F.covar_pop("v", "v2").over(box), F.stddev_pop("v").over(box) * F.stddev_pop("v2").over(box))
    inside = (F.col("t") >= w) & (F.col("t") < F.col("_end") - w)
    rows = rows.withColumn("c", c).withColumn("c", F.when(inside, F.coalesce(F.when(~F.isnan("c"), F.col("c") * F.col("c")), F.lit(0.0))).otherwise(0.0))
    # all pairs of a moment come to one place, so their copies for the groups are not shuffled
    rows = rows.select("fiber_id", "_i", "_n", "t", "c").repartition("fiber_id", "t")
    return explode_windows(rows, F.col("_i"), nch - 1, step, F.col("_n") - 1, "section_idx").groupBy("fiber_id", "section_idx", "t").agg(F.sum("c").alias("g"))


def threshold_curve(g: DataFrame, method: str = "MAD", k: float = 5.0) -> DataFrame:
    """(fiber_id, section_idx, threshold, baseline, noise) over positive values; (k, 0, 1) where there are none.

    ``g`` is computed once: its values meet their section's median in a window, not in a join.
    """
    keys = ["fiber_id", "section_idx"]
    rows = g.select(*keys, F.when(F.col("g") > 0, F.col("g")).alias("g"))
    if method == "MAD":
        rows = rows.withColumn("baseline", F.median("g").over(W.partitionBy(*keys)))
        out = rows.groupBy(*keys, "baseline").agg(F.median(F.abs(F.col("g") - F.col("baseline"))).alias("noise")).withColumn("threshold", F.col("baseline") + k * F.col("noise"))
    elif method == "percentile":
        out = rows.groupBy(*keys).agg(F.percentile("g", min(1.0, (95 + k) / 100)).alias("threshold"), F.median("g").alias("baseline"), F.stddev_pop("g").alias("noise"))
    else:
        raise ValueError(f"unknown method {method}")
    return out.select(*keys, F.coalesce("threshold", F.lit(float(k))).alias("threshold"), F.coalesce("baseline", F.lit(0.0)).alias("baseline"), F.coalesce("noise", F.lit(1.0)).alias("noise"))


def coupling_factors(g: DataFrame) -> DataFrame:
    """Median of the sections' medians over each section's median (of positive values; 1 if none)."""
    keys = ["fiber_id", "section_idx"]
    sec = g.groupBy(*keys).agg(F.coalesce(F.median(F.when(F.col("g") > 0, F.col("g"))), F.lit(1.0)).alias("m"))
    rows = sec.withColumn("median_glrt", F.median("m").over(W.partitionBy("fiber_id")))
    return rows.select(*keys, (F.col("median_glrt") / F.greatest(F.col("m"), F.lit(1e-8))).alias("correction"), "median_glrt")


def threshold_sweep(g: DataFrame, thresholds: list[float]) -> DataFrame:
    """Rising edges of each section for every candidate threshold (a short list, exploded in place)."""
    rows = g.withColumn("threshold", F.explode(F.array(*[F.lit(float(t)) for t in thresholds])))
    up = F.col("g") >= F.col("threshold")
    was = F.lag(F.col("g")).over(W.partitionBy("fiber_id", "section_idx", "threshold").orderBy("t")) >= F.col("threshold")
    rows = rows.withColumn("_edge", (up & ~F.coalesce(was, F.lit(False))).cast("int"))
    return rows.groupBy("fiber_id", "section_idx", "threshold").agg(F.sum("_edge").alias("edges"))
