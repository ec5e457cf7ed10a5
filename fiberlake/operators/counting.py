"""Vehicle counting over intervals and windows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import detection
from .signals import no_nan

KEYS = detection.KEYS
FEATURES = ("duration", "glrt_sum", "speed_ms", "occupancy", "energy")


def interval_thresholds(iv: DataFrame, thr: DataFrame, detect: float, classify: float, n_sections: int | None = None) -> DataFrame:
    """Intervals with their section's thresholds; the uniform pair where the table's shape does not fit."""
    t = thr.select(F.col("section_idx").alias("window"), F.col("detect").alias("_d"), F.col("classify").alias("_c"))
    if n_sections is not None:
        size = thr.agg(F.count(F.lit(1)).alias("_size"))
        t = t.join(size).filter(F.col("_size") == n_sections).drop("_size")
    rows = iv.join(F.broadcast(t), "window", "left")
    return rows.withColumn("detect", F.coalesce("_d", F.lit(detect))).withColumn("classify", F.coalesce("_c", F.lit(classify))).drop("_d", "_c")


def count_features(iv: DataFrame, g: DataFrame, speeds: DataFrame, data: DataFrame, window_len: float, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Features of each interval (with ``detect``): duration, excess statistic, speed in m/s, occupancy of the window, energy."""
    k = [*keys, "start_idx", "end_idx"]
    base = iv.select(*k, "detect")
    gs = detection.within(base, g.select(*keys, "t", "g"), keys).groupBy(*k).agg(F.sum(F.col("g") - F.col("detect")).alias("glrt_sum"))
    sp = detection.within(base.drop("detect"), speeds.select(*keys, "t", no_nan("speed").alias("speed")), keys).groupBy(*k).agg((F.coalesce(F.median("speed"), F.lit(0.0)) / 3.6).alias("speed_ms"))
    en = detection.within(base.drop("detect"), data.select(*keys, "t", "v"), keys).groupBy(*k).agg(F.sum(F.col("v") * F.col("v")).alias("energy"))
    occ = iv.groupBy(*keys).agg((F.sum(F.col("end_idx") - F.col("start_idx")) / window_len).alias("occupancy"))
    rows = base.join(gs, k, "left").join(sp, k, "left").join(en, k, "left").join(occ, list(keys))
    return rows.withColumn("duration", (F.col("end_idx") - F.col("start_idx")).cast("double"))


def lambda_count(iv: DataFrame, g: DataFrame, thr: DataFrame, fs: float, detect: float, classify: float, keys: tuple[str, ...] = KEYS, n_sections: int | None = None) -> DataFrame:
    """Peak counts with each section's thresholds; the uniform pair if the table is not of ``n_sections`` rows."""
    rows = interval_thresholds(iv, thr, detect, classify, n_sections)
    return detection.count_peaks(rows, g, F.col("detect"), F.col("classify"), fs, keys)


def score_counts(feats: DataFrame, norm: list[tuple[float, float]], weights: list[tuple[list[list[float]], list[float]]]) -> DataFrame:
    """Raw counts by a small dense net (ReLU between layers) over z-scored features, as Column arithmetic.

    ``weights`` are (matrix, bias) of each layer, the matrix with a row for each output.
    """
    x: list[Column] = [(F.col(c) - m) / (s or 1.0) for c, (m, s) in zip(FEATURES, norm)]
    for k, (w, b) in enumerate(weights):
        x = [sum((xi * float(wi) for xi, wi in zip(x, row)), F.lit(float(bi))) for row, bi in zip(np.asarray(w).tolist(), b)]
        if k < len(weights) - 1:
            feats = feats.withColumns({f"_h{k}_{i}": F.greatest(F.lit(0.0), xi) for i, xi in enumerate(x)})
            x = [F.col(f"_h{k}_{i}") for i in range(len(x))]
    return feats.withColumn("raw", x[0]).drop(*[c for c in feats.columns if c.startswith("_h")])


def cap_counts(df: DataFrame, fs: float, headway_s: float = 1.0, factor: float = 3.0, bias: float = 2.0, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Sane counts of (raw, lambda_n, duration, speed_ms): bounded by headway and peaks, 0 at speed 0.

    Applied to a window only if some raw count of it is not zero.
    """
    any_raw = F.max((F.coalesce("raw", F.lit(1.0)) != 0).cast("int")).over(W.partitionBy(*keys)) == 1
    finite = F.when(F.isnan("raw") | (F.abs("raw") == float("inf")) | F.col("raw").isNull(), 0.0).otherwise(F.col("raw"))
    by_time = F.greatest(F.lit(1.0), F.ceil(F.col("duration") / max(1.0, headway_s * fs)).cast("double"))
    by_peaks = F.greatest(F.lit(1.0), F.col("lambda_n") * factor + bias)
    capped = F.least(F.greatest(finite, F.lit(0.0)), by_time, by_peaks)
    return df.withColumn("count", F.when(~any_raw, F.col("raw")).when(F.col("speed_ms") == 0, 0.0).otherwise(capped))


def count_windows(df: DataFrame, fs: float, dur_s: float = 360.0, step: int = 250, by: tuple[str, ...] = ("fiber_id",)) -> DataFrame:
    """Long counting windows by sample count."""
    from .signals import time_windows

    return time_windows(df, int(dur_s * fs), step, by)


def collapse_sections(df: DataFrame, by: tuple[str, ...] = ("fiber_id",)) -> DataFrame:
    """One series of all sub-windows: mean statistic, median speed, mean data (loses detail; count by section rather)."""
    return df.groupBy(*by, "t").agg(F.avg("g").alias("g"), F.median(no_nan("speed")).alias("speed"), F.avg("v").alias("v"))


def apply_counts(det: DataFrame, iv: DataFrame, window_samples: int, by: str = "fiber_id") -> DataFrame:
    """Detections with the count of the first counting interval that holds them, at least 1.

    Detections' ``t_mid`` count from the start of the last batch, which is the tail of the
    counting window; ``iv`` is (by, idx, start_idx, end_idx, count).
    """
    size = det.groupBy(by).agg((F.max("t_mid") + 1).alias("_batch"))
    rows = det.join(size, by).withColumn("_t", F.lit(window_samples) - F.col("_batch") + F.col("t_mid"))
    per = iv.groupBy(by).agg(F.sort_array(F.collect_list(F.struct("idx", "start_idx", "end_idx", "count"))).alias("_iv"))
    rows = rows.join(per, by, "left")
    hit = F.get(F.filter("_iv", lambda x: (x["start_idx"] <= F.col("_t")) & (F.col("_t") < x["end_idx"])), F.lit(0))["count"]
    return rows.withColumn("vehicle_count", F.when(hit.isNotNull(), F.greatest(F.lit(1.0), hit)).otherwise(F.col("vehicle_count"))).drop("_t", "_iv", "_batch")
