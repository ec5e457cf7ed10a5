"""From windows to detections: shifts, alignment, statistic, intervals, speeds, counts.

Windows are long rows (keys, window, pos 0..Nch-1, t, v).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import kernels
from .signals import dense_channels, explode_windows, no_nan

KEYS = ("fiber_id", "window")


def _series(win: DataFrame, keys: tuple[str, ...], nch: int | None) -> DataFrame:
    """One row a window: channels' samples in order, as arrays; only those of ``nch`` channels if given."""
    ch = win.groupBy(*keys, "pos").agg(F.transform(F.sort_array(F.collect_list(F.struct("t", "v"))), lambda x: x["v"]).alias("x"))
    out = ch.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "x"))), lambda x: x["x"]).alias("m"))
    return out if nch is None else out.filter(F.size("m") == nch)


def pair_shift(win: DataFrame, max_lag: int, keys: tuple[str, ...] = KEYS, method=None) -> DataFrame:
    """(keys, pair, t, shift) with next(t) = previous(t + shift), in samples; one value a pair for the built-in method.

    The built-in method is minus the lag of the largest cross-correlation. A model of one's own
    is a function of a (channels x time) array that gives (pairs x time) shifts.
    """
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in win.select(*keys).schema.fields) + ", pair int, t int, shift double"

    def built_in(m: np.ndarray) -> np.ndarray:
        lags = [-kernels.best_lag(m[i], m[i + 1], max_lag) for i in range(len(m) - 1)]
        return np.repeat(np.array(lags, float)[:, None], m.shape[1], 1)

    f, names = method or built_in, win.select(*keys).columns

    def apply(batches):
        for batch in batches:
            sizes, pairs, times, values = [], [], [], []
            for m in batch.column(len(names)):
                shift = f(np.array([np.array(x, np.float64) for x in m.as_py()]))
                p, t = np.indices(shift.shape, np.int32)
                sizes.append(shift.size)
                for c, x in zip((pairs, times, values), (p, t, shift)):
                    c.append(x.ravel())
            row = pa.array(np.repeat(np.arange(len(sizes)), sizes))
            cols = [batch.column(i).take(row) for i in range(len(names))] + [pa.array(np.concatenate(c), t) for c, t in zip((pairs, times, values), (pa.int32(), pa.int32(), pa.float64()))]
            yield pa.RecordBatch.from_arrays(cols, names=[*names, "pair", "t", "shift"])

    return _series(win, keys, None).select(*keys, "m").mapInArrow(apply, schema)


def channel_shifts(shifts: DataFrame, nch: int = 9, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """(keys, pos, shift): cumulative median shift of each channel, towards the middle one."""
    med = shifts.groupBy(*keys, "pair").agg(F.median("shift").alias("m"))
    rows = med.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("pair", "m"))).alias("s"))
    # channel 0 has none; channel k has the sum of the pairs before it
    cum = F.transform(F.sequence(F.lit(0), F.lit(nch - 1)), lambda k: F.aggregate(F.filter("s", lambda x: x["pair"] < k), F.lit(0.0), lambda a, x: a + x["m"]))
    rows = rows.select(*keys, cum.alias("c"))
    return rows.select(*keys, F.posexplode(F.transform("c", lambda x: -(x - F.get("c", F.lit((nch - 1) // 2))))).alias("pos", "shift"))


def align_shift(win: DataFrame, shifts: DataFrame, nch: int = 9, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Windows with each channel moved by its shift, by linear interpolation held at the ends."""
    ch = win.groupBy(*keys, "pos").agg(F.transform(F.sort_array(F.collect_list(F.struct("t", "v"))), lambda x: x["v"]).alias("x"))
    return _moved(ch.join(channel_shifts(shifts, nch, keys), [*keys, "pos"]), keys)


def _moved(rows: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """(keys, pos, t, v) of channels ``rows(keys, pos, x, shift)``, each moved by its shift."""
    n = F.size("x")

    def moved(t):
        at = F.least(F.greatest(t + F.col("shift"), F.lit(0.0)), (n - 1).cast("double"))
        lo = F.least(F.floor(at), n - 2).cast("int")
        a, b = F.get("x", lo), F.get("x", lo + 1)
        return a + (at - lo) * (b - a)

    return rows.select(*keys, "pos", F.posexplode(F.transform(F.sequence(F.lit(0), n - 1), moved)).alias("t", "v"))


def _channels(sig: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """(by, _i, _n, x): each channel's samples in order, gathered once; see ``dense_channels``."""
    rows = sig.join(dense_channels(sig, by), [*by, "ch"]).groupBy(*by, "_i", "_n")
    return rows.agg(F.transform(F.sort_array(F.collect_list(F.struct("t_idx", "v"))), lambda x: x["v"]).alias("x"))


@F.pandas_udf(T.DoubleType())
def _lag(a: pd.Series, b: pd.Series, most: pd.Series) -> pd.Series:
    return pd.Series([float(-kernels.best_lag(np.asarray(x, float), np.asarray(y, float), m)) for x, y, m in zip(a, b, most)], dtype=float)


def pair_lags(sig: DataFrame, max_lag: int, nch: int = 9, step: int = 1, by: tuple[str, ...] = ("fiber_id",)) -> DataFrame:
    """(by, window, pair, n, shift): ``pair_shift`` of all windows of a signal, one row a pair of ``n`` samples.

    A shift is a pair's own, so it is computed once and then dealt to the overlapping windows
    that hold both channels. ``over_time`` gives a row for each sample.
    """
    # a channel goes to its pair with the next channel and to that with the one before
    ends = F.array(F.struct(F.col("_i").alias("pair"), F.lit(0).alias("side")), F.struct((F.col("_i") - 1).alias("pair"), F.lit(1).alias("side")))
    two = _channels(sig, by).select(*by, "_n", "x", F.inline(ends)).groupBy(*by, "_n", "pair").agg(F.sort_array(F.collect_list(F.struct("side", "x"))).alias("s"))
    two = two.filter(F.size("s") == 2).select(*by, "_n", "pair", F.col("s")[0]["x"].alias("a"), F.col("s")[1]["x"].alias("b"))
    lags = two.select(*by, "_n", F.col("pair").alias("_i"), F.size("a").alias("n"), _lag("a", "b", F.lit(max_lag)).alias("shift"))
    return explode_windows(lags, F.col("_i"), nch - 1, step, F.col("_n") - 1, pos="pair").select(*by, "window", "pair", "n", "shift")


def over_time(lags: DataFrame) -> DataFrame:
    """A row of ``pair_lags`` for each sample ``t``."""
    return lags.withColumn("t", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).drop("n")


def align_windows(sig: DataFrame, shifts: DataFrame, nch: int = 9, step: int = 1, by: tuple[str, ...] = ("fiber_id",)) -> DataFrame:
    """``align_shift`` of all windows of a signal: channels are gathered once and dealt to windows as arrays."""
    keys = (*by, "window")
    ch = explode_windows(_channels(sig, by), F.col("_i"), nch, step, F.col("_n")).select(*keys, "pos", "x")
    return _moved(ch.join(channel_shifts(shifts, nch, keys), [*keys, "pos"]), keys)


def pair_speed(shifts: DataFrame, fs: float, gauge: float) -> DataFrame:
    """km/h of each pair and time from the displacement in samples."""
    return shifts.withColumn("speed", F.abs(F.lit(3.6 * fs * gauge) / (F.col("shift") + 1e-8)))


def _boxes(rows: DataFrame, line: list[str], t: str, w: int, safety: int | None) -> DataFrame:
    """Adds ``g``, the box sums of ``p`` along each line; see ``glrt``."""
    along = W.partitionBy(*line).orderBy(t)
    rows = rows.withColumn("_n", F.count(F.lit(1)).over(W.partitionBy(*line)))
    if safety is None:
        return rows.withColumn("g", F.sum("p").over(along.rowsBetween(0, w - 1))).filter(F.col(t) < F.col("_n") - w).drop("_n")
    g = F.sum("p").over(along.rowsBetween(-(w // 2), w - w // 2 - 1))
    return rows.withColumn("g", F.when((F.col(t) >= safety + w // 2) & (F.col(t) < F.col("_n") - safety - w // 2), g).otherwise(0.0)).drop("_n")


def glrt(win: DataFrame, w: int = 20, safety: int | None = 15, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """(keys, pair, t, g): box sums of the product of adjacent channels, 0 within the margins.

    Output t holds the samples [t - w/2, t + w/2), and is 0 outside
    [safety + w/2, T - safety - w/2). ``safety=None`` sums whole boxes only, without margins.
    """
    pos = W.partitionBy(*keys, "t").orderBy("pos")
    rows = win.withColumn("p", F.col("v") * F.lead("v").over(pos)).filter("p is not null").withColumnRenamed("pos", "pair")
    return _boxes(rows, [*keys, "pair"], "t", w, safety).select(*keys, "pair", "t", "g")


def glrt_windows(sig: DataFrame, nch: int = 9, step: int = 1, w: int = 20, safety: int | None = 15, by: tuple[str, ...] = ("fiber_id",)) -> DataFrame:
    """``glrt`` of all windows of a signal, computed once for each pair of adjacent channels.

    Products and box sums are a pair's own; only then are pairs dealt to the overlapping
    windows that hold both channels.
    """
    dense = dense_channels(sig, by)
    rows = sig.join(dense, [*by, "ch"]).select(*by, "_i", "_n", F.col("t_idx").alias("t"), "v")
    at = W.partitionBy(*by, "t").orderBy("_i")
    rows = rows.withColumn("p", F.when(F.lead("_i").over(at) == F.col("_i") + 1, F.col("v") * F.lead("v").over(at))).filter("p is not null").withColumnRenamed("_n", "_total")
    rows = _boxes(rows, [*by, "_i"], "t", w, safety)
    return explode_windows(rows, F.col("_i"), nch - 1, step, F.col("_total") - 1, pos="pair").select(*by, "window", "pair", "t", "g")


def glrt_sum(g: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    return g.groupBy(*keys, "t").agg(F.sum("g").alias("g"))


def mask(df: DataFrame, thr: float | Column, col: str = "g") -> DataFrame:
    return df.withColumn("mask", F.col(col) >= thr)


def mask_by_section(g: DataFrame, calib: DataFrame, default: float) -> DataFrame:
    """Mask by each section's own threshold, the default where it has none."""
    c = calib.select(F.col("section_idx").alias("window"), F.col("threshold").alias("_thr"), *[x for x in ("fiber_id",) if x in calib.columns])
    rows = g.join(c, [x for x in ("fiber_id", "window") if x in c.columns], "left")
    return rows.withColumn("mask", F.col("g") >= F.coalesce("_thr", F.lit(default))).drop("_thr")


def coupling_correct(g: DataFrame, calib: DataFrame, forward_only: bool = True) -> DataFrame:
    """The statistic times the section's factor (missing: 1); only direction 0 unless told otherwise."""
    c = calib.select("fiber_id", F.col("section_idx").alias("window"), F.col("correction").alias("_c"))
    rows = g.join(c, ["fiber_id", "window"], "left")
    f = F.coalesce("_c", F.lit(1.0))
    if forward_only and "direction" in g.columns:
        f = F.when(F.col("direction") == 0, f).otherwise(1.0)
    return rows.withColumn("g", F.col("g") * f).drop("_c")


def intervals(df: DataFrame, keys: tuple[str, ...] = KEYS, order: str = "t", flag: str = "mask") -> DataFrame:
    """Half-open runs [start_idx, end_idx) of a true mask over consecutive indices."""
    rows = df.filter(F.col(flag)).select(*keys, order)
    rows = rows.withColumn("_run", F.col(order) - F.row_number().over(W.partitionBy(*keys).orderBy(order)))
    return rows.groupBy(*keys, "_run").agg(F.min(order).alias("start_idx"), (F.max(order) + 1).alias("end_idx")).drop("_run")


def within(iv: DataFrame, samples: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Samples (keys, t, ..) of each interval: joined on the window, then by range."""
    return samples.join(iv, list(keys)).filter((F.col("t") >= F.col("start_idx")) & (F.col("t") < F.col("end_idx")))


def gate_speed(speeds: DataFrame, masked: DataFrame, lo: float = 20, hi: float = 120, mode: str = "midpoint", keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Speeds by pair: 0 outside the mask; null for a whole interval whose representative is out of range.

    The representative is the value at (start + end) // 2 or the median of the interval.
    """
    k = (*keys, "pair")
    rows = speeds.withColumn("speed", no_nan("speed")).join(masked.select(*k, "t", "mask"), [*k, "t"])
    # a run of the mask keeps the distance of its times to its row numbers
    run = F.col("t") - F.row_number().over(W.partitionBy(*k, "mask").orderBy("t"))
    one = W.partitionBy(*k, "mask", "_run")
    rows = rows.withColumn("_run", run).withColumn("_end", F.max("t").over(one) + 1).withColumn("_mid", F.least(F.floor((F.min("t").over(one) + F.col("_end")) / 2), F.col("_end") - 1))
    rep = F.max(F.when(F.col("t") == F.col("_mid"), F.col("speed"))).over(one) if mode == "midpoint" else F.median("speed").over(one)
    return rows.select(*k, "t", F.when(~F.col("mask"), 0.0).when(rep.between(lo, hi), F.col("speed")).alias("speed"))


def fuse_pair_speed(g: DataFrame, s: DataFrame, lo: float = 20, hi: float = 120, positive: bool = True, weighting: str = "glrt", keys: tuple[str, ...] = KEYS) -> DataFrame:
    """One speed a time from the pairs in range: weighted by the statistic, else their median."""
    rows = g.select(*keys, "pair", "t", "g").join(s.select(*keys, "pair", "t", no_nan("speed").alias("speed")), [*keys, "pair", "t"])
    ok = F.col("speed").between(lo, hi) & ((F.col("g") > 0) if positive else F.lit(True))
    wgt = F.when(ok, F.greatest(F.col("g"), F.lit(0.0)))
    out = rows.groupBy(*keys, "t").agg(F.sum(wgt).alias("w"), F.sum(wgt * F.col("speed")).alias("ws"), F.median(F.when(ok, F.col("speed"))).alias("m"))
    fused = F.when(F.col("w") > 0, F.col("ws") / F.nullif("w", F.lit(0.0))).otherwise(F.col("m")) if weighting == "glrt" else F.col("m")
    return out.select(*keys, "t", fused.alias("speed"))


def section_speed(s: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    return s.groupBy(*keys, "t").agg(F.median(no_nan("speed")).alias("speed"))


def interval_speed(iv: DataFrame, speeds: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Median over pairs of each pair's median positive speed in the interval."""
    rows = within(iv, speeds.select(*keys, "pair", "t", no_nan("speed").alias("speed")), keys)
    per = rows.filter("speed > 0").groupBy(*keys, "start_idx", "end_idx", "pair").agg(F.median("speed").alias("m"))
    return per.groupBy(*keys, "start_idx", "end_idx").agg(F.median("m").alias("speed"))


def interval_strain(iv: DataFrame, aligned: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Mean over channels of the largest magnitude and of the root mean square."""
    rows = within(iv, aligned.select(*keys, "pos", "t", "v"), keys)
    per = rows.groupBy(*keys, "start_idx", "end_idx", "pos").agg(F.max(F.abs("v")).alias("p"), F.sqrt(F.avg(F.col("v") * F.col("v"))).alias("r"))
    return per.groupBy(*keys, "start_idx", "end_idx").agg(F.avg("p").alias("strain_peak"), F.avg("r").alias("strain_rms"))


@F.pandas_udf(T.StructType([T.StructField(n, T.IntegerType()) for n in ("n", "cars", "trucks")]))
def _peak_counts(seg: pd.Series, detect: pd.Series, classify: pd.Series, fs: pd.Series) -> pd.DataFrame:
    got = [kernels.count_peaks(np.asarray(s, float), d, c, f) for s, d, c, f in zip(seg, detect, classify, fs)]
    return pd.DataFrame(got, columns=["n", "cars", "trucks"]).astype("int32")


def count_peaks(iv: DataFrame, g: DataFrame, detect: float | Column, classify: float | Column, fs: float, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Vehicles, cars and trucks of each interval from the peaks of the summed statistic."""
    extra = [c for c in iv.columns if c not in (*keys, "start_idx", "end_idx")]
    rows = within(iv, g.select(*keys, "t", "g"), keys).groupBy(*keys, "start_idx", "end_idx", *extra)
    seg = rows.agg(F.transform(F.sort_array(F.collect_list(F.struct("t", "g"))), lambda x: x["g"]).alias("seg"), F.max("g").alias("glrt_max"))
    lit = lambda x: (x if isinstance(x, Column) else F.lit(x)).cast("double")
    out = seg.withColumn("_c", _peak_counts("seg", lit(detect), lit(classify), lit(fs)))
    return out.select(*keys, "start_idx", "end_idx", *extra, "glrt_max", *[F.col(f"_c.{c}").alias(c) for c in ("n", "cars", "trucks")])


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def _peaks(x: pd.Series, height: pd.Series, distance: pd.Series, prominence: pd.Series) -> pd.Series:
    opt = lambda v: None if pd.isna(v) else float(v)
    return pd.Series([kernels.find_peaks(np.asarray(a, float), opt(h), int(d), opt(p)).astype(np.int32) for a, h, d, p in zip(x, height, distance, prominence)])


def peaks(series: str | Column, height: float | None = None, distance: int = 1, prominence: float | None = None) -> Column:
    """Indices of the peaks of an array column."""
    lit = lambda v: F.lit(v).cast("double")
    return _peaks(F.col(series) if isinstance(series, str) else series, lit(height), F.lit(distance), lit(prominence))


def extract_detections(g: DataFrame, speeds: DataFrame, aligned: DataFrame, fs: float, corr: float, nch: int = 9, lo: float = 20, hi: float = 120, truck: float = 2.0, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Detections of each window: long enough intervals with a speed in range."""
    thr = corr * (nch - 1)
    iv = intervals(mask(g, thr), keys)
    iv = iv.filter(F.col("end_idx") - F.col("start_idx") >= max(3, int(0.3 * fs)))
    s = interval_speed(iv, speeds, keys).filter(F.col("speed").between(lo, hi))
    k = [*keys, "start_idx", "end_idx"]
    rows = s.join(count_peaks(iv, g, thr, truck * thr, fs, keys), k).join(interval_strain(iv, aligned, keys), k)
    return rows.select(*keys, "start_idx", "end_idx", F.floor((F.col("start_idx") + F.col("end_idx")) / 2).alias("t_mid"), "speed", "glrt_max", F.greatest(F.lit(1), F.col("n")).cast("double").alias("vehicle_count"), F.col("cars").cast("double").alias("n_cars"), F.col("trucks").cast("double").alias("n_trucks"), "strain_peak", "strain_rms")


def map_channel(df: DataFrame, start: int, step: int) -> DataFrame:
    """Physical channel of a window index."""
    return df.withColumn("ch", (F.lit(start) + F.col("window") * step).cast("int"))


def detect_windows(win: DataFrame, fs: float, gauge: float, corr: float, nch: int = 9, step: int = 1, max_lag: int = 32, size: int = 312, hop: int = 234, lo: float = 20, hi: float = 120, truck: float = 2.0, start: int = 0) -> DataFrame:
    """Detections of windows in time ``win(fiber_id, section, t_window, ch, t, v)`` (see ``signals.time_windows``).

    Each window in time is split into groups of ``nch`` channels; shifts of their pairs give
    speeds and alignment, products of aligned pairs the statistic, its intervals the detections.
    Of overlapping windows each keeps the middle (as ``edge_trim``), so they tile and nothing
    counts twice. ``t_idx`` is the sample of the signal, ``ch`` the first channel of the group.
    """
    by = ("fiber_id", "section", "t_window")
    keys, rows = (*by, "window"), win.select(*by, "ch", F.col("t").alias("t_idx"), "v")
    lags = pair_lags(rows, max_lag, nch, step, by)
    aligned = align_windows(rows, lags, nch, step, by)
    g = glrt_sum(glrt(aligned, keys=keys), keys)
    out = extract_detections(g, pair_speed(over_time(lags), fs, gauge), aligned, fs, corr, nch, lo, hi, truck, keys)
    trim = max((size - hop) // 2, 15)
    out = map_channel(out.filter(F.col("t_mid").between(trim, size - trim - 1)), start, step)
    return out.withColumn("t_idx", (F.col("t_window") * hop + F.col("t_mid")).cast("long"))


def score_by_model(df: DataFrame, hint: str, models, schema: str, default=None, tasks: int | None = None) -> DataFrame:
    """Applies to the rows of each ``hint`` its model: a function of a pandas frame that scores rows one by one.

    ``models`` is a dictionary or a function that loads the model of a hint (null: None), called
    once a task and hint. Rows stay where they are (or are dealt evenly over ``tasks``), so a
    hint that most rows have is as many tasks as they fill; each batch is split by hint.
    A hint without a model takes ``default``; without that it is an error.
    """

    def run(batches):
        loaded: dict = {}
        for pdf in batches:
            for h, part in pdf.groupby(hint, dropna=False, sort=False):
                h = None if pd.isna(h) else h
                if h not in loaded:
                    loaded[h] = (models(h) if callable(models) else models.get(h)) or default
                    if loaded[h] is None:
                        raise ValueError(f"no model for {hint} = {h!r}")
                yield loaded[h](part.reset_index(drop=True))

    return (df.repartition(tasks) if tasks else df).mapInPandas(run, schema)
