"""Signal steps on long rows (fiber_id, section, ch, t_idx, v).

Time-recursive steps are keyed by channel block, per-sample ones by time index.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import kernels
from .ordered import fold_sorted
from .rollups import quantile_of, quantile_states

Step = Callable[[DataFrame], DataFrame]


def scale(sig: DataFrame, factor: float) -> DataFrame:
    return sig.withColumn("v", F.col("v") * factor)


def spatial_decimate(sig: DataFrame, factor: int, start: int = 0, stop: int | None = None, frame_start: int = 0) -> DataFrame:
    """Channels of [start, stop), every ``factor``-th from the later of start and the frame's start."""
    lo = max(start, frame_start)
    keep = (F.col("ch") >= lo) & ((F.col("ch") - lo) % factor == 0)
    return sig.filter(keep & (F.col("ch") < stop) if stop is not None else keep)


def no_nan(c: str) -> Column:
    return F.when(~F.isnan(c), F.col(c))


def common_mode_removal(sig: DataFrame, method: str = "median", by: tuple[str, ...] = ("fiber_id", "section", "t_idx")) -> DataFrame:
    """Subtracts each sample's spatial median or mean; NaN and null do not count and stay null."""
    rows = sig.withColumn("v", no_nan("v"))
    agg = F.median("v") if method == "median" else F.avg("v")
    return rows.withColumn("v", F.col("v") - agg.over(W.partitionBy(*by)))


def cmr_arrays(frames: DataFrame, n: Column, values: str = "values") -> DataFrame:
    """Common-mode removal inside each frame's array (samples x n channels), before any explode: no shuffle.

    The median of each sample is the middle of its sorted row.
    """
    row = lambda s: F.slice(values, (s * n + 1).cast("int"), n.cast("int"))
    samples = F.sequence(F.lit(0), (F.size(values) / n).cast("int") - 1)

    def centred(s):
        r = row(s)
        x = F.array_sort(F.filter(r, lambda v: v.isNotNull() & ~F.isnan(v)))
        k = F.size(x)
        mid = (F.get(x, F.floor((k - 1) / 2).cast("int")) + F.get(x, F.floor(k / 2).cast("int"))) / 2
        return F.transform(r, lambda v: v - mid)

    return frames.withColumn(values, F.flatten(F.transform(samples, centred)))


def warmup_drop(sig: DataFrame, seconds: float, fs: float) -> DataFrame:
    """Drops whole frames until int(seconds * fs) samples were seen before them."""
    n = sig.groupBy("fiber_id", "frame_seq").agg(F.countDistinct("sample").alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.partitionBy("fiber_id").orderBy("frame_seq").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    warm = n.withColumn("_b", before).filter(F.col("_b") >= int(seconds * fs)).select("fiber_id", "frame_seq")
    return sig.join(warm, ["fiber_id", "frame_seq"], "leftsemi")


#: Samples of a channel that one task filters at a time.
SPAN = 4096


def _same_length(pdf: pd.DataFrame):
    """(rows sorted by channel and time, [(channels, places in the rows)]): channels with as many samples go together."""
    pdf = pdf.sort_values(["ch", "t_idx"], kind="stable").reset_index(drop=True)
    size = pdf.groupby("ch", sort=True).size()
    start = size.cumsum() - size
    return pdf, [(c := size.index[size == n].to_numpy(), start[c].to_numpy()[:, None] + np.arange(n)) for n in size.unique()]


def _finite(v) -> np.ndarray:
    return np.nan_to_num(np.asarray(v, np.float64), nan=0.0, posinf=0.0, neginf=0.0)


def _stack(column) -> np.ndarray:
    return np.stack([np.asarray(x, np.float64) for x in column])


class _Carry:
    """Adds states up over chunks: what a state becomes after a number of samples, and the steps between."""

    def __init__(self, sos: np.ndarray):
        self.step, self.known = kernels.state_step(sos), {}

    def over(self, state: np.ndarray, n: int, own) -> np.ndarray:
        if n not in self.known:
            self.known[n] = np.linalg.matrix_power(self.step, n)
        return state @ self.known[n] + np.asarray(own)


def _fold_chunks(rows: DataFrame, key: list[str], order: str, begin: Callable, names: str) -> DataFrame:
    """Folds the chunks of each channel in order: ``begin()`` gives (add(row) -> rows, end() -> rows) for a channel."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*key, "_block", "_chunk").schema.fields) + f", {names}"
    types = {"array<double>": pa.list_(pa.float64())}
    added = [(n.split()[0], types[n.split()[1]]) for n in names.split(", ")]

    def fold(batches):
        now = add = end = None
        for batch in batches:
            kinds = [batch.schema.field(c) for c in (*key, "_block", "_chunk")]
            out = []
            for row in batch.to_pylist():
                k = tuple(row[c] for c in key)
                if k != now:
                    out += end() if end else []
                    now, (add, end) = k, begin()
                out += add(row)
            yield _arrow(out, kinds, added)
        if end:
            yield _arrow(end(), kinds, added)

    return fold_sorted(rows, key, [order], fold, schema)


def _arrow(rows: list[dict], kinds: list, added: list) -> pa.RecordBatch:
    fields = [(f.name, f.type) for f in kinds] + added
    return pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], t) for n, t in fields], names=[n for n, _ in fields])


def _chunks(sig: DataFrame, block: int, span: int) -> DataFrame:
    return sig.withColumn("_block", F.floor(F.col("ch") / block)).withColumn("_chunk", F.floor(F.col("t_idx") / span))


def _with_states(dealt: DataFrame, states: DataFrame, group: list[str], run: Callable, schema: str) -> DataFrame:
    """``run(rows, states by channel)`` for each chunk of samples and its channels' states."""

    def apply(pdf: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        return run(pdf, own.set_index("ch"))

    return dealt.groupBy(*group).cogroup(states.groupBy(*group)).applyInPandas(apply, schema)


def _ends(dealt: DataFrame, sos: np.ndarray, group: list[str], edge: int = 0) -> DataFrame:
    """What each chunk does to its channels' states: (.., ch, n, z), and its first and last ``edge`` samples."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in dealt.select(*group, "ch").schema.fields) + ", n bigint, z array<double>, head array<double>, tail array<double>"

    def apply(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, parts = _same_length(pdf)
        v, out = _finite(pdf["v"]), []
        for chans, at in parts:
            x = v[at]
            z = x @ kernels.state_table(sos, x.shape[1])[::-1]
            own = {"ch": chans, "n": x.shape[1], "z": list(z), "head": [r[:edge] for r in x], "tail": [r[max(0, len(r) - edge) :] for r in x]}
            out.append(pd.DataFrame(own | {g: pdf[g].iloc[0] for g in group}))
        return pd.concat(out)[[*group, "ch", "n", "z", "head", "tail"]]

    return dealt.groupBy(*group).applyInPandas(apply, schema)


def _filtered(sos: np.ndarray, x: np.ndarray, start: np.ndarray) -> np.ndarray:
    return kernels.sosfilt(sos, x, kernels.by_section(start, len(sos)))[0]


def bandpass(sig: DataFrame, low: float, high: float, fs: float, keys: tuple[str, ...] = ("fiber_id", "section"), block: int = 64, span: int = SPAN) -> DataFrame:
    """Causal Butterworth band-pass of order 4 along time; non-finite samples count as 0.

    Tasks hold ``block`` channels over ``span`` of t_idx. What a chunk adds to its channels'
    states is linear, so all chunks tell it at once; a fold over chunks, not samples, gives
    each its true start, from which it is filtered.
    """
    sos = kernels.butter_bandpass_sos(low, high, fs)
    dealt, group, key, columns = _chunks(sig, block, span), [*keys, "_block", "_chunk"], [*keys, "ch"], sig.columns

    def begin():
        carry, state = _Carry(sos), [np.zeros(2 * len(sos))]

        def add(row):
            own, state[0] = state[0], carry.over(state[0], row["n"], row["z"])
            return [row | {"start": own}]

        return add, lambda: []

    starts = _fold_chunks(_ends(dealt, sos, group), key, "_chunk", begin, "start array<double>")

    def run(pdf, own):
        pdf, parts = _same_length(pdf)
        v = _finite(pdf["v"])
        for chans, at in parts:
            v[at] = _filtered(sos, v[at], _stack(own.start[chans]))
        return pdf.assign(v=v)[columns]

    return _with_states(dealt, starts, group, run, sig.schema.simpleString()[7:-1])


def bandpass_zero_phase(sig: DataFrame, low: float, high: float, fs: float, keys: tuple[str, ...] = ("fiber_id", "section"), block: int = 64, span: int = SPAN) -> DataFrame:
    """Forward-backward band-pass; the high cut is at most 0.95 of the Nyquist rate.

    Chunks as in ``bandpass``, folded forwards and then, over the forward output, backwards.
    The odd extension at a channel's ends is made in the first fold from its outer samples.
    """
    sos = kernels.butter_bandpass_sos(low, min(high, 0.95 * fs / 2), fs)
    dealt, group, key, columns = _chunks(sig, block, span), [*keys, "_block", "_chunk"], [*keys, "ch"], sig.columns
    most, calm = kernels.padding(sos), kernels.steady(sos)
    pass_ = lambda x, z: [r[0] for r in (lambda y, s: (y, s.transpose(1, 0, 2).reshape(1, -1)))(*kernels.sosfilt(sos, x[None], kernels.by_section(z[None], len(sos))))]

    def forward():
        carry, held, state, tail = _Carry(sos), [], [None], [np.zeros(0)]

        def begun(pad):
            """The chunks that waited for enough samples to extend the channel's begin."""
            x = np.concatenate([np.asarray(r["head"]) for r in held])[: pad + 1]
            before = 2 * x[0] - x[pad:0:-1]
            first = before[0] if pad else x[0]
            state[0] = pass_(before, calm * first)[1] if pad else calm * first
            waited, held[:] = list(held), []
            return [y for r in waited for y in go(r)]

        def go(row):
            own, state[0] = state[0], carry.over(state[0], row["n"], row["z"])
            tail[0] = np.concatenate([tail[0], row["tail"]])[-most - 1 :]
            last.update(row | {"start": own})
            return [row | {"start": own}]

        last: dict = {}
        kept: list = []  # a row waits for the next, as the last one also has the backward start

        def add(row):
            if state[0] is not None:
                out = go(row)
            else:
                held.append(row)
                out = begun(most) if sum(r["n"] for r in held) > most else []
            kept.extend(out)
            out, kept[:] = kept[:-1], kept[-1:]
            return out

        def end():
            if state[0] is None:
                kept.extend(begun(sum(r["n"] for r in held) - 1))
            pad = min(most, len(tail[0]) - 1)
            after = 2 * tail[0][-1] - tail[0][-2 : -pad - 2 : -1]
            if pad:
                y = pass_(after, state[0])[0]
                back = pass_(y[::-1], calm * y[-1])[1]
            else:
                back = calm * pass_(tail[0][-1:], last["start"])[0][-1]
            return [*kept[:-1], kept[-1] | {"back": back}]

        return add, end

    starts = _fold_chunks(_ends(dealt, sos, group, most + 1), key, "_chunk", forward, "start array<double>, back array<double>")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in dealt.select(*group, "ch").schema.fields) + ", n bigint, z array<double>, start array<double>, back array<double>, _turn bigint"

    def ends_back(pdf, own):
        pdf, parts = _same_length(pdf)
        v, out = _finite(pdf["v"]), []
        for chans, at in parts:
            y = _filtered(sos, v[at], _stack(own.start[chans]))
            z = y @ kernels.state_table(sos, y.shape[1])
            mine = {"ch": chans, "n": y.shape[1], "z": list(z), "start": list(own.start[chans]), "back": list(own.back[chans]), "_turn": -int(pdf["_chunk"].iloc[0])}
            out.append(pd.DataFrame(mine | {g: pdf[g].iloc[0] for g in group}))
        return pd.concat(out)[[*group, "ch", "n", "z", "start", "back", "_turn"]]

    def backward():
        carry, state = _Carry(sos), [None]

        def add(row):
            own = np.asarray(row["back"]) if state[0] is None else state[0]
            state[0] = carry.over(own, row["n"], row["z"])
            return [row | {"back": own}]

        return add, lambda: []

    both = _fold_chunks(_with_states(dealt, starts, group, ends_back, schema), key, "_turn", backward, "start array<double>, back array<double>")

    def run(pdf, own):
        pdf, parts = _same_length(pdf)
        v = _finite(pdf["v"])
        for chans, at in parts:
            y = _filtered(sos, v[at], _stack(own.start[chans]))
            v[at] = _filtered(sos, y[:, ::-1], _stack(own.back[chans]))[:, ::-1]
        return pdf.assign(v=v)[columns]

    return _with_states(dealt, both, group, run, sig.schema.simpleString()[7:-1])


def temporal_decimate(sig: DataFrame, n: int, dense: bool = True) -> DataFrame:
    """Keeps every n-th sample, counted from 1; ``dense`` says that t_idx counts without gaps from 0."""
    if dense:
        return sig.filter((F.col("t_idx") + 1) % n == 0)
    rows = sig.withColumn("_k", F.row_number().over(W.partitionBy("fiber_id", "section", "ch").orderBy("t_idx")))
    return rows.filter(F.col("_k") % n == 0).drop("_k")


# composition -----------------------------------------------------------------
_STEPS: dict[str, tuple[Callable[..., DataFrame], dict]] = {}


def register_step(name: str, fn: Callable[..., DataFrame], defaults: dict | None = None) -> None:
    """Makes a DataFrame function available to pipelines under a name."""
    _STEPS[name] = fn, defaults or {}


for _name, _fn, _d in (("scale", scale, {"factor": 1.0}), ("spatial_decimation", spatial_decimate, {"factor": 1}), ("common_mode_removal", common_mode_removal, {"method": "median"}), ("bandpass_filter", bandpass, {}), ("temporal_decimation", temporal_decimate, {"n": 1})):
    register_step(_name, _fn, _d)


def build_pipeline(steps: list[dict], bounds: tuple[int, int] | None = None, declared_order: bool = False) -> Step:
    """One function of a list of {step, params}.

    Channel selection goes first unless ``declared_order``: it leaves fewer rows, but a
    common mode taken after it is that of the selected channels. A section's bounds are
    given to the spatial step.
    """
    todo = [s for s in steps if s["step"] in _STEPS]
    if len(todo) != len(steps):
        raise ValueError(f"unknown steps: {[s['step'] for s in steps if s['step'] not in _STEPS]}")
    if not declared_order:
        todo = sorted(todo, key=lambda s: s["step"] != "spatial_decimation")

    def apply(sig: DataFrame) -> DataFrame:
        for s in todo:
            fn, defaults = _STEPS[s["step"]]
            params = {**defaults, **s.get("params", {})}
            if s["step"] == "spatial_decimation" and bounds:
                params = {**params, "start": bounds[0], "stop": bounds[1]}
            sig = sig.transform(lambda d, fn=fn, p=params: fn(d, **p))
        return sig

    return apply


# profiles and normalisation ---------------------------------------------------
def join_back(df: DataFrame, stats: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """``df`` with the columns of ``stats``, one row a group; the null group is one too."""
    if not by:
        return df.join(F.broadcast(stats))  # one row
    stats = stats.select(*[F.col(c).alias(f"_by_{c}") if c in by else F.col(c) for c in stats.columns])
    same = F.col(by[0]).eqNullSafe(F.col(f"_by_{by[0]}"))
    for c in by[1:]:
        same = same & F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    return df.join(stats, same).drop(*[f"_by_{c}" for c in by])


def channel_profile(sig: DataFrame, dead: float = 1e-6) -> DataFrame:
    rows = sig.groupBy("fiber_id", "ch").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"), F.max(F.abs("v")).alias("peak"), F.sqrt(F.avg(F.col("v") * F.col("v"))).alias("rms"))
    return rows.withColumn("dead", F.col("std") < dead)


def demean(sig: DataFrame, *by: str) -> DataFrame:
    return sig.withColumn("v", F.col("v") - F.avg("v").over(W.partitionBy(*(by or ("fiber_id", "ch")))))


def zscore(sig: DataFrame, by: tuple[str, ...], eps: float = 1e-8) -> DataFrame:
    """Deviations from the group's mean over its standard deviation.

    Groups may be large, so their moments are aggregated and joined back.
    """
    stats = sig.groupBy(*by).agg(F.avg("v").alias("_m"), F.stddev_pop("v").alias("_s"))
    return join_back(sig, stats, by).withColumn("v", (F.col("v") - F.col("_m")) / (F.col("_s") + eps)).select(*sig.columns)


def normalize_energy(win: DataFrame, window: tuple[str, ...] = ("fiber_id",)) -> DataFrame:
    """Demeans each channel and scales it to the mean channel energy of its window; silent channels stay."""
    ch = win.groupBy(*window, "ch").agg(F.avg("v").alias("_m"), (F.var_pop("v") * F.count("v")).alias("_e"))
    ch = ch.withColumn("_mean", F.avg("_e").over(W.partitionBy(*window)))  # a row a channel, not a sample
    gain = F.when(F.col("_e") > 0, F.sqrt(F.col("_mean") / F.nullif("_e", F.lit(0.0)))).otherwise(1.0)
    return join_back(win, ch.select(*window, "ch", "_m", gain.alias("_k")), (*window, "ch")).withColumn("v", (F.col("v") - F.col("_m")) * F.col("_k")).select(*win.columns)


# windows ----------------------------------------------------------------------
def explode_windows(df: DataFrame, index: Column, size: int, step: int, total: Column, window: str = "window", pos: str = "pos") -> DataFrame:
    """A copy of each row for every complete window [k * step, k * step + size) that holds its index."""
    first = F.greatest(F.lit(0), F.ceil((index - (size - 1)) / step)).cast("int")
    last = F.least(F.floor(index / step), F.floor((total - size) / step)).cast("int")
    k = F.when(last >= first, F.sequence(first, last))
    return df.withColumn(window, F.explode(k)).withColumn(pos, (index - F.col(window) * step).cast("int"))


def dense_channels(sig: DataFrame, by: tuple[str, ...] = ("fiber_id",)) -> DataFrame:
    """(by, ch, _i, _n): each channel's place among those there are, and their number."""
    dense = sig.select(*by, "ch").distinct().withColumn("_i", F.row_number().over(W.partitionBy(*by).orderBy("ch")) - 1)
    return dense.withColumn("_n", F.count(F.lit(1)).over(W.partitionBy(*by)))


def spatial_windows(sig: DataFrame, nch: int = 9, step: int = 1, by: tuple[str, ...] = ("fiber_id",)) -> DataFrame:
    """Overlapping groups of ``nch`` adjacent channels; an incomplete tail is dropped."""
    dense = dense_channels(sig, by)
    return explode_windows(sig.join(dense, [*by, "ch"]), F.col("_i"), nch, step, F.col("_n")).drop("_i", "_n")


def time_windows(sig: DataFrame, size: int = 312, step: int = 234, by: tuple[str, ...] = ("fiber_id",)) -> DataFrame:
    """Overlapping windows of ``size`` samples by count; t_idx counts without gaps from 0."""
    total = sig.groupBy(*by).agg((F.max("t_idx") + 1).alias("_n"))
    return explode_windows(sig.join(F.broadcast(total), list(by)), F.col("t_idx"), size, step, F.col("_n"), "t_window", "t").drop("_n")


def edge_trim(win: DataFrame, size: int, step: int, least: int = 15, pos: str = "t") -> DataFrame:
    """Without max((size - step) / 2, least) samples at both ends, so that windows tile."""
    trim = max((size - step) // 2, least)
    return win.filter(F.col(pos).between(trim, size - trim - 1))


def both_directions(sig: DataFrame, n: Column | None = None) -> DataFrame:
    """The rows as they are (direction 0) and with channels in reverse (direction 1, ``ch`` = n - 1 - ch)."""
    back = sig
    if n is None:
        back, n = join_back(sig, sig.groupBy("fiber_id").agg(F.max("ch").alias("_top")), ("fiber_id",)), F.col("_top") + 1
    back = back.withColumn("ch", (n - 1 - F.col("ch")).cast("int")).select(*sig.columns)
    return sig.withColumn("direction", F.lit(0)).unionByName(back.withColumn("direction", F.lit(1)))


def training_windows(sig: DataFrame, nch: int, length: int, step_ch: int, step_t: int, least: float = 1e-8) -> DataFrame:
    """z-scored windows of channels x time for training; flat ones (std below ``least``) go."""
    rows = time_windows(spatial_windows(sig, nch, step_ch), length, step_t)
    w = W.partitionBy("fiber_id", "window", "t_window")
    rows = rows.withColumn("_s", F.stddev_pop("v").over(w)).filter(F.col("_s") >= least)
    return rows.withColumn("v", (F.col("v") - F.avg("v").over(w)) / F.col("_s")).drop("_s")


def waterfall(sig: DataFrame, gauge: float, bin_ch: int = 1, bin_t: int = 1) -> DataFrame:
    """Mean demeaned amplitude by distance (km) and time cell, with the display range of two deviations."""
    rows = demean(sig).groupBy("fiber_id", F.floor(F.col("ch") / bin_ch).alias("d"), F.floor(F.col("t_idx") / bin_t).alias("t")).agg(F.avg("v").alias("amp"))
    spread = rows.groupBy("fiber_id").agg((2 * F.stddev_pop("amp")).alias("range"))
    return rows.join(F.broadcast(spread), "fiber_id").withColumn("km", F.col("d") * bin_ch * gauge / 1000)


def waterfall_marks(det: DataFrame, gauge: float, exact: bool = False, k: int = 800) -> DataFrame:
    """Detections on the grid, with the speed scale from the 2nd to the 98th percentile, of sketches unless ``exact``."""
    if exact:
        p = det.groupBy("fiber_id").agg(F.percentile("speed", F.array(F.lit(0.02), F.lit(0.98))).alias("p"))
    else:
        p = quantile_states(det, ["fiber_id"], "speed", k).select("fiber_id", F.array(quantile_of("sketch", 0.02), quantile_of("sketch", 0.98)).alias("p"))
    rows = det.join(p, "fiber_id")
    return rows.withColumn("km", F.col("ch") * gauge / 1000).withColumn("colour", F.greatest(F.get("p", F.lit(0)), F.least(F.get("p", F.lit(1)), F.col("speed")))).drop("p")


def map_records(df: DataFrame, fn: Callable, schema: str, tag_errors: bool = False) -> DataFrame:
    """Per-record transform, one to one or one to many: ``fn`` takes and gives iterators of pandas batches.

    With ``tag_errors`` a record that makes ``fn`` fail does not end the job: batches that fail
    are halved until the record stands alone, which then is one row of nulls with ``_error``
    (what was raised) and ``_record`` (the record as JSON); ``fn`` must treat records one by one.
    """
    if not tag_errors:
        return df.mapInPandas(fn, schema)

    def told(pdf):
        try:
            yield from [x.assign(_error=None, _record=None) for x in fn(iter([pdf]))]
        except Exception as e:  # noqa: BLE001 what a record's transform raises is its own affair
            if len(pdf) > 1:
                yield from told(pdf.iloc[: len(pdf) // 2].reset_index(drop=True))
                yield from told(pdf.iloc[len(pdf) // 2 :].reset_index(drop=True))
            elif len(pdf):
                yield pd.DataFrame({"_error": [f"{type(e).__name__}: {e}"[:1000]], "_record": [pdf.to_json(orient="records", lines=True, date_format="iso").strip()]})

    def run(batches):
        for pdf in batches:
            for out in told(pdf):
                yield out.reindex(columns=names)

    out = StructType.fromDDL(f"{schema}, _error string, _record string")
    names = out.names
    return df.mapInPandas(run, out)


def map_windows(df: DataFrame, key: list[str], fn: Callable, schema: str, order: list[str] | None = None) -> DataFrame:
    """Per-window transform, many to many: ``fn`` takes and gives a pandas frame for each key, its rows by ``order``.

    Rows are sorted by Spark and a task reads them as a stream, so it holds one window and
    one batch at a time, however many windows it has. Nulls in the key are a key of their own.
    """

    def run(batches):
        held, now = [], None

        def whole():
            return pd.concat(held, ignore_index=True) if len(held) > 1 else held[0].reset_index(drop=True)

        for pdf in batches:
            if not len(pdf):
                continue
            keys = pdf[key]
            before = keys.shift()
            cuts = np.flatnonzero(((keys != before) & ~(keys.isna() & before.isna())).any(axis=1).to_numpy()[1:]) + 1
            for part in np.split(np.arange(len(pdf)), cuts):
                part = pdf.iloc[part]
                mine = tuple(None if pd.isna(x) else x for x in part[key].iloc[0])
                if held and mine != now:
                    yield fn(whole())
                    held = []
                now = mine
                held.append(part)
        if held:
            yield fn(whole())

    return df.repartition(*key).sortWithinPartitions(*key, *(order or [])).mapInPandas(run, schema)
