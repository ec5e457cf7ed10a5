"""Structured Streaming jobs: ingest, rollups, stateful filters, incidents, tracks, alerts.

Every stateful job shares its step with the batch operator, so chunked input gives the
batch's rows. State lives in the state store by key; offsets are committed after the
output through the checkpoint.
"""

from __future__ import annotations

import pickle
import time
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import kernels
from ..operators import alerts, incidents, joins, ordered, rollups
from ..sources import frames

BLOB = "state binary"


def watermark(df: DataFrame, delay: str = "10 minutes", col: str = "ts") -> DataFrame:
    """Rows later than the delay are dropped by stateful operators; a batch rollup of the stored rows corrects them."""
    return df.withWatermark(col, delay)


def enrich_stream(batches: DataFrame, cables: DataFrame) -> DataFrame:
    """Flattened, deduplicated and enriched detections of a stream of batch records (the first insert wins)."""
    det = watermark(frames.flatten_detections(batches))
    det = det.dropDuplicatesWithinWatermark(["fiber_id", "ts", "ch", "direction"])
    return joins.enrich_geo(det, cables)


def ingest_stream(batches: DataFrame, cables: DataFrame, out: str, checkpoint: str, **trigger):
    """Writes the enriched detections partitioned by fiber and day."""
    rows = enrich_stream(batches, cables).withColumn("date", F.to_date("ts"))
    return rows.writeStream.format("parquet").partitionBy("fiber_id", "date").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(**(trigger or {"availableNow": True})).start()


def _minutes(hires: DataFrame, delay: str) -> DataFrame:
    rows = watermark(hires, delay).withColumn("w", F.window("ts", "1 minute"))
    return rollups.state_agg(rows, ["fiber_id", "w", "ch", "direction"])


def rollup_stream(hires: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Continuous minute states."""
    return _minutes(hires, delay).withColumn("ts", F.col("w.start")).drop("w")


def rollup_hours_stream(hires: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Continuous hour states from minute states in one query: two aggregates, one after the other.

    A minute goes into its hour when the watermark closes it, an hour comes out when the
    watermark has passed it (append mode). Rows behind the watermark are dropped and counted in the
    query's progress; ``sources.corrections`` keeps them and mends the tiers.
    """
    hour = F.window(F.window_time("w"), "1 hour")
    return rollups.merge_states(_minutes(hires, delay), ["fiber_id", hour.alias("h"), "ch", "direction"]).withColumn("ts", F.col("h.start")).drop("h")


def _is_done(spark: SparkSession, done: str, batch: int) -> bool:
    try:
        return not spark.read.schema("at timestamp, batch_id long").parquet(done).filter(F.col("batch_id") == batch).isEmpty()
    except AnalysisException:  # no batch has been written yet
        return False


def upsert_batches(write: Callable[[DataFrame, int], None], done: str | None = None) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that runs each batch id once: replays find it in the table of done ids at ``done``.

    ``write`` must itself be idempotent by batch id (overwrite its partition), as the
    process can end between the write and the note that it is done. Without ``done``
    every replay writes again.
    """

    def run(df: DataFrame, batch: int) -> None:
        spark = df.sparkSession
        if done and _is_done(spark, done, batch):
            return
        df.persist()
        try:
            write(df, batch)
        finally:
            df.unpersist()
        if done:
            spark.range(1).select(F.current_timestamp().alias("at")).write.mode("overwrite").parquet(f"{done}/batch_id={batch}")

    return run


def overwrite_batch(path: str) -> Callable[[DataFrame, int], None]:
    """Writes each micro-batch as the partition ``batch_id``: again is the same."""
    return lambda df, batch: df.withColumn("batch_id", F.lit(batch)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(path)


def static_refresh(load: Callable[[SparkSession], DataFrame], use: Callable[[DataFrame, DataFrame], DataFrame], write: Callable[[DataFrame, int], None], every: int = 1):
    """A ``foreachBatch`` function that reads a dimension anew every so many batches."""
    held: dict = {}

    def run(df: DataFrame, batch: int) -> None:
        if "dim" not in held or batch % every == 0:
            held["dim"] = load(df.sparkSession)
        write(use(df, held["dim"]), batch)

    return run


def split_to_dlq(checks: dict, source, payload, ok_path: str, dlq_path: str, done: str | None = None) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that stores good rows and dead letters, each by batch id."""

    def write(df: DataFrame, batch: int) -> None:
        ok, dlq = frames.with_dlq(df, checks, source, payload)
        overwrite_batch(ok_path)(ok, batch)
        overwrite_batch(dlq_path)(dlq, batch)

    return upsert_batches(write, done)


def capture_stream(raw: DataFrame, out: str, checkpoint: str, **trigger):
    """Stores each micro-batch's frames of their fiber's most frequent length, by batch id."""
    write = overwrite_batch(out)
    run = lambda df, batch: write(frames.modal_frames(df), batch)
    return raw.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


# stateful by key ---------------------------------------------------------------
def _stateful(df: DataFrame, keys: list[str], schema: str, step: Callable, timeout: str = GroupStateTimeout.NoTimeout, timeout_ms: int | None = None) -> DataFrame:
    """``step(key, pdf or None, state) -> (frame or None, state or None)`` by key; pdf None is a timeout."""

    def run(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = pickle.loads(state.get[0]) if state.exists else None
        if state.hasTimedOut:
            out, held = step(key, None, held)
        else:
            parts = list(pdfs)
            out, held = step(key, pd.concat(parts, ignore_index=True) if parts else pd.DataFrame(), held)
        if held is None:
            if state.exists:
                state.remove()
        else:
            state.update((pickle.dumps(held),))
            if timeout_ms is not None:
                state.setTimeoutDuration(timeout_ms)
        if out is not None and len(out):
            yield out

    return df.groupBy(*keys).applyInPandasWithState(run, schema, BLOB, "append", timeout)


def bandpass_stream(sig: DataFrame, low: float, high: float, fs: float, timeout_ms: int = 3_600_000) -> DataFrame:
    """Causal band-pass with the filter's state carried by (fiber, section) between micro-batches.

    Channels carry their own state, so a micro-batch may lack samples of some or have
    more of others. A channel that was not there before resets all of its key. A key that
    is silent for ``timeout_ms`` is forgotten, which bounds the fibers held. Rows of a key
    must come in order of t_idx between batches; within one they are sorted.
    """
    sos = kernels.butter_bandpass_sos(low, high, fs)
    schema = "fiber_id string, section string, ch int, t_idx bigint, v double"

    def step(key, pdf, held):
        if pdf is None:
            return None, None
        pdf = pdf.sort_values(["ch", "t_idx"], kind="stable").reset_index(drop=True)
        size = pdf.groupby("ch", sort=True).size()
        held = held or {}
        if set(size.index) - set(held):
            held = {c: np.zeros((len(sos), 2)) for c in size.index}
        v, start = pdf.v.to_numpy(float).copy(), size.cumsum() - size
        for n in size.unique():  # channels with as many samples go together
            chans = size.index[size == n]
            at = start[chans].to_numpy()[:, None] + np.arange(n)
            y, z = kernels.sosfilt(sos, v[at], np.stack([held[c] for c in chans], 1))
            v[at] = y
            held |= {c: z[:, i] for i, c in enumerate(chans)}
        return pdf.assign(v=v)[["fiber_id", "section", "ch", "t_idx", "v"]], held

    return _stateful(sig.select("fiber_id", "section", "ch", "t_idx", "v"), ["fiber_id", "section"], schema, step, GroupStateTimeout.ProcessingTimeTimeout, timeout_ms)


def detect_incidents_stream(det: DataFrame, free_flow: float) -> DataFrame:
    """Incidents opened, escalated and resolved, as they happen."""

    def step(key, pdf, held):
        a = incidents.Anomalies(free_flow, held)
        return incidents.anomaly_rows(key, pdf, a), a.dump()

    return _stateful(det.select("fiber_id", "direction", "ts_ns", "ch", "speed"), ["fiber_id", "direction"], incidents.EVENTS, step)


def track_vehicles_stream(det: DataFrame) -> DataFrame:
    def step(key, pdf, held):
        t = ordered.Tracker(int(key[1]), held)
        return ordered.track_rows(key, pdf, t), t.dump()

    return _stateful(det.select("fiber_id", "direction", "ts_ns", "ch", "speed"), ["fiber_id", "direction"], ordered.TRACKS, step)


def rolling_windows(df: DataFrame, key: str, size: int, step_n: int, timeout_ms: int = 60_000) -> DataFrame:
    """Count-based windows of ``size`` samples every ``step_n``; a key that falls silent gives its rest, marked partial.

    Input (key, t_idx, v) in order; output (key, window, t_idx, v, partial). At most a
    window of samples is held.
    """
    schema = f"{key} string, window bigint, t_idx bigint, v double, partial boolean"

    def frame(k, w, rows, partial):
        t, v = zip(*rows)
        return pd.DataFrame({key: k, "window": w, "t_idx": t, "v": v, "partial": partial})

    def step(k, pdf, held):
        held = held or {"rows": [], "window": 0}
        out = []
        if pdf is None:
            out = [frame(k[0], held["window"], held["rows"], True)] if held["rows"] else []
            return pd.concat(out) if out else None, None
        held["rows"] += list(pdf.sort_values("t_idx")[["t_idx", "v"]].itertuples(index=False, name=None))
        while len(held["rows"]) >= size:
            out.append(frame(k[0], held["window"], held["rows"][:size], False))
            held = {"rows": held["rows"][step_n:], "window": held["window"] + 1}
        return pd.concat(out) if out else None, held

    return _stateful(df.select(key, "t_idx", "v"), [key], schema, step, GroupStateTimeout.ProcessingTimeTimeout, timeout_ms)


def count_buffer(df: DataFrame, key: str, n: int, timeout_ms: int = 60_000) -> DataFrame:
    """Tumbling groups of n rows, the rest after a silence: windows with a step of their size."""
    return rolling_windows(df, key, n, n, timeout_ms)


def section_barrier_stream(windows: DataFrame, sections: dict[str, list[str]], timeout_ms: int = 60_000) -> DataFrame:
    """(fiber_id, window) as soon as all of the fiber's sections have shown it.

    A window that is not complete ``timeout_ms`` after its first section is given up.
    """

    def step(key, pdf, held):
        if pdf is None:
            return None, None
        now = time.time() * 1000
        held = {w: x for w, x in (held or {}).items() if now - x[0] <= timeout_ms}
        need, out = set(sections.get(key[0], [])), []
        for w, s in pdf[["window", "section"]].itertuples(index=False, name=None):
            held.setdefault(int(w), (now, set()))[1].add(s)
            if need and held[int(w)][1] >= need:
                out.append((key[0], int(w)))
                del held[int(w)]
        return pd.DataFrame(out, columns=["fiber_id", "window"]), held or None

    return _stateful(windows.select("fiber_id", "window", "section"), ["fiber_id"], "fiber_id string, window bigint", step, GroupStateTimeout.ProcessingTimeTimeout, timeout_ms)


def alert_stream(det: DataFrame, rules: DataFrame, assign: DataFrame, timeout_ms: int = 86_400_000) -> DataFrame:
    """Dispatched alerts of a stream: static rules, cooldown state by (rule, fiber, channel).

    A key that nothing fires for ``timeout_ms`` is forgotten; that must be longer than the
    longest cooldown.
    """
    fired = alerts.eval_detection_rules(det, rules, assign)
    schema = "rule_id string, fiber_id string, ch int, ts_ns bigint, speed double, detail string, cooldown_s int"

    def step(key, pdf, held):
        if pdf is None:
            return None, None
        pdf = pdf.sort_values(["ts_ns", "detail"], kind="stable")
        keep, last = alerts.fold_cooldown(pdf.ts_ns.tolist(), float(pdf.cooldown_s.iloc[0]), held)
        return pdf[keep], last

    return _stateful(fired, ["rule_id", "fiber_id", "ch"], schema, step, GroupStateTimeout.ProcessingTimeTimeout, timeout_ms)
