"""Stateful processors: windows, incidents and tracks with typed state, event-time timers and state that ends.

State lives in RocksDB (``use_rocksdb``) as typed maps and lists, so only what a batch
touches is written, and it can be read and evolved as tables. A key has one timer: when the
next incident resolves, the next track ends, or the key has been silent long enough. It fires
when the watermark has passed, though no further row of the key comes. Rows of a key
must come in order of time between micro-batches; within one they are sorted.

Chunked input gives the rows of the batch forms (``incidents.detect_incidents(clock=True)``,
``ordered.track_ends``) as far as the watermark has come.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators import detection, incidents, ordered
from .jobs import overwrite_batch

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """Processors need the RocksDB state store; must be set before the query starts."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


class _Timed(StatefulProcessor):
    """Rows of a key in order, then a timer for what the clock has to do next."""

    columns: list[str] = []

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.timer = handle.getValueState("timer", "at long")
        self.open(handle)

    def open(self, handle: StatefulProcessorHandle) -> None:
        raise NotImplementedError

    def load(self, key: tuple):
        raise NotImplementedError

    def save(self, held) -> None:
        raise NotImplementedError

    def detection(self, key: tuple, held, ns: int, ch: int, speed: float) -> list[tuple]:
        raise NotImplementedError

    def clock(self, key: tuple, held, ms: float) -> list[tuple]:
        raise NotImplementedError

    def due_ms(self, held) -> float | None:
        raise NotImplementedError

    def _rearm(self, held) -> None:
        due = self.due_ms(held)
        now = self.timer.get()[0] if self.timer.exists() else None
        at = None if due is None else math.floor(due) + 1  # the first whole millisecond at which it is over
        if at == now:
            return
        if now is not None:
            self.handle.deleteTimer(now)
            self.timer.clear()
        if at is not None:
            self.handle.registerTimer(at)
            self.timer.update((at,))

    def _frame(self, rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=self.columns)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held, out = self.load(key), []
        pdf = pd.concat(list(rows), ignore_index=True).sort_values(["ts_ns", "ch", "speed"], kind="stable")
        for ns, ch, speed in pdf[["ts_ns", "ch", "speed"]].itertuples(index=False):
            out += self.detection(key, held, int(ns), int(ch), float(speed))
        self.save(held)
        self._rearm(held)
        if out:
            yield self._frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.timer.clear()
        held = self.load(key)
        out = self.clock(key, held, timerValues.getCurrentWatermarkInMs())  # no row before it can come any more
        self.save(held)
        self._rearm(held)
        if out:
            yield self._frame(out)

    def close(self) -> None:
        pass


class Incidents(_Timed):
    """``incidents.Anomalies`` by (fiber, direction): points and open incidents as maps by channel."""

    columns = [x.split()[0] for x in incidents.EVENTS.split(", ")]

    def __init__(self, free_flow: float, silence_s: float = 3600.0):
        self.free, self.silence = free_flow, silence_s

    def open(self, handle: StatefulProcessorHandle) -> None:
        self.points = handle.getMapState("points", "ch int", "mean double, anomaly double, seen double, incident boolean, since double")
        self.incidents = handle.getMapState("incidents", "ch int", "severity string, kind string")
        self.now = handle.getValueState("now", "now double")

    def load(self, key):
        points = {k[0]: list(v) for k, v in self.points.iterator()} if self.now.exists() else {}
        open_ = {k[0]: {"severity": v[0], "kind": v[1]} for k, v in self.incidents.iterator()} if points else {}
        a = incidents.Anomalies(self.free, {"points": points, "open": open_, "now": self.now.get()[0] if points else None}, self.silence)
        a.before = {c: tuple(q) for c, q in points.items()}, {c: dict(o) for c, o in open_.items()}
        return a

    def save(self, a) -> None:
        points, open_ = a.before
        if a.now is None:  # silent: nothing of the key is kept
            self.points.clear()
            self.incidents.clear()
            self.now.clear()
            return
        now = a.points
        for c in points.keys() - now.keys():
            self.points.removeKey((c,))
        for c, q in now.items():
            if points.get(c) != tuple(q):
                self.points.updateValue((c,), tuple(q))
        for c in open_.keys() - a.open.keys():
            self.incidents.removeKey((c,))
        for c, o in a.open.items():
            if open_.get(c) != o:
                self.incidents.updateValue((c,), (o["severity"], o["kind"]))
        self.now.update((a.now,))

    def detection(self, key, a, ns, ch, speed):
        return [(key[0], int(key[1]), *e) for e in incidents.clocked_events(a, ns, ch, speed)]

    def clock(self, key, a, ms):
        return [(key[0], int(key[1]), *e) for e in incidents.clock_events(a, ms / 1e3)]

    def due_ms(self, a):
        return None if a.due() is None else a.due() * 1e3


class Tracks(_Timed):
    """``ordered.Tracker`` by (fiber, direction): its live tracks as a list."""

    columns = [x.split()[0] for x in ordered.TRACKS.split(", ")]
    fields = ("id", "x", "v", "px", "pv", "seen", "hits", "state")

    def open(self, handle: StatefulProcessorHandle) -> None:
        self.tracks = handle.getListState("tracks", "id long, x double, v double, px double, pv double, seen double, hits int, state string")
        self.clocked = handle.getValueState("clock", "count long, now double")

    def load(self, key):
        count, now = self.clocked.get() if self.clocked.exists() else (0, None)
        return ordered.Tracker(int(key[1]), {"tracks": [dict(zip(self.fields, t)) for t in self.tracks.get()], "count": count, "now": now})

    def save(self, tracker) -> None:
        live = tracker.tracks
        if live:
            self.tracks.put([tuple(t[f] for f in self.fields) for t in live])
        else:
            self.tracks.clear()
        self.clocked.update((tracker.count, tracker.now))

    def detection(self, key, tracker, ns, ch, speed):
        return ordered.timed_rows(key, tracker, ns, ch, speed)

    def clock(self, key, tracker, ms):
        return ordered.end_rows(key, tracker, ms)

    def due_ms(self, tracker):
        return tracker.due()


class Windows(StatefulProcessor):
    """Windows of channels x time by (fiber, section): blocks of samples as they come, until no window needs them.

    A window is out as soon as its last sample has come; the samples of a time must come in one
    micro-batch (a frame holds all its channels) and times in order. Blocks are written once and
    removed once; those of a key that falls silent go by their time to live.
    """

    def __init__(self, size: int, step: int, ttl_ms: int):
        self.size, self.step, self.ttl = size, step, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.blocks = handle.getMapState("blocks", "first long", "ch array<int>, t_idx array<bigint>, v array<double>", self.ttl)
        self.next = handle.getValueState("next", "window long", self.ttl)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        k = self.next.get()[0] if self.next.exists() else None
        held = {b[0]: pd.DataFrame(dict(zip(("ch", "t_idx", "v"), v))) for b, v in self.blocks.iterator()} if k is not None else {}
        new = pd.concat(list(rows), ignore_index=True)[["ch", "t_idx", "v"]]
        if k is None:  # the first whole window there is
            k = max(0, -(-int(new.t_idx.min()) // self.step))
        first, out = int(new.t_idx.min()), []
        fresh = held.keys() | set()
        held[first] = new if first not in held else pd.concat([held[first], new], ignore_index=True)
        top = int(new.t_idx.max())
        while top >= k * self.step + self.size - 1:
            start = k * self.step
            win = pd.concat([b[(b.t_idx >= start) & (b.t_idx < start + self.size)] for b in held.values()], ignore_index=True)
            if len(win):
                out.append(pd.DataFrame({"fiber_id": key[0], "section": key[1], "t_window": k, "ch": win.ch, "t": win.t_idx - start, "v": win.v}))
            k += 1
        for b, x in held.items():
            if int(x.t_idx.max()) < k * self.step:
                if b in fresh:
                    self.blocks.removeKey((b,))
            elif b == first:
                self.blocks.updateValue((b,), (x.ch.astype(int).tolist(), x.t_idx.astype(int).tolist(), x.v.astype(float).tolist()))
        self.next.update((k,))
        yield from out

    def close(self) -> None:
        pass


WINDOWS = "fiber_id string, section string, t_window long, ch int, t int, v double"


def windows_stream(sig: DataFrame, size: int = 312, step: int = 234, ttl_ms: int = 3_600_000) -> DataFrame:
    """Windows in time of a stream of samples (``WINDOWS``), as ``signals.time_windows`` gives them of a table."""
    rows = sig.select("fiber_id", "section", "ch", "t_idx", "v")
    return rows.groupBy("fiber_id", "section").transformWithStateInPandas(Windows(size, step, ttl_ms), WINDOWS, "Append", "ProcessingTime")


def detections_stream(sig: DataFrame, out: str, checkpoint: str, fs: float, gauge: float, corr: float, size: int = 312, hop: int = 234, trigger: dict | None = None, **how):
    """From samples to stored detections in one query: windows by state, then ``detection.detect_windows`` on each micro-batch.

    Each micro-batch replaces its own partition at ``out``, so replays store nothing twice.
    """
    store = overwrite_batch(out)

    def run(win: DataFrame, batch: int) -> None:
        store(detection.detect_windows(win, fs, gauge, corr, size=size, hop=hop, **how), batch)

    return windows_stream(sig, size, hop).writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def _run(det: DataFrame, processor: StatefulProcessor, schema: str, delay: str) -> DataFrame:
    rows = det.filter("speed is not null").select("fiber_id", "direction", "ts", "ts_ns", "ch", "speed").withWatermark("ts", delay)
    return rows.groupBy("fiber_id", "direction").transformWithStateInPandas(processor, schema, "Append", "EventTime")


def incidents_stream(det: DataFrame, free_flow: float, delay: str = "10 seconds", silence_s: float = 3600.0) -> DataFrame:
    """Incidents detected, escalated, resolved and expired as they happen (``incidents.EVENTS``); ``ts`` is the event time."""
    return _run(det, Incidents(free_flow, silence_s), incidents.EVENTS, delay)


def tracks_stream(det: DataFrame, delay: str = "10 seconds") -> DataFrame:
    """Each detection with its track, and a row of state ``ended`` when a track's time is over (``ordered.TRACKS``)."""
    return _run(det, Tracks(), ordered.TRACKS, delay)
