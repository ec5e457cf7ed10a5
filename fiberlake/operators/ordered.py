"""Ordered folds by key: means over time, delays, smoothing, tracks, release times."""

from __future__ import annotations

import math
from collections.abc import Callable
from heapq import heapify, heappop, heappush

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F



def fold_sorted(df: DataFrame, key: list[str], order: list[str], fold, schema: str) -> DataFrame:
    """One pass over rows that are sorted by key and order within each task.

    ``fold`` takes the batches of a task as an iterator and keeps what it needs between
    them, so memory follows its state and not the number of a key's rows, and keys cost
    no call each.
    """
    return df.repartition(*key).sortWithinPartitions(*key, *order).mapInArrow(fold, schema)


def _schema(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)


def ema(df: DataFrame, key: list[str], order: str, alpha: float, init: float | None = None, value: str = "speed") -> DataFrame:
    """``ema`` at every event: alpha * x + (1 - alpha) * before, from ``init`` or the first value; a null keeps it.

    A fold in order of (order, value) within a key.
    """

    def fold(batches):
        now, m = None, None
        for batch in batches:
            out = []
            for k, x in zip(zip(*(batch.column(c).to_pylist() for c in key)), batch.column(value).to_pylist()):
                if k != now:
                    now, m = k, init
                if x is not None and x == x:
                    m = x if m is None else alpha * x + (1 - alpha) * m
                out.append(m)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.float64())], names=[*batch.schema.names, "ema"])

    return fold_sorted(df, key, [order, value], fold, _schema(df) + ", ema double")


def trailing(df: DataFrame, key: list[str], order: list[str], cell: Column, n: int, new: Callable, block: int = 20_000) -> DataFrame:
    """``df`` with the columns of ``new(frame, rank)``, whose frame is each row and the n - 1 before it in its key.

    A key's rows are not one task. ``cell`` grows with the order (a range of time): rows are
    numbered within cells and, by running sums of the cells' counts, within the key. Blocks
    of ``block`` rows then each get the last n - 1 rows of the block before, as a halo that
    goes again after the frames are computed. ``rank`` counts a key's rows from 0. Rows with
    equal keys and order follow each other in any order; nulls are lowest and keys of their own.
    """
    block = max(block, n)
    rows = df.withColumn("_cell", cell)
    before = F.sum("_m").over(W.partitionBy(*key).orderBy("_cell").rowsBetween(W.unboundedPreceding, -1))
    cells = rows.groupBy(*key, "_cell").agg(F.count(F.lit(1)).alias("_m")).withColumn("_before", F.coalesce(before, F.lit(0)))
    names = [*key, "_cell"]
    cells = cells.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(names)], "_before")
    place = F.row_number().over(W.partitionBy(*names).orderBy(*order)) - 1
    same = [F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(names)]
    rows = rows.withColumn("_place", place).join(cells, same).withColumn("_rank", F.col("_before") + F.col("_place"))
    at = lambda by, halo: F.struct((F.floor(F.col("_rank") / block) + by).alias("block"), F.lit(halo).alias("halo"))
    near = F.col("_rank") % block >= block - (n - 1)
    rows = rows.withColumn("_in", F.explode(F.when(near, F.array(at(0, False), at(1, True))).otherwise(F.array(at(0, False)))))
    rows = rows.withColumn("_block", F.col("_in.block")).withColumn("_halo", F.col("_in.halo"))
    frame = W.partitionBy(*key, "_block").orderBy("_rank").rowsBetween(-(n - 1), 0)
    made = new(frame, F.col("_rank"))
    own = [c for c in df.columns if c not in made]
    return rows.select(*[F.col(f"`{c}`") for c in own], *[c.alias(name) for name, c in made.items()], "_halo").filter("not _halo").drop("_halo")


def delay_estimate(df: DataFrame, n: int = 50, margin_ms: float = 15_000.0, by: tuple[str, ...] = ("fiber_id",), cell_ms: int = 600_000) -> DataFrame:
    """``delay_ms``: the 90th percentile (index int(0.9 n)) of the last n delays plus a margin; negative delays do not count."""
    rows = df.withColumn("_d", F.col("arrival_ms") - F.col("ts_ms")).filter("_d >= 0")

    def new(frame, _):
        s = F.sort_array(F.collect_list("_d").over(frame))
        k = F.least(F.floor(F.size(s) * 0.9), F.size(s) - 1).cast("int")
        return {"delay_ms": F.get(s, k) + margin_ms}

    return trailing(rows, list(by), ["arrival_ms", "ts_ms"], F.floor(F.col("arrival_ms") / cell_ms), n, new).drop("_d")


def release_schedule(det: DataFrame, batch_ms: int = 100) -> DataFrame:
    """When each detection is shown: its time plus the estimated delay, in batches; overdue ones on arrival."""
    rows = delay_estimate(det)
    at = F.greatest(F.col("ts_ms") + F.col("delay_ms"), F.col("arrival_ms").cast("double"))
    return rows.withColumn("release_ms", (F.ceil(at / batch_ms) * batch_ms).cast("bigint"))


def smooth_counts(df: DataFrame, key: list[str], order: str, n: int = 5, cell: Column | None = None) -> DataFrame:
    """Middle element of the last n sorted counts; with a ``cell`` (see ``trailing``) a key is not one task."""

    def new(frame, _=None):
        s = F.sort_array(F.collect_list("vehicle_count").over(frame))
        return {"smooth": F.get(s, F.floor(F.size(s) / 2).cast("int"))}

    if cell is not None:
        return trailing(df, key, [order], cell, n, new)
    return df.withColumns(new(W.partitionBy(*key).orderBy(order).rowsBetween(-(n - 1), 0)))


# tracks -----------------------------------------------------------------------
Q_POS, Q_VEL, R_POS, R_VEL, P_POS, P_VEL = 0.001, 0.00001, 64.0, 0.0004, 36.0, 0.0005
GATE_SD, GATE_CH, COAST_MS, DEAD_MS, METRES = 3.0, 10.0, 6_000, 10_000, 5.0
TRACKS = "fiber_id string, direction int, ts_ns bigint, ch int, track bigint, position double, velocity double, hits int, state string"


_TRACK_TYPES = (pa.string(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.float64(), pa.float64(), pa.int32(), pa.string(), pa.int64())


_FIELDS = ("id", "x", "v", "px", "pv", "seen", "hits", "state")
#: Places in a track's list: the fields; the time they are of, with the sums at that time; the cell.
_ID, _X, _V, _PX, _PV, _SEEN, _HITS, _STATE, _AT, _S2, _S3, _CELL = range(12)
CELL = 64.0


def _end(t: list) -> float:
    """The last moment of a track without a further detection (ms)."""
    return t[_SEEN] + (1_000 if t[_STATE] == "tentative" else DEAD_MS)


class Tracker:
    """Tracks of one (fiber, direction): constant-velocity Kalman filters, nearest in deviations within a gate.

    A track is confirmed by its second detection, coasts after 6 s without one and is
    gone after 10 s; one that was never confirmed is gone after a second.

    All tracks are predicted at every detection. Between two detections of its own a track
    moves evenly and its variances depend only on sums over the sequence (of the steps' squares,
    and of those times the time before them), so it is predicted when it is looked at. Tracks lie
    in cells of channels; a detection looks at the cells that a gate can reach. All tracks are
    brought to the present, and those bounds anew, after twice as many detections as there are tracks.
    """

    def __init__(self, direction: int, state: dict | None = None):
        s = state or {}
        self.sign = 1 if direction == 0 else -1
        self.count: int = s.get("count", 0)
        self.now: float | None = s.get("now")
        self._live = {t["id"]: [*(t[f] for f in _FIELDS), self.now, 0.0, 0.0, 0] for t in s.get("tracks", [])}
        self._ends = [(_end(t), i) for i, t in self._live.items()]
        heapify(self._ends)
        self._base, self._s2, self._s3 = self.now, 0.0, 0.0
        self._rebase()

    @property
    def tracks(self) -> list[dict]:
        """Live tracks as of the last detection, oldest first."""
        return [self._dict(t) for _, t in sorted(self._live.items())]

    def dump(self) -> dict:
        return {"tracks": self.tracks, "count": self.count, "now": self.now}

    def _predict(self, t: list) -> None:
        """Brings a track to the present."""
        d, s2 = self.now - t[_AT], self._s2 - t[_S2]
        t[_X] += t[_V] * d
        t[_PX] += t[_PV] * s2 + Q_VEL * (self._s3 - t[_S3] - (t[_AT] - self._base) * s2) + Q_POS * d
        t[_PV] += Q_VEL * d
        t[_AT], t[_S2], t[_S3] = self.now, self._s2, self._s3

    def _dict(self, t: list) -> dict:
        t = list(t)
        self._predict(t)
        if t[_STATE] == "confirmed" and self.now - t[_SEEN] > COAST_MS:
            t[_STATE] = "coasting"
        return dict(zip(_FIELDS, t))

    def _rebase(self) -> None:
        """Brings all tracks to the present; the sums start anew."""
        self._cells: dict[int, dict[int, list]] = {}
        self._px, self._pv, self._fast = R_POS, P_VEL, 0.0  # no track has more, as of the base; a detection leaves less than these
        for i, t in self._live.items():
            self._predict(t)
            t[_S2] = t[_S3] = 0.0
            self._px, self._pv, self._fast = max(self._px, t[_PX]), max(self._pv, t[_PV]), max(self._fast, abs(t[_V]))
            t[_CELL] = int(t[_X] // CELL)
            self._cells.setdefault(t[_CELL], {})[i] = t
        self._base, self._s2, self._s3 = self.now, 0.0, 0.0
        self._left = max(64, 2 * len(self._live))

    def _gone(self, t: list) -> None:
        del self._live[t[_ID]]
        cell = self._cells[t[_CELL]]
        del cell[t[_ID]]
        if not cell:
            del self._cells[t[_CELL]]

    def due(self) -> float | None:
        """When the first track ends, if no detection comes before (ms)."""
        ends = self._ends
        while ends:
            t = self._live.get(ends[0][1])
            if t is not None and _end(t) == ends[0][0]:
                return ends[0][0]
            heappop(ends)
        return None

    def advance(self, now_ms: float):
        """(ms, track) of the tracks that have ended by ``now_ms``, in order; they are gone."""
        while (at := self.due()) is not None and at < now_ms:
            t = self._live[heappop(self._ends)[1]]
            self._gone(t)
            yield at, self._dict(t) | {"state": "ended"}

    def step(self, now_ms: float, ch: float, speed: float) -> dict:
        if self.now is None:
            self.now = self._base = now_ms
        elif now_ms > self.now:
            dt = now_ms - self.now
            self._s2 += dt * dt
            self._s3 += (self.now - self._base) * dt * dt
            self.now = now_ms
        ends, live, cells = self._ends, self._live, self._cells
        while ends and ends[0][0] < now_ms:
            end, i = heappop(ends)
            t = live.get(i)
            if t is not None and _end(t) == end:
                self._gone(t)
        now, base, s2, s3 = self.now, self._base, self._s2, self._s3
        gate = GATE_SD * math.sqrt(self._px + self._pv * s2 + Q_VEL * s3 + Q_POS * (now - base)) + 1e-6
        reach = gate + self._fast * (now - base)
        lo, hi = int((ch - reach) // CELL), int((ch + reach) // CELL)
        best, at = None, math.inf
        for look in (cells.values() if hi - lo >= len(cells) else [cells[c] for c in range(lo, hi + 1) if c in cells]):
            for t in look.values():
                d = now - t[_AT]
                off = abs(ch - (t[_X] + t[_V] * d))
                if off < gate:
                    k = s2 - t[_S2]
                    sd = math.sqrt(t[_PX] + t[_PV] * k + Q_VEL * (s3 - t[_S3] - (t[_AT] - base) * k) + Q_POS * d)
                    d = off / max(sd, 1.0)
                    if d < GATE_SD and off < max(GATE_SD * sd, GATE_CH) and (d < at or d == at and t[_ID] < best[_ID]):
                        best, at = t, d
        v = self.sign * speed / 3.6 / 1000 / METRES
        if best is None:
            self.count += 1
            best = live[self.count] = [self.count, float(ch), v, P_POS, P_VEL, now_ms, 1, "tentative", now, s2, s3, int(ch // CELL)]
            cells.setdefault(best[_CELL], {})[self.count] = best
        else:
            self._predict(best)
            k = best[_PX] / (best[_PX] + R_POS)
            best[_X] += k * (ch - best[_X])
            best[_PX] *= 1 - k
            k = best[_PV] / (best[_PV] + R_VEL)
            best[_V] += k * (v - best[_V])
            best[_PV] *= 1 - k
            best[_SEEN], best[_HITS], best[_STATE] = now_ms, best[_HITS] + 1, "confirmed"
            cell = int(best[_X] // CELL)
            if cell != best[_CELL]:
                self._gone(best)
                best[_CELL] = cell
                live[best[_ID]] = cells.setdefault(cell, {})[best[_ID]] = best
        heappush(ends, (_end(best), best[_ID]))
        self._fast = max(self._fast, abs(best[_V]))
        self._left -= 1
        if self._left <= 0:
            self._rebase()
        return dict(zip(_FIELDS, best))


def track_rows(key: tuple, pdf: pd.DataFrame, tracker: Tracker) -> pd.DataFrame:
    out = []
    for ns, ch, speed in pdf.sort_values(["ts_ns", "ch"], kind="stable")[["ts_ns", "ch", "speed"]].itertuples(index=False):
        t = tracker.step(ns / 1e6, float(ch), float(speed))
        out.append((key[0], int(key[1]), int(ns), int(ch), t["id"], t["x"], t["v"], t["hits"], t["state"]))
    return pd.DataFrame(out, columns=[x.split()[0] for x in TRACKS.split(", ")])


def _track_row(key: tuple, ns: int, ch: int, t: dict) -> tuple:
    return key[0], int(key[1]), ns, ch, t["id"], t["x"], t["v"], t["hits"], t["state"]


def end_rows(key: tuple, tracker: Tracker, now_ms: float) -> list[tuple]:
    """Rows as ``TRACKS`` of the tracks that have ended by ``now_ms``, at the channel they were last at."""
    return [_track_row(key, round(at) * 1_000_000, round(t["x"]), t) for at, t in tracker.advance(now_ms)]


def timed_rows(key: tuple, tracker: Tracker, ns: int, ch: int, speed: float) -> list[tuple]:
    """Rows of a detection and, before it, of the tracks that had ended."""
    out = end_rows(key, tracker, ns / 1e6)
    return [*out, _track_row(key, int(ns), int(ch), tracker.step(ns / 1e6, float(ch), float(speed)))]


def track_ends(det: DataFrame) -> DataFrame:
    """``track_vehicles`` with a row of state ``ended`` for each track, when its time is over.

    One pass over a fiber and direction; as the stream with timers gives it.
    """
    names = [x.split()[0] for x in TRACKS.split(", ")]

    def fold(batches):
        now, tracker = None, None
        for batch in batches:
            out = []
            for fiber, direction, ns, ch, speed in zip(*(c.to_pylist() for c in batch.columns)):
                if (fiber, direction) != now:
                    out += end_rows(now, tracker, math.inf) if tracker else []
                    now, tracker = (fiber, direction), Tracker(int(direction))
                out += timed_rows(now, tracker, ns, ch, speed)
            yield _track_batch(out, names)
        if tracker:
            yield _track_batch(end_rows(now, tracker, math.inf), names)

    rows = det.filter("speed is not null").select("fiber_id", "direction", "ts_ns", "ch", "speed")
    return fold_sorted(rows, ["fiber_id", "direction"], ["ts_ns", "ch", "speed"], fold, TRACKS)


def _track_batch(out: list[tuple], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 9, _TRACK_TYPES)], names=names)


def track_vehicles(det: DataFrame) -> DataFrame:
    """Batch form: each detection with the track it belongs to.

    After a gap longer than a track lives nothing is left of what was before. Such gaps
    cut a fiber and direction into sessions that are folded in parallel; tracks are
    numbered on from one session to the next.
    """
    k = ["fiber_id", "direction"]
    rows = det.filter("speed is not null").select(*k, "ts_ns", "ch", "speed")
    w = W.partitionBy(*k).orderBy("ts_ns")
    gap = F.coalesce(F.col("ts_ns") - F.lag("ts_ns").over(w) > DEAD_MS * 1_000_000, F.lit(False)).cast("long")
    rows = rows.withColumn("_gap", gap).withColumn("_session", F.sum("_gap").over(w.rowsBetween(W.unboundedPreceding, W.currentRow))).drop("_gap")
    names = [x.split()[0] for x in TRACKS.split(", ")]

    def fold(batches):
        now, tracker = None, None
        for batch in batches:
            out = []
            for fiber, direction, ns, ch, speed, session in zip(*(c.to_pylist() for c in batch.columns)):
                if (fiber, direction, session) != now:
                    now, tracker = (fiber, direction, session), Tracker(int(direction))
                t = tracker.step(ns / 1e6, float(ch), float(speed))
                out.append((fiber, int(direction), ns, ch, t["id"], t["x"], t["v"], t["hits"], t["state"], session))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 10, _TRACK_TYPES)], names=[*names, "_session"])

    tracks = fold_sorted(rows, [*k, "_session"], ["ts_ns", "ch", "speed"], fold, TRACKS + ", _session long")
    own = tracks.groupBy(*k, "_session").agg(F.max("track").alias("_n"))
    before = W.partitionBy(*k).orderBy("_session").rowsBetween(W.unboundedPreceding, -1)
    own = own.select(*k, "_session", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return tracks.join(own, [*k, "_session"]).withColumn("track", F.col("track") + F.col("_before")).select(*names)


def section_barrier(windows: DataFrame, cfg: DataFrame) -> DataFrame:
    """(fiber_id, window) whose every configured section is there; sections that are not configured do not count."""
    cfg = cfg.select("fiber_id", "section").distinct()
    need = cfg.groupBy("fiber_id").agg(F.count("section").alias("need"))
    got = windows.join(F.broadcast(cfg), ["fiber_id", "section"]).groupBy("fiber_id", "window").agg(F.countDistinct("section").alias("got"))
    return got.join(F.broadcast(need), "fiber_id").filter("got = need").select("fiber_id", "window")
