"""Incidents: snapshots, calendar, workflow, detection and recovery."""

from __future__ import annotations

import math
from heapq import heapify, heappop, heappush

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scalars as S
from .ordered import fold_sorted
from .rollups import latest


def latest_incidents(versions: DataFrame, ties: list[str] | None = None) -> DataFrame:
    return latest(versions, ["incident_id"], "updated_at", ties)


def incident_by_id(versions: DataFrame, incident: str, ties: list[str] | None = None) -> DataFrame:
    return latest(versions.filter(F.col("incident_id") == incident), ["incident_id"], "updated_at", ties)


def incident_window(inc: DataFrame, det: DataFrame, around: int = 50, seconds: int = 60) -> DataFrame:
    """Detections of the same fiber and direction within so many channels and seconds of each incident.

    An equi-join on (fiber, direction, cell of time, cell of channels). Cells are half as
    long and wide as the window, so an incident lies in up to nine and, where detections are
    evenly spread, 2.25 rows meet for each that is within.
    """
    long, wide = seconds * 1_000_000, max(1, around)
    cells = lambda a, b, n: F.explode(F.sequence(F.floor(a / n), F.floor(b / n)))
    centre = F.floor((F.col("channel_start") + F.col("channel_end")) / 2)
    i = inc.select("incident_id", "fiber_id", "direction", F.unix_micros("timestamp").alias("i_us"), F.greatest(F.lit(0), centre - around).alias("lo"), (centre + around).alias("hi"))
    i = i.filter("lo <= hi").withColumn("t_cell", cells(F.col("i_us") - long, F.col("i_us") + long, long)).withColumn("c_cell", cells(F.col("lo"), F.col("hi"), wide))
    d = det.withColumn("d_us", F.unix_micros("ts")).withColumn("t_cell", F.floor(F.col("d_us") / long)).withColumn("c_cell", F.floor(F.col("ch") / wide))
    return d.join(i, ["fiber_id", "direction", "t_cell", "c_cell"]).filter(F.col("ch").between(F.col("lo"), F.col("hi")) & (F.abs(F.col("d_us") - F.col("i_us")) <= long)).drop("t_cell", "c_cell", "lo", "hi")


def incident_snapshot(inc: DataFrame, det: DataFrame, norm: bool = False, seconds: int = 60) -> DataFrame:
    """120 points a second apart around each incident, null where nothing passed.

    The window starts at the whole second. ``norm`` gives flow in vehicles per hour over
    +-30 channels instead of the second's count over +-50. Incidents of one fiber, direction,
    middle channel and time share a window, which is computed once; an incident stays one row,
    with its window's seconds as a map of at most 121, until the end.
    """
    around = 30 if norm else 50
    centre = F.floor((F.col("channel_start") + F.col("channel_end")) / 2)
    inc = inc.select("incident_id", F.struct("fiber_id", "direction", "timestamp", centre.alias("centre")).alias("_w"))
    shared = inc.select("_w").distinct().select(F.col("_w").alias("incident_id"), "_w.fiber_id", "_w.direction", "_w.timestamp", F.col("_w.centre").alias("channel_start"), F.col("_w.centre").alias("channel_end"))
    rows = incident_window(shared, det, around, seconds)
    agg = rows.groupBy("incident_id", F.floor(F.col("d_us") / 1_000_000).alias("sec")).agg(F.bround(F.avg(F.abs("speed"))).alias("speed"), F.sum("vehicle_count").alias("n"))
    flow = F.bround(F.col("n") * 3600 / (2 * around + 1)) if norm else F.col("n").cast("double")
    occ = S.occupancy(F.col("speed"), flow) if norm else S.occupancy(F.col("speed"), flow, "snapshot")
    value = F.struct(F.col("speed").alias("speed"), flow.alias("flow"), occ.alias("occupancy"))
    held = agg.groupBy(F.col("incident_id").alias("_w")).agg(F.map_from_entries(F.collect_list(F.struct("sec", value.alias("v")))).alias("seconds"))
    out = inc.join(held, "_w", "left")
    start = F.floor(F.unix_micros("_w.timestamp") / 1_000_000) - seconds
    out = out.select("incident_id", "seconds", F.explode(F.sequence(start, start + 2 * seconds - 1)).alias("sec"))
    at = F.try_element_at("seconds", F.col("sec"))
    return out.select("incident_id", (F.col("sec") * 1000).alias("time_ms"), *[at[c].alias(c) for c in ("speed", "flow", "occupancy")])


def incident_calendar(inc: DataFrame, month: str | None = None) -> DataFrame:
    if month:
        a, b = S.month_bounds(month)
        inc = inc.filter((F.col("timestamp") >= a) & (F.col("timestamp") < b))
    return inc.groupBy(F.to_date("timestamp").cast("string").alias("day")).agg(F.count(F.lit(1)).alias("n"))


def incident_breakdown(inc: DataFrame) -> DataFrame:
    return inc.groupBy("incident_type", "severity").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "incident_type", "severity")


def incident_changes(prev: DataFrame, cur: DataFrame) -> DataFrame:
    """(incident_id, fiber_id, direction, change): new ones, and known ones that are no longer active."""
    new = cur.join(prev.select("incident_id"), "incident_id", "leftanti").select("incident_id", "fiber_id", "direction", F.lit("new").alias("change"))
    gone = prev.join(cur.select("incident_id"), "incident_id", "leftanti").select("incident_id", "fiber_id", "direction", F.lit("resolved").alias("change"))
    return new.unionByName(gone)


def current_status(inc: DataFrame, actions: DataFrame) -> DataFrame:
    """Workflow status: the last action's, else active."""
    last = actions.groupBy("incident_id").agg(F.max_by("to_status", "performed_at").alias("to_status"))
    return inc.select("incident_id").join(last, "incident_id", "left").select("incident_id", F.coalesce("to_status", F.lit("active")).alias("workflow_status"))


#: Transitions that the workflow allows.
ALLOWED = [("active", "acknowledged"), ("active", "investigating"), ("active", "resolved"), ("acknowledged", "investigating"), ("acknowledged", "resolved"), ("investigating", "resolved"), ("resolved", "active")]


def check_transitions(actions: DataFrame, allowed: list[tuple[str, str]] | None = None) -> DataFrame:
    """Actions with ``valid``: the pair is allowed and starts where the previous one ended."""
    spark = actions.sparkSession
    ok = spark.createDataFrame(allowed or ALLOWED, "from_status string, to_status string").withColumn("ok", F.lit(True))
    prev = F.lag("to_status", 1, "active").over(W.partitionBy("incident_id").orderBy("performed_at"))
    rows = actions.withColumn("_prev", prev).join(F.broadcast(ok), ["from_status", "to_status"], "left")
    return rows.withColumn("valid", F.coalesce("ok", F.lit(False)) & (F.col("from_status") == F.col("_prev"))).drop("_prev", "ok")


# speed anomalies -------------------------------------------------------------
STEP, ALPHA, DROP, ANOMALY_S, RECOVER, RECOVER_S, SPACING, QUIET_S = 30, 0.3, 40.0, 8.0, 75.0, 20.0, 120, 10.0


class Anomalies:
    """State of one (fiber, direction): exponential means at points every 30 channels.

    The tick is the time between consecutive events, at most a second. A point whose
    mean has dropped by 40 % of free flow for 8 s opens an incident unless an open one
    is within 120 channels; a mean of at least 75 % held for 20 s closes it. A drop that
    deepens raises the severity.

    A detection changes its own point; the others' seconds of anomaly run evenly with the
    sum of the ticks until a moment that is known beforehand: when they fall quiet, reach
    8 s, or have recovered for 20 s. Those moments wait in heaps, so a detection costs no
    look at other points, however many there are. Times are kept as whole microseconds.

    With a clock (``advance``) an incident is closed as soon as its 20 s are over, without
    a further detection, and a sequence that is silent for ``silence_s`` ends: its open
    incidents expire and its state goes.
    """

    def __init__(self, free_flow: float, state: dict | None = None, silence_s: float = 3600.0):
        s = state or {}
        self.free, self.silence = free_flow, silence_s
        self.open: dict[int, dict] = s.get("open", {})
        self._us: int | None = None if s.get("now") is None else _us(s["now"])
        self._sum = 0  # of the ticks
        self._points: dict[int, list] = {}  # channel: see the places below
        self._quiet: list[tuple[int, int]] = []  # (last seen, channel)
        self._full: list[tuple[int, int]] = []  # (sum of the ticks at 8 s of anomaly, channel)
        self._well: list[tuple[int, int]] = []  # (recovering since, channel)
        self._again: set[int] = set()  # points to look at with the next detection
        for c, (mean, anomaly, seen, incident, since) in s.get("points", {}).items():
            p = self._points[c] = [mean, _us(anomaly), 0, 0, _us(seen), incident, None if since is None else _us(since), None]
            silent = self._us is not None and self._us - p[_SEEN] > QUIET_US
            self._run(c, p, -1 if silent else 1 if self.drop(mean) >= DROP else -2)
            if since is not None:
                heappush(self._well, (p[_SINCE], c))
            self._again.add(c)

    @property
    def now(self) -> float | None:
        return None if self._us is None else self._us / 1e6

    @property
    def points(self) -> dict[int, list]:
        """channel: [mean, seconds of anomaly, last seen, incident, recovering since], as of now."""
        return {c: [p[_MEAN], self._anomaly(p) / 1e6, p[_SEEN] / 1e6, p[_OPEN], None if p[_SINCE] is None else p[_SINCE] / 1e6] for c, p in self._points.items()}

    def dump(self) -> dict:
        return {"points": self.points, "open": self.open, "now": self.now}

    def drop(self, mean: float) -> float:
        return max(0.0, (1 - mean / self.free) * 100) if self.free > 0 else 0.0

    def _anomaly(self, p: list) -> int:
        """Microseconds of anomaly by now."""
        return max(0, p[_ANOMALY] + p[_SLOPE] * (self._sum - p[_FROM]))

    def _run(self, c: int, p: list, slope: int) -> None:
        """From now on the point's anomaly grows by ``slope`` times the ticks."""
        p[_ANOMALY], p[_FROM], p[_SLOPE] = self._anomaly(p), self._sum, slope
        full = self._sum + ANOMALY_US - p[_ANOMALY] if slope > 0 else None
        if full is not None and full != p[_FULL]:
            heappush(self._full, (full, c))
        p[_FULL] = full
        if slope != -1 and (slope > 0 or p[_ANOMALY] > 0):
            heappush(self._quiet, (p[_SEEN], c))

    def step(self, now: float, ch: int, speed: float):
        """Events (kind, channel, severity, type, mean, drop) after one detection."""
        us = _us(now)
        tick = 0 if self._us is None else min(1_000_000, max(0, us - self._us))
        self._us = us if self._us is None else max(self._us, us)
        at = math.floor(ch / STEP + 0.5) * STEP
        p = self._points.get(at)
        if p is None:
            p = self._points[at] = [self.free, 0, self._sum, 0, us, False, None, None]
        p[_MEAN], p[_SEEN] = ALPHA * speed + (1 - ALPHA) * p[_MEAN], us
        self._run(at, p, 1 if self.drop(p[_MEAN]) >= DROP else -2)
        if tick:
            quiet = self._quiet
            while quiet and us - quiet[0][0] > QUIET_US:
                seen, c = heappop(quiet)
                q = self._points[c]
                if q[_SEEN] == seen and q[_SLOPE] != -1:
                    self._run(c, q, -1)
        self._sum += tick
        look = [at]
        if self._again:
            look, self._again = [at, *self._again], set()
        while self._full and self._full[0][0] <= self._sum:
            look.append(heappop(self._full)[1])
        while self._well and us - self._well[0][0] >= RECOVER_US:
            look.append(heappop(self._well)[1])
        heapify(look)
        last = None
        while look:
            c = heappop(look)
            if c == last:
                continue
            last = c
            e = self._look(c, us)
            if e is None:
                continue
            yield e
            if e[0] == "resolved":  # points after it in order are looked at in this step, those before it in the next
                for o in self._near(c):
                    if o > c:
                        heappush(look, o)
                    else:
                        self._again.add(o)

    def _near(self, c: int) -> list[int]:
        return [o for k in range(STEP, SPACING, STEP) for o in (c - k, c + k) if o in self._points]

    def _look(self, c: int, us: int):
        """The event of one point, if any."""
        q = self._points[c]
        mean, drop = q[_MEAN], self.drop(q[_MEAN])
        if not q[_OPEN]:
            if drop < DROP or self._anomaly(q) < ANOMALY_US or any(o in self.open for o in range(c - SPACING + STEP, c + SPACING, STEP)):
                return None
            kind = "accident" if mean < 5 else "congestion" if drop > 70 else "slowdown" if drop > 50 else "anomaly"
            severity = "critical" if drop > 80 or mean < 5 else "high" if drop > 60 else "medium" if drop > 50 else "low"
            q[_OPEN], q[_SINCE] = True, None
            self.open[c] = {"severity": severity, "kind": kind}
            return "detected", c, severity, kind, mean, drop
        if mean >= self.free * RECOVER / 100:
            if q[_SINCE] is None:
                q[_SINCE] = us
                heappush(self._well, (us, c))
            elif us - q[_SINCE] >= RECOVER_US:
                return self._closed(c, "resolved")
            return None
        q[_SINCE] = None
        o = self.open[c]
        up = "critical" if drop > 80 and o["severity"] != "critical" else "high" if drop > 60 and o["severity"] in ("low", "medium") else None
        if up:
            o["severity"] = up
            return "escalated", c, up, o["kind"], mean, drop
        return None

    def _closed(self, c: int, event: str) -> tuple:
        q, o = self._points[c], self.open.pop(c)
        q[_ANOMALY], q[_FROM], q[_OPEN], q[_SINCE] = 0, self._sum, False, None
        return event, c, o["severity"], o["kind"], q[_MEAN], self.drop(q[_MEAN])

    def due(self) -> float | None:
        """When the clock has something to do, if no detection comes before."""
        if self._us is None:
            return None
        since = (self._points[c][_SINCE] for c in self.open)
        return min([self.now + self.silence, *(x / 1e6 + RECOVER_S for x in since if x is not None)])

    def advance(self, now: float):
        """Events (seconds, event) of the clock up to ``now``, in order."""
        while (at := self.due()) is not None and at <= now:
            ended = at >= self.now + self.silence
            for c in sorted(self.open):
                since = self._points[c][_SINCE]
                if ended or (since is not None and since / 1e6 + RECOVER_S <= at):
                    yield at, self._closed(c, "expired" if ended else "resolved")
                    self._again.update(self._near(c))
            if ended:
                self.__init__(self.free, None, self.silence)


#: Places in a point's list; ANOMALY is as of FROM, a sum of ticks, and changes by SLOPE from there.
_MEAN, _ANOMALY, _FROM, _SLOPE, _SEEN, _OPEN, _SINCE, _FULL = range(8)
QUIET_US, ANOMALY_US, RECOVER_US = (int(x * 1_000_000) for x in (QUIET_S, ANOMALY_S, RECOVER_S))


def _us(seconds: float) -> int:
    return round(seconds * 1e6)


EVENTS = "fiber_id string, direction int, ts_ns bigint, ch int, event string, severity string, incident_type string, ema double, drop_pct double"


def _event(e: tuple) -> tuple:
    kind, c, severity, what, mean, drop = e
    return c, kind, severity, what, mean, drop


def _events(a: Anomalies, ns: int, ch: int, speed: float):
    return [_event(e) for e in a.step(ns / 1e9, int(ch), float(speed))]


def clock_events(a: Anomalies, now: float) -> list[tuple]:
    """(ts_ns, ..) of what the clock does up to ``now`` seconds."""
    return [(round(at * 1000) * 1_000_000, *_event(e)) for at, e in a.advance(now)]


def clocked_events(a: Anomalies, ns: int, ch: int, speed: float) -> list[tuple]:
    """(ts_ns, ..) of a detection and, before it, of the clock."""
    return clock_events(a, ns / 1e9) + [(ns, *e) for e in _events(a, ns, ch, speed)]


def anomaly_rows(key: tuple, pdf: pd.DataFrame, a: Anomalies) -> pd.DataFrame:
    out = []
    for t, ch, v in pdf.sort_values(["ts_ns", "ch"], kind="stable")[["ts_ns", "ch", "speed"]].itertuples(index=False):
        out += [(key[0], int(key[1]), int(t), *e) for e in _events(a, int(t), ch, v)]
    return pd.DataFrame(out, columns=[x.split()[0] for x in EVENTS.split(", ")])


_EVENT_TYPES = (pa.string(), pa.int32(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())


def detect_incidents(det: DataFrame, free_flow: float, clock: bool = False, silence_s: float = 3600.0) -> DataFrame:
    """Batch form: incidents opened, escalated and resolved, by (fiber, direction).

    A fiber and direction is one sequence, whose state lasts; it is read as a stream in
    order, so memory follows its points and not its detections. With ``clock`` incidents
    resolve and expire by time, as in ``streaming.processors``, to the end of each sequence.
    """
    rows = det.filter("speed is not null").select("fiber_id", "direction", "ts_ns", "ch", "speed")
    names = [x.split()[0] for x in EVENTS.split(", ")]

    def fold(batches):
        now, a = None, None
        rest = lambda: [(now[0], int(now[1]), *e) for e in clock_events(a, np.inf)] if clock and a else []
        for batch in batches:
            out = []
            for fiber, direction, ns, ch, speed in zip(*(c.to_pylist() for c in batch.columns)):
                if (fiber, direction) != now:
                    out += rest()
                    now, a = (fiber, direction), Anomalies(free_flow, silence_s=silence_s)
                found = clocked_events(a, ns, ch, speed) if clock else [(ns, *e) for e in _events(a, ns, ch, speed)]
                out += [(fiber, int(direction), *e) for e in found]
            yield _event_batch(out, names)
        yield _event_batch(rest(), names)

    return fold_sorted(rows, ["fiber_id", "direction"], ["ts_ns", "ch", "speed"], fold, EVENTS)


def _event_batch(out: list[tuple], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 9, _EVENT_TYPES)], names=names)
