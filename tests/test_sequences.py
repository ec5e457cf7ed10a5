"""Sequences of detections against their rules applied to every point and track at every detection."""

import math

import numpy as np
import pytest

from fiberlake.operators import incidents, ordered


class EveryPoint:
    """The rule of speed anomalies over all points at each detection, in whole microseconds."""

    def __init__(self, free):
        self.free, self.now, self.points, self.open = free, None, {}, {}

    def drop(self, mean):
        return max(0.0, (1 - mean / self.free) * 100)

    def step(self, us, ch, speed):
        dt = 0 if self.now is None else min(1_000_000, us - self.now)
        self.now = us
        p = self.points.setdefault(math.floor(ch / 30 + 0.5) * 30, [self.free, 0, us, False, None])
        p[0], p[2] = 0.3 * speed + (1 - 0.3) * p[0], us
        for q in self.points.values():
            q[1] = max(0, q[1] + (-1 if us - q[2] > 10_000_000 else 1 if self.drop(q[0]) >= 40 else -2) * dt)
        out = []
        for c, q in sorted(self.points.items()):
            drop = self.drop(q[0])
            if not q[3]:
                if q[1] >= 8_000_000 and drop >= 40 and all(abs(o - c) >= 120 for o in self.open):
                    self.open[c] = "critical" if drop > 80 or q[0] < 5 else "high" if drop > 60 else "medium" if drop > 50 else "low"
                    q[3], q[4] = True, None
                    out.append(("detected", c, self.open[c]))
            elif q[0] >= self.free * 0.75:
                if q[4] is None:
                    q[4] = us
                elif us - q[4] >= 20_000_000:
                    q[1], q[3], q[4] = 0, False, None
                    out.append(("resolved", c, self.open.pop(c)))
            else:
                q[4] = None
                up = "critical" if drop > 80 and self.open[c] != "critical" else "high" if drop > 60 and self.open[c] in ("low", "medium") else None
                if up:
                    self.open[c] = up
                    out.append(("escalated", c, up))
        return out


@pytest.mark.parametrize("seed, gap, span", [(0, 0.02, 900), (1, 0.3, 900), (2, 1.5, 300), (3, 0.02, 3000)])
def test_anomalies_are_those_of_every_point(seed, gap, span):
    rng = np.random.default_rng(seed)
    a, plain, n = incidents.Anomalies(90.0), EveryPoint(90.0), 0
    us = 1_704_067_200_000_000
    for i in range(4000):
        us += int(rng.exponential(gap) * 1e6) + (30_000_000 if rng.random() < 0.002 else 0)
        ch, speed = int(rng.integers(0, span)), float(rng.choice([3.0, 40.0, 90.0], p=[0.5, 0.2, 0.3] if i % 1500 < 900 else [0.05, 0.05, 0.9]))
        got = [e[:3] for e in a.step(us / 1e6, ch, speed)]
        assert got == plain.step(us, ch, speed)
        n += len(got)
        if i % 997 == 0:  # a stream's state goes on from what it has kept
            a = incidents.Anomalies(90.0, a.dump())
    assert n > 20


def test_a_detection_looks_at_its_own_point_alone():
    """Points that wait cost nothing: looks do not grow with the number of points."""

    class Counted(incidents.Anomalies):
        looks = 0

        def drop(self, mean):
            self.looks += 1
            return super().drop(mean)

    looks = []
    for points in (50, 2000):
        a = Counted(90.0)
        for i in range(6000):
            list(a.step(i * 0.001, i % points * 30, 10.0))
        looks.append(a.looks)
    assert max(looks) < 3 * 6000 + 2000


class EveryTrack:
    """The rule of tracks with every track predicted at each detection."""

    def __init__(self):
        self.tracks, self.count, self.now = [], 0, None

    def step(self, now, ch, speed):
        dt = 0.0 if self.now is None else now - self.now
        self.now = now
        for t in self.tracks:
            t["x"] += t["v"] * dt
            t["px"] += t["pv"] * dt * dt + 0.001 * dt
            t["pv"] += 0.00001 * dt
        self.tracks = [t for t in self.tracks if now - t["seen"] <= (1_000 if t["hits"] == 1 else 10_000)]
        near = []
        for t in self.tracks:
            sd, off = math.sqrt(t["px"]), abs(ch - t["x"])
            if off / max(sd, 1.0) < 3 and off < max(3 * sd, 10):
                near.append((off / max(sd, 1.0), t["id"], t))
        v = speed / 3.6 / 1000 / 5
        if not near:
            self.count += 1
            self.tracks.append({"id": self.count, "x": ch, "v": v, "px": 36.0, "pv": 0.0005, "seen": now, "hits": 1})
            return self.tracks[-1]
        t = min(near)[2]
        a, b = t["px"] / (t["px"] + 64), t["pv"] / (t["pv"] + 0.0004)
        t["x"], t["px"], t["v"], t["pv"] = t["x"] + a * (ch - t["x"]), t["px"] * (1 - a), t["v"] + b * (v - t["v"]), t["pv"] * (1 - b)
        t["seen"], t["hits"] = now, t["hits"] + 1
        return t


@pytest.mark.parametrize("seed, gap, span", [(0, 2, 5000), (1, 30, 900), (2, 300, 90), (3, 2000, 900)])
def test_tracks_are_those_of_every_track(seed, gap, span):
    rng = np.random.default_rng(seed)
    tracker, plain, now = ordered.Tracker(0), EveryTrack(), 1_704_067_200_000.0
    for i in range(2500):
        now += round(rng.exponential(gap), 3) + (8000 if rng.random() < 0.003 else 0)
        ch, speed = float(rng.integers(0, span)), float(rng.choice([0, 20, 90, 400]))
        got, want = tracker.step(now, ch, speed), plain.step(now, ch, speed)
        assert (got["id"], got["hits"]) == (want["id"], want["hits"]) and abs(got["x"] - want["x"]) < 1e-6 and abs(got["v"] - want["v"]) < 1e-9
        if i % 997 == 0:  # a stream's state goes on from what it has kept
            tracker = ordered.Tracker(0, tracker.dump())


def test_a_detection_looks_at_tracks_near_it(monkeypatch):
    """A fiber ten times as long with ten times the traffic costs no more looks a detection."""
    looks = [0]

    def counted(x):
        looks[0] += 1
        return abs(x)

    monkeypatch.setattr(ordered, "abs", counted, raising=False)
    found = []
    for channels in (2_000, 20_000):
        rng, tracker, looks[0] = np.random.default_rng(5), ordered.Tracker(0), 0
        n = channels // 5
        for i in range(n):
            tracker.step(1_704_067_200_000.0 + i * 2_000_000 / channels / 10, float(rng.integers(0, channels)), 90.0)
        found.append(looks[0] / n)
    assert found[1] < 3 * found[0]
