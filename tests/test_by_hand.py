"""Registered queries that have no SQL, against plain definitions over the same rows."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fiberlake.functions import kernels
from fiberlake.operators import incidents, ordered
from fiberlake.plans import registry
from fiberlake.plans.adapters import Views


@pytest.fixture(scope="module")
def views(spark, sf):
    return Views(spark, sf)


def test_spectral_peaks(spark, sf, views):
    """The first maximum that is no nearer than the span to a higher kept one and stands out enough."""

    def first(power, step):
        x = [math.log10(p + 1e-10) for p in power]
        tops = [i for i in range(1, len(x) - 1) if x[i - 1] < x[i] > x[i + 1]]
        kept, apart = [], max(1, math.floor(0.1 / step))
        for i in sorted(tops, key=lambda i: -x[i]):
            if all(abs(i - k) >= apart for k in kept):
                kept.append(i)
        for i in sorted(kept):
            lo, hi = i, i
            while lo > 0 and x[lo - 1] <= x[i]:
                lo -= 1
            while hi < len(x) - 1 and x[hi + 1] <= x[i]:
                hi += 1
            if x[i] - max(min(x[lo : i + 1]), min(x[i : hi + 1])) >= 0.4:
                return i
        return None

    want = {}
    for r in views.spectra().collect():
        i = first(r.power, r.freqs[1] - r.freqs[0])
        want[r.infra_id, r.t_idx] = (None, None) if i is None else (r.freqs[i], r.power[i])
    got = {(r.infra_id, r.t_idx): (r.freq, r.power) for r in registry.QUERIES["spectral_peaks"](spark, sf).collect()}
    assert got == want and any(f is not None for f, _ in got.values())


def test_simplify_cables(spark, sf, views):
    def keep(p, tol):
        """Recursive rule of Douglas and Peucker."""
        if len(p) < 3:
            return p
        (_, ax, ay), (_, bx, by) = p[0], p[-1]
        length = math.hypot(bx - ax, by - ay)
        off = [abs((bx - ax) * (y - ay) - (by - ay) * (x - ax)) / length if length else math.hypot(x - ax, y - ay) for _, x, y in p[1:-1]]
        k = max(range(len(off)), key=off.__getitem__)
        return keep(p[: k + 2], tol)[:-1] + keep(p[k + 1 :], tol) if off[k] > tol else [p[0], p[-1]]

    cables: dict = {}
    for r in views.wide_geo().collect():
        if r.lng is not None:
            cables.setdefault(r.fiber_id, []).append((r.ch, r.lng, r.lat + (0.01 if r.ch % 10 == 5 else 0.0)))
    want = {(f, c) for f, p in cables.items() for c, _, _ in keep(sorted(p), 0.002)}
    got = {(r.fiber_id, r.ch) for r in registry.QUERIES["simplify_cables"](spark, sf).collect()}
    assert got == want and 0 < len(want) < sum(map(len, cables.values()))


def test_bandpass_zero_phase(spark, sf, views):
    sos = kernels.butter_bandpass_sos(0.3, 2.0, 10.4167)
    rows = views.signal().toPandas().sort_values(["fiber_id", "ch", "t_idx"])
    want = {k: kernels.sosfiltfilt(sos, g.v.to_numpy()[None])[0] for k, g in rows.groupby(["fiber_id", "ch"])}
    got = registry.QUERIES["bandpass_zero_phase"](spark, sf).toPandas().sort_values(["fiber_id", "ch", "t_idx"])
    for k, g in got.groupby(["fiber_id", "ch"]):
        assert np.abs(g.v.to_numpy() - want[k]).max() < 1e-9


def sequences(det):
    """Rows of each fiber and direction, in order."""
    out: dict = {}
    for r in sorted(det.filter("speed is not null").select("fiber_id", "direction", "ts_ns", "ch", "speed").collect(), key=lambda r: (r.ts_ns, r.ch, r.speed)):
        out.setdefault((r.fiber_id, r.direction), []).append(r)
    return out


def tracks(det):
    out = []
    for (fiber, direction), rows in sequences(det).items():
        t = ordered.Tracker(direction)
        for r in rows:
            x = t.step(r.ts_ns / 1e6, float(r.ch), r.speed)
            out.append((fiber, direction, r.ts_ns, r.ch, x["id"], round(x["x"], 6), x["state"]))
    return sorted(out)


def found(df):
    return sorted((r.fiber_id, r.direction, r.ts_ns, r.ch, r.track, round(r.position, 6), r.state) for r in df.collect())


def test_track_vehicles(spark, sf, views):
    assert found(registry.QUERIES["track_vehicles"](spark, sf)) == tracks(views.detections_dense())


def test_tracks_go_on_after_gaps(views):
    """Detections days apart: sessions are folded apart and numbered as one sequence."""
    det = views.detections()
    assert found(ordered.track_vehicles(det)) == tracks(det)


def test_detect_incidents(spark, sf, views):
    want = []
    for (fiber, direction), rows in sequences(views.detections_dense().withColumn("speed", F.col("speed") / 5)).items():
        a = incidents.Anomalies(90.0)
        for r in rows:
            want += [(fiber, direction, r.ts_ns, c, kind, severity) for kind, c, severity, *_ in a.step(r.ts_ns / 1e9, r.ch, r.speed)]
    got = [(r.fiber_id, r.direction, r.ts_ns, r.ch, r.event, r.severity) for r in registry.QUERIES["detect_incidents"](spark, sf).collect()]
    assert sorted(got) == sorted(want) and want
