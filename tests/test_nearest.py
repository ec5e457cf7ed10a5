"""The nearest channel without rows for pairs, and snapshots of windows that incidents share."""

import datetime as dt
import math

from fiberlake.operators import incidents, joins


def test_nearest_is_found_without_rows_for_pairs(spark):
    channels = [("f", i, 7.0 + i * 0.0003, 43.0 + (i % 7) * 0.0004) for i in range(60)] + [("g", 0, None, None), ("a", 3, 7.0, 43.0)]
    points = [(k, 7.0 + k * 0.0007 - 0.012, 43.0 + (k % 5) * 0.003) for k in range(60)] + [(7, 7.001, 43.0), (99, None, 1.0)]
    c = spark.createDataFrame(channels, "fiber_id string, ch int, lng double, lat double")
    p = spark.createDataFrame(points, "point_id long, lng double, lat double")
    df = joins.nearest_channel(p, c, 0.01)
    want = {}
    for k, x, y in points:
        if x is not None:
            near = [(math.sqrt((a - x) ** 2 + (b - y) ** 2), f, i) for f, i, a, b in channels if a is not None]
            want[k] = min([n for n in [want.get(k)] if n] + [n for n in near if n[0] <= 0.01], default=None)
    got = {r.point_id: (r.dist, r.fiber_id, r.ch) for r in df.collect()}
    assert {k: (round(v[0], 12), *v[1:]) for k, v in got.items()} == {k: (round(v[0], 12), *v[1:]) for k, v in want.items() if v}
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    join = plan.index("Join Inner")
    assert "Generate explode" in plan[join:] and plan[join:].count("Generate") == 2  # channels are dealt, points are not


def test_incidents_share_a_window(spark):
    t = dt.datetime(2024, 1, 1, 0, 10)
    inc = spark.createDataFrame([(f"i{k}", "f", 0, t, 40, 41) for k in range(5)] + [("far", "f", 1, t, 40, 41)], "incident_id string, fiber_id string, direction int, timestamp timestamp, channel_start int, channel_end int")
    det = spark.createDataFrame([("f", t + dt.timedelta(seconds=s), c, 0, 50.0 + s, 2) for s in (-60, -1, 0, 30) for c in (39, 45, 91)], "fiber_id string, ts timestamp, ch int, direction int, speed double, vehicle_count int")
    df = incidents.incident_snapshot(inc, det)
    rows = df.collect()
    assert len(rows) == 6 * 120
    found = {i: sorted((r.time_ms, r.speed, r.flow) for r in rows if r.incident_id == i and r.flow is not None) for i in {r.incident_id for r in rows}}
    assert found.pop("far") == [] and len({tuple(x) for x in found.values()}) == 1
    assert [x[1:] for x in found["i0"]] == [(10.0, 4.0), (49.0, 4.0), (50.0, 4.0), (80.0, 4.0)]
    assert df._jdf.queryExecution().optimizedPlan().toString().count("Aggregate [_w") == 1  # one row a window meets the detections
