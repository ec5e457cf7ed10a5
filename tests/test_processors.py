"""Processors with timers: chunked streams give the batch's rows, and the clock does what no row brings about."""

import datetime as dt
import time

import numpy as np
import pytest

from fiberlake.operators import detection, incidents, ordered, signals
from fiberlake.streaming import processors

DET = "fiber_id string, ts timestamp, ts_ns bigint, ch int, direction int, speed double, seq bigint"
T0 = 1_704_067_200_000_000_000


def table(spark, rows):
    rows = sorted(rows, key=lambda r: r[0])
    return spark.createDataFrame([(f, dt.datetime.fromtimestamp(ns / 1e9, dt.timezone.utc), ns, c, d, v, i) for i, (ns, f, c, d, v) in enumerate(rows)], DET)


@pytest.fixture
def rocksdb(spark):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    processors.use_rocksdb(spark)
    yield
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def streamed(spark, df, path, name, make, chunks=4):
    """The rows of a stream over slices of ``df`` in order; a last far row of another key moves the watermark past all timers."""
    n = df.count()
    far = table(spark, [(T0 + 10**15, "far", 0, 0, 90.0)])
    for k in range(chunks):
        df.orderBy("seq").offset(k * n // chunks).limit((k + 1) * n // chunks - k * n // chunks).coalesce(1).write.mode("append").parquet(path)
    for _ in range(2):
        far.coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)
    q = make(stream).writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    until = time.time() + 150
    while q.isActive and time.time() < until:
        time.sleep(0.3)
    assert q.exception() is None
    q.stop()
    return spark.table(name).filter("fiber_id <> 'far'")


def rows(df):
    return sorted((tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.collect()), key=repr)


def slow_then_free(fiber, at=0, ch=60):
    """Traffic that stands for 30 s, then flows for a few seconds, then nothing."""
    s = 10**9
    return [(T0 + at * s + i * s // 2, fiber, ch, 0, 4.0 if i < 60 else 90.0) for i in range(84)]


def test_incidents_resolve_by_the_clock(spark, tmp_path, rocksdb):
    df = table(spark, slow_then_free("a") + slow_then_free("b", 7, 90) + slow_then_free("c", 4000, 300)[:60])
    batch = incidents.detect_incidents(df, 90.0, clock=True)
    plain = incidents.detect_incidents(df, 90.0)
    assert plain.filter("event = 'resolved'").count() == 0  # no further row comes
    assert batch.filter("event = 'resolved'").count() == 2 and batch.filter("event = 'expired'").count() == 1
    got = streamed(spark, df, str(tmp_path / "in"), "clocked", lambda s: processors.incidents_stream(s, 90.0))
    assert rows(got) == rows(batch)


def test_random_traffic_in_chunks(spark, tmp_path, rocksdb):
    rng = np.random.default_rng(2)
    df = table(spark, [(T0 + i * 400_000_000 + (i // 150) * 30 * 10**9, f"f{i % 2}", int(rng.integers(0, 90)), int(i % 3 == 0), float(rng.choice([5.0, 10.0, 85.0, 95.0]))) for i in range(400)])
    got = streamed(spark, df, str(tmp_path / "a"), "rnd_i", lambda s: processors.incidents_stream(s, 90.0, silence_s=25.0))
    assert rows(got) == rows(incidents.detect_incidents(df, 90.0, clock=True, silence_s=25.0))
    got = streamed(spark, df, str(tmp_path / "b"), "rnd_t", processors.tracks_stream)
    want = ordered.track_ends(df)
    assert rows(got) == rows(want)
    assert rows(want.filter("state <> 'ended'")) == rows(ordered.track_vehicles(df))
    ended, tracks = want.filter("state = 'ended'"), want.select("fiber_id", "direction", "track").distinct()
    assert ended.count() == tracks.count() == ended.select("fiber_id", "direction", "track").distinct().count()  # each track ends, once


def test_state_of_a_silent_fiber_goes():
    a = incidents.Anomalies(90.0, silence_s=60.0)
    for ns, _, ch, _, v in slow_then_free("a")[:60]:
        list(a.step(ns / 1e9, ch, v))
    assert a.open and a.due() == a.now + 60
    assert [e[0] for _, e in a.advance(np.inf)] == ["expired"]
    assert a.dump() == {"points": {}, "open": {}, "now": None} and a.due() is None


def test_points_that_nothing_is_the_matter_with_are_left_alone():
    """Looking at active points only gives what looking at all points gives."""
    rng = np.random.default_rng(4)

    class All(incidents.Anomalies):
        active = property(lambda self: set(self.points), lambda self, x: None)

    few, every = incidents.Anomalies(90.0), All(90.0)
    for i in range(6000):
        args = (i * 0.3 + (i // 2000) * 30, int(rng.integers(0, 900)), float(rng.choice([3.0, 40.0, 90.0], p=[0.5, 0.2, 0.3] if i % 2000 < 1200 else [0.05, 0.05, 0.9])))
        assert list(few.step(*args)) == list(every.step(*args))
    assert few.dump() == every.dump()


def passing(seed, channels=7, n=260, delay=8):
    """A wave that moves by a channel in ``delay`` samples, in bursts."""
    rng = np.random.default_rng(seed)
    base = np.zeros(n + channels * delay)
    for at in range(30, n, 60):
        base[at : at + 24] += rng.normal(size=24) * rng.uniform(1, 2)
    return np.stack([base[(channels - 1 - c) * delay :][:n] + rng.normal(size=n) * 0.02 for c in range(channels)])


def stopped_after(q, n):
    """Stops a query once it has taken ``n`` rows; with a time to live it would not end by itself."""
    seen, until = {}, time.time() + 150
    while sum(seen.values()) < n and time.time() < until and q.isActive:
        seen |= {p["batchId"]: p["numInputRows"] for p in q.recentProgress if p["numInputRows"]}
        time.sleep(0.2)
    assert q.exception() is None
    q.stop()


HOW = {"fs": 10.4167, "gauge": 15.3846, "corr": 0.05, "size": 96, "hop": 72}
MORE = {"nch": 3, "step": 2, "max_lag": 12}


@pytest.mark.parametrize("chunks", [4])
def test_frames_to_detections(spark, tmp_path, rocksdb, chunks):
    rows_ = [(f, s, c, t, float(v)) for f, s, seed in (("a", "x", 1), ("a", "y", 2), ("b", "x", 3)) for c, x in enumerate(passing(seed)) for t, v in enumerate(x)]
    df = spark.createDataFrame(rows_, "fiber_id string, section string, ch int, t_idx bigint, v double")
    win = signals.time_windows(df, 96, 72, ("fiber_id", "section"))
    batch = detection.detect_windows(win, **HOW, **MORE)
    assert batch.count() >= 6
    edges = [260 * k // chunks for k in range(chunks + 1)]
    for a, b in zip(edges, edges[1:]):
        df.filter((df.t_idx >= a) & (df.t_idx < b)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = processors.windows_stream(stream(), 96, 72).writeStream.format("memory").queryName(f"win{chunks}").trigger(availableNow=True).start()
    stopped_after(q, df.count())
    names = ["fiber_id", "section", "t_window", "ch", "t", "v"]
    assert rows(spark.table(f"win{chunks}").select(*names)) == rows(win.select(*names))
    q = processors.detections_stream(stream(), str(tmp_path / "out"), str(tmp_path / "ck"), **HOW, **MORE)
    stopped_after(q, df.count())
    assert rows(spark.read.parquet(str(tmp_path / "out")).select(*batch.columns)) == rows(batch)


def test_windows_of_a_table_are_detected_one_by_one(spark):
    """Each window in time has the detections of the chain over that window alone."""
    df = spark.createDataFrame([("a", "x", c, t, float(v)) for c, x in enumerate(passing(5)) for t, v in enumerate(x)], "fiber_id string, section string, ch int, t_idx bigint, v double")
    got = detection.detect_windows(signals.time_windows(df, 96, 72, ("fiber_id", "section")), **HOW, **MORE)
    want = []
    for k in range(3):
        one = df.filter((df.t_idx >= 72 * k) & (df.t_idx < 72 * k + 96)).withColumn("t_idx", df.t_idx - 72 * k)
        w = signals.spatial_windows(one, 3, 2).select("fiber_id", "window", "pos", one.t_idx.alias("t"), "v")
        shifts = detection.pair_shift(w, 12)
        aligned = detection.align_shift(w, shifts, 3)
        g = detection.glrt_sum(detection.glrt(aligned))
        out = detection.extract_detections(g, detection.pair_speed(shifts, 10.4167, 15.3846), aligned, 10.4167, 0.05, 3)
        want += [(k, r.window, r.start_idx, r.end_idx, round(r.speed, 6), r.vehicle_count) for r in out.collect() if 15 <= r.t_mid <= 80]
    assert want and sorted((r.t_window, r.window, r.start_idx, r.end_idx, round(r.speed, 6), r.vehicle_count) for r in got.collect()) == sorted(want)
