"""Streams give the batch's rows, whatever the chunks."""

import datetime as dt
import time

import numpy as np
from pyspark.sql import functions as F

from fiberlake.functions import kernels
from fiberlake.operators import alerts, incidents, ordered, rollups
from fiberlake.streaming import jobs

DET = "fiber_id string, ts timestamp, ts_ns bigint, ch int, direction int, speed double, vehicle_count double, n_cars double, n_trucks double, seq bigint"


def detections(spark, n=240):
    rng = np.random.default_rng(8)
    t0 = 1_704_067_200_000_000_000
    rows = []
    for i in range(n):
        ns = t0 + i * 500_000_000
        rows.append((f"f{i % 2}", dt.datetime.fromtimestamp(ns / 1e9, dt.timezone.utc), ns, int(rng.integers(0, 90)), 0, float(rng.choice([5.0, 10.0, 85.0])), 1.0, 1.0, 0.0, i))
    return spark.createDataFrame(rows, DET)


def chunked(spark, df, order, path, chunks=4):
    """A file stream whose micro-batches are slices in order."""
    n = df.count()
    for k in range(chunks):
        part = df.orderBy(order).offset(k * n // chunks).limit((k + 1) * n // chunks - k * n // chunks).coalesce(1)
        part.write.mode("append").parquet(f"{path}")
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(path))


def run(df, name, mode="append", n=None):
    """All rows through a query. Where state can time out the query never ends by itself: it is stopped after ``n`` rows."""
    writer = df.writeStream.format("memory").queryName(name).outputMode(mode)
    q = (writer if n else writer.trigger(availableNow=True)).start()
    if n is None:
        q.awaitTermination(120)
    seen, until = {}, time.time() + 90
    while n and sum(seen.values()) < n and time.time() < until and q.isActive:
        seen |= {p["batchId"]: p["numInputRows"] for p in q.recentProgress if p["numInputRows"]}
        time.sleep(0.2)
    assert q.exception() is None
    q.stop()
    return df.sparkSession.table(name)


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_rollup_stream_in_update_mode(spark, tmp_path):
    d = detections(spark)
    got = run(jobs.rollup_stream(chunked(spark, d, "seq", tmp_path / "in")), "roll", "update")
    final = got.groupBy("fiber_id", "ts", "ch", "direction").agg(F.max("samples").alias("samples"))
    assert rows(final, "fiber_id", "ts", "ch", "samples") == rows(rollups.rollup_1m(d), "fiber_id", "ts", "ch", "samples")


def test_hours_follow_minutes_in_one_stream(spark, tmp_path):
    d = detections(spark, 400).withColumn("ts", F.timestamp_micros(F.floor(F.col("ts_ns") / 1000) + F.col("seq") * 40_000_000)).withColumn("ts_ns", F.unix_micros("ts") * 1000)
    last = d.agg(F.max("ts")).first()[0]
    late = d.orderBy("seq").limit(1).withColumn("seq", F.lit(10_000))
    far = late.withColumn("ts", F.lit(last) + F.expr("interval 5 hours")).withColumn("seq", F.lit(9_999))
    src = chunked(spark, d.unionByName(far).unionByName(late.coalesce(1)), "seq", tmp_path / "in", 6)
    q = jobs.rollup_hours_stream(src).writeStream.format("memory").queryName("hours").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    dropped = sum(o["numRowsDroppedByWatermark"] for p in q.recentProgress for o in p["stateOperators"])
    cols = ("fiber_id", "ts", "ch", "direction", "samples", "speed_max", "speed_sum")
    got = rows(spark.table("hours"), *cols)
    want = rows(rollups.rollup_1h(rollups.rollup_1m(d)), *cols)
    assert got == want and len({r[1] for r in got}) > 3 and dropped >= 1


def test_incidents_and_tracks(spark, tmp_path):
    d = detections(spark)
    cols = ("fiber_id", "ts_ns", "ch", "event", "severity")
    assert rows(run(jobs.detect_incidents_stream(chunked(spark, d, "seq", tmp_path / "a"), 90.0), "inc"), *cols) == rows(incidents.detect_incidents(d, 90.0), *cols)
    cols = ("fiber_id", "ts_ns", "track", "position", "state")
    assert rows(run(jobs.track_vehicles_stream(chunked(spark, d, "seq", tmp_path / "b")), "trk"), *cols) == rows(ordered.track_vehicles(d), *cols)


def test_bandpass_stream(spark, tmp_path):
    x = np.random.default_rng(9).normal(size=(3, 96))
    c, t = np.indices(x.shape)
    df = spark.createDataFrame([("f", "s", int(a), int(b), float(v)) for a, b, v in zip(c.ravel(), t.ravel(), x.ravel())], "fiber_id string, section string, ch int, t_idx bigint, v double")
    out = run(jobs.bandpass_stream(chunked(spark, df, "t_idx", tmp_path / "in"), 0.3, 2.0, 10.4167), "bp", n=288).toPandas()
    got = out.pivot(index="ch", columns="t_idx", values="v").to_numpy(float)
    assert np.abs(got - kernels.sosfilt(kernels.butter_bandpass_sos(0.3, 2.0, 10.4167), x)[0]).max() < 1e-12


def test_bandpass_stream_of_ragged_batches(spark, tmp_path):
    """A channel's samples come late: each channel carries its own state."""
    x = np.random.default_rng(10).normal(size=(2, 40))
    order = [(c, t) for t in range(40) for c in (0, 1) if not (c == 1 and t >= 15)] + [(1, t) for t in range(15, 40)]
    df = spark.createDataFrame([("f", "s", c, t, float(x[c, t]), i) for i, (c, t) in enumerate(order)], "fiber_id string, section string, ch int, t_idx bigint, v double, i int")
    out = run(jobs.bandpass_stream(chunked(spark, df, "i", tmp_path / "in", 5), 0.3, 2.0, 10.4167), "bpr", n=80).toPandas()
    got = out.pivot(index="ch", columns="t_idx", values="v").to_numpy(float)
    assert np.abs(got - kernels.sosfilt(kernels.butter_bandpass_sos(0.3, 2.0, 10.4167), x)[0]).max() < 1e-12


def test_state_goes_after_silence():
    """Steps forget a key on a time-out, and a barrier gives up old windows."""
    steps = {}
    real, jobs._stateful = jobs._stateful, lambda df, keys, schema, step, *_: steps.setdefault(schema, step)
    try:
        class Any:
            def select(self, *_):
                return self

        step = jobs.section_barrier_stream(Any(), {"f": ["a", "b"]}, timeout_ms=0)
    finally:
        jobs._stateful = real
    import pandas as pd

    _, held = step(("f",), pd.DataFrame({"window": [1], "section": ["a"]}), None)
    assert list(held) == [1] and step(("f",), None, held) == (None, None)
    held = {1: (held[1][0] - 10, held[1][1])}
    out, held = step(("f",), pd.DataFrame({"window": [1], "section": ["b"]}), held)
    assert not len(out) and held[1][1] == {"b"}


def test_done_batches_are_not_written_again(spark, tmp_path):
    seen = []
    f = jobs.upsert_batches(lambda df, b: seen.append((b, df.count())), str(tmp_path / "done"))
    for b in (0, 0, 1, 0, 1):
        f(spark.range(3 + b), b)
    assert seen == [(0, 3), (1, 4)]
    again = jobs.upsert_batches(lambda df, b: seen.append((b, df.count())), str(tmp_path / "done"))  # after a restart
    again(spark.range(9), 1)
    again(spark.range(9), 2)
    assert seen == [(0, 3), (1, 4), (2, 9)]


def test_capture_stream(spark, tmp_path):
    df = spark.createDataFrame([("f", i, i, [0.0] * (4 if i % 5 else 3)) for i in range(20)], "fiber_id string, frame_seq bigint, ts_ns bigint, values array<double>")
    jobs.capture_stream(chunked(spark, df, "frame_seq", tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert {r.frame_seq for r in got} == {i for i in range(20) if i % 5} and all(len(r["values"]) == 4 for r in got)


def test_rolling_windows_and_barrier(spark, tmp_path):
    df = spark.createDataFrame([("k", i, float(i)) for i in range(40)], "k string, t_idx bigint, v double")
    got = run(jobs.rolling_windows(chunked(spark, df, "t_idx", tmp_path / "a"), "k", 16, 12), "rw", n=40)
    want = {(w, t) for w in range(3) for t in range(w * 12, w * 12 + 16)}
    assert {(r.window, r.t_idx) for r in got.filter("not partial").collect()} == want
    w = spark.createDataFrame([("f", i // 2, "ab"[i % 2]) for i in range(7)], "fiber_id string, window bigint, section string").withColumn("i", F.col("window") * 2)
    got = run(jobs.section_barrier_stream(chunked(spark, w, "i", tmp_path / "b", 3), {"f": ["a", "b"]}), "bar", n=7)
    assert rows(got, "fiber_id", "window") == [("f", 0), ("f", 1), ("f", 2)]


def test_alert_stream(spark, tmp_path):
    from fiberlake import schemas

    d = detections(spark)
    rules = spark.createDataFrame([("r", "A", "speed_below", True, [], None, None, 8.0, [], [], 20)], schemas.RULE)
    assign = spark.createDataFrame([("A", "f0"), ("A", "f1")], schemas.ASSIGNMENT)
    cols = ("rule_id", "fiber_id", "ch", "ts_ns")
    got = run(jobs.alert_stream(chunked(spark, d, "seq", tmp_path / "in"), rules, assign), "al", n=240)
    assert rows(got, *cols) == rows(alerts.apply_cooldown(alerts.eval_detection_rules(d, rules, assign)), *cols)


def test_ingest_and_dead_letters(spark, tmp_path):
    det = "struct<timestamp_ns:bigint,channel:int,direction:int,speed_kmh:double,vehicle_count:double,n_cars:double,n_trucks:double,glrt_max:double,strain_peak:double,strain_rms:double>"
    one = lambda ns, ch: {"timestamp_ns": ns, "channel": ch, "direction": 0, "speed_kmh": 50.0, "vehicle_count": 1.0, "n_cars": 1.0, "n_trucks": 0.0, "glrt_max": 1.0, "strain_peak": 0.1, "strain_rms": 0.1}
    t = 1_704_067_200_000_000_000
    b = spark.createDataFrame([("f", [one(t, 0), one(t, 0), one(t, 1), one(t + 10**9, 5)])], f"fiber_id string, detections array<{det}>")
    b.write.parquet(str(tmp_path / "in"))
    cables = spark.createDataFrame([("f", [(7.0, 43.0), (None, None)])], "fiber_id string, coordinates array<struct<lng:double,lat:double>>")
    q = jobs.ingest_stream(spark.readStream.schema(b.schema).parquet(str(tmp_path / "in")), cables, str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out"))
    assert sorted((r.ch, r.lng) for r in got.collect()) == [(0, 7.0), (1, None), (5, None)] or sorted((r.ch, r.lng or 0) for r in got.collect()) == [(0, 7.0), (1, 0), (5, 0)]
    d = detections(spark, 40)
    write = jobs.split_to_dlq({"slow": F.col("speed") > 6}, F.lit("t"), F.col("seq"), str(tmp_path / "ok"), str(tmp_path / "dlq"))
    for _ in range(2):  # a replayed batch changes nothing
        write(d, 0)
    assert spark.read.parquet(str(tmp_path / "ok")).count() + spark.read.parquet(str(tmp_path / "dlq")).count() == 40


def test_static_refresh(spark):
    seen = []
    load = lambda s: s.range(len(seen) + 1)
    f = jobs.static_refresh(load, lambda df, dim: df.join(dim, "id"), lambda df, b: seen.append(df.count()), every=2)
    for b in range(4):
        f(spark.range(10), b)
    assert seen == [1, 1, 3, 3]


