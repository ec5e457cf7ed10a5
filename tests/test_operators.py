"""Operators on small inputs with known results."""

import datetime as dt
import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from fiberlake.functions import kernels
from fiberlake.functions import scalars as S
from fiberlake.operators import alerts, counting, detection, filters, incidents, joins, ordered, rollups, signals
from fiberlake.sources import dimensions, frames, sinks


def one(spark, col):
    return spark.range(1).select(col.alias("x")).first()["x"]


def test_scalars(spark):
    assert one(spark, S.idiv(F.lit(-7).cast("bigint"), 2)) == -4
    assert one(spark, S.ns_to_ms(F.lit(1_700_000_000_123_456_789))) == 1_700_000_000_123
    assert one(spark, S.round_py(F.lit(2.5))) == 2.0 and one(spark, S.round_js(F.lit(2.5))) == 3
    assert [one(spark, S.occupancy(F.lit(s), F.lit(f))) for s, f in ((0.5, 10.0), (0.5, 0.0), (60.0, 1200.0), (5.0, 90000.0))] == [100, 0, 1, 100]
    assert one(spark, S.occupancy(F.lit(0.0), F.lit(3.0), "snapshot")) is None
    assert one(spark, S.travel_time(F.lit(100), F.lit(60.0))) == 0.5 and one(spark, S.travel_time(F.lit(100), F.lit(0.0))) is None
    assert one(spark, S.narrow(F.lit(70000), 0, 65535)) is None and one(spark, S.narrow(F.lit(7), 0, 65535)) == 7
    assert one(spark, S.parse_bound(F.lit("2024-01-02"), True)) == dt.datetime(2024, 1, 2, 23, 59, 59)
    assert one(spark, S.parse_bound(F.lit("no date"))) is None
    assert len(one(spark, S.clip_error(F.lit("x" * 2000)))) == 1000
    assert one(spark, S.at(F.array(F.lit(1)), F.lit(2))) is None
    assert one(spark, S.level256(F.lit(5.0), F.lit(0.0), F.lit(10.0))) == 127
    assert one(spark, S.shm_status(F.lit("alert"))) == "warning"
    assert one(spark, S.safe_ratio(F.lit(1.0), F.lit(0.0), 0.0)) == 0.0
    assert one(spark, S.to_ch_per_ms(F.lit(18.0))) == pytest.approx(0.001)


def test_tier_choice():
    t = dt.datetime(2024, 1, 1)
    day = dt.timedelta(days=1)
    assert [sinks.select_tier(t, t + n * day) for n in (2, 3, 90, 91)] == ["hires", "1m", "1m", "1h"]
    assert sinks.select_tier(t, t + 7 * day, "hires") == "hires"
    for bad in ((t, t, "auto"), (t, t + 8 * day, "hires"), (t, t + day, "2m")):
        with pytest.raises(ValueError):
            sinks.select_tier(*bad)


def test_tier_files_are_pruned(spark, tmp_path):
    rows = [(f"f{i % 2}", dt.datetime(2024, 1, 1 + i % 5, i % 24), i, i % 2, float(i)) for i in range(100)]
    df = spark.createDataFrame(rows, "fiber_id string, ts timestamp, ch int, direction int, speed double")
    sinks.write_tier(df, "hires", str(tmp_path))
    got = sinks.scan_tier(spark, str(tmp_path), "hires", dt.datetime(2024, 1, 2), dt.datetime(2024, 1, 3, 12))
    want = df.filter("ts between '2024-01-02' and '2024-01-03 12:00:00'")
    assert got.count() == want.count() > 0
    assert "PartitionFilters" in got._jdf.queryExecution().toString() and "date" in got._jdf.queryExecution().toString()
    s = sinks.storage_by_tier(spark, str(tmp_path), ["hires"]).first()
    assert s["rows"] == 100 and s["bytes"] > 0


def test_range_join_is_an_equi_join(spark):
    left = spark.createDataFrame([("a", i) for i in range(200)], "k string, v int")
    right = spark.createDataFrame([("a", 5, 70, "x"), ("a", 60, 199, "y"), ("b", 0, 9, "z")], "k string, lo int, hi int, name string")
    df = joins.range_join(left, right, "v", "lo", "hi", ["k"])
    assert df.groupBy("name").count().collect() and {r["name"]: r["count"] for r in df.groupBy("name").count().collect()} == {"x": 66, "y": 140}
    assert "NestedLoop" not in df._jdf.queryExecution().toString()
    assert joins.range_join(left, right, "v", "lo", "hi", ["k"], how="left").count() == 206 + 5


def test_frames(spark):
    raw = spark.createDataFrame([("das.raw.f1", 5, [1.0, 2.0, 3.0, 4.0], None, 1), ("das.raw.f1", 6, [], [1, 2], 2), ("das.raw.f1", 7, [1.0, 2.0, 3.0], None, 3), ("das.raw.f2", 7, [], None, 4), ("das.raw.f3", 7, [1.0], None, 4)], "topic string, ts_ns bigint, floatData array<float>, longData array<bigint>, frame_seq bigint")
    f = frames.normalize_frames(raw)
    assert f.count() == 4
    p = spark.createDataFrame([("f1", 2, 10.0, 5.0), ("f3", 0, 10.0, 5.0)], "fiber_id string, n_channels int, rate double, gauge double")
    rows = frames.explode_frames(f, p).collect()
    assert sorted((r.frame_seq, r.sample, r.ch, r.ts_ns, r.v) for r in rows) == [(1, 0, 0, 5, 1.0), (1, 0, 1, 5, 2.0), (1, 1, 0, 100000005, 3.0), (1, 1, 1, 100000005, 4.0), (2, 0, 0, 6, 1.0), (2, 0, 1, 6, 2.0)]
    assert frames.modal_frames(f.filter("fiber_id = 'f1'")).count() in (1, 1)


def test_decode_rejects(spark):
    good = np.arange(6, dtype="<f4").tobytes()
    rows = [("f", "s", i, 0, v, 2, 0, 3, r) for i, (v, r) in enumerate(((good, 10.0), (good[:-1], 10.0), (good, 11.0)))]
    df = spark.createDataFrame(rows, "fiber_id string, section string, frame_seq bigint, ts_ns bigint, values binary, n_samples int, channel_start int, channel_count int, sampling_rate_hz double")
    ok, bad = frames.decode_processed(df, 10.0)
    assert ok.count() == 6 and sorted(r.error for r in bad.collect()) == ["bad payload length", "unexpected sampling rate"]


def test_legacy_detection(spark):
    det = "struct<timestamp_ns:bigint,channel:int,direction:int,speed_kmh:double,vehicle_count:double,n_cars:double,n_trucks:double,glrt_max:double,strain_peak:double,strain_rms:double>"
    df = spark.createDataFrame([("f", [], 10**18, 4, 1, 50.0, 1.0, 1.0, 0.0, 9.0, 0.1, 0.1), ("g", [], None, None, None, None, None, None, None, None, None, None)], f"fiber_id string, detections array<{det}>, timestamp_ns bigint, channel int, direction int, speed_kmh double, vehicle_count double, n_cars double, n_trucks double, glrt_max double, strain_peak double, strain_rms double")
    r = frames.flatten_detections(df).collect()
    assert len(r) == 1 and (r[0].ch, r[0].speed, r[0].ts_ns) == (4, 50.0, 10**18)


def test_config_and_files(spark, tmp_path):
    cfg = {"fibers": {"f": {"defaults": {"steps": [{"step": "scale", "params": {"factor": 2}}], "model_hint": "m"}, "sections": [{"name": "a", "channels": [0, 10]}, {"name": "b", "channels": [5, 20], "model_hint": "n"}], "coverage": [{"start": 9, "end": 12}, {"start": 1, "end": 3}]}}}
    s, c = dimensions.config_tables(spark, json.dumps(cfg))
    assert [r.model_hint for r in s.orderBy("ord").collect()] == ["m", "n"] and [r.start for r in c.collect()] == [1, 9]
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "x.json").write_text(json.dumps({"coordinates": [[7.0, 43.0], [None, None]], "labels": ["A", None]}))
    (tmp_path / "c" / "y.json").write_text(json.dumps({"id": "none"}))
    r = dimensions.read_cables(spark, str(tmp_path / "c")).collect()
    assert [(x.fiber_id, x.channel_count) for x in r] == [("x", 2)]
    (tmp_path / "t.csv").write_text("1,2\n3,4\n")
    assert [tuple(x) for x in dimensions.read_thresholds(spark, str(tmp_path / "t.csv")).collect()] == [(0, 1.0, 2.0), (1, 3.0, 4.0)]
    (tmp_path / "n.csv").write_text("1,2,3,4,5\n6,7,8,9,10\n")
    assert dimensions.read_feature_norm(spark, str(tmp_path / "n.csv"))[0] == (1.0, 6.0)
    (tmp_path / "z").mkdir()
    np.savez(tmp_path / "z" / "b1.npz", spectra=np.ones((3, 4)), freqs=np.arange(4.0), t0=100.0, t=np.arange(3) * 1e-9)
    assert [x.ts_us for x in dimensions.read_spectra(spark, str(tmp_path / "z")).orderBy("t_idx").collect()] == [100_000_000, 101_000_000, 102_000_000]
    (tmp_path / "k").mkdir()
    np.savez(tmp_path / "k" / "f_threshold_1.npz", threshold_curve=np.array([5.0, 6.0]), date="d", method="MAD")
    np.savez(tmp_path / "k" / "f_coupling_1.npz", correction_factors=np.array([1.5]), median_glrt=2.0)
    (tmp_path / "k" / "g_threshold_1.npz").write_bytes(b"broken")
    k = dimensions.read_calibration(spark, str(tmp_path / "k")).orderBy("section_idx").collect()
    assert [(x.fiber_id, x.threshold, x.correction) for x in k] == [("f", 5.0, 1.5), ("f", 6.0, 1.0)]


def test_latest_params(spark):
    df = spark.createDataFrame([("a", 1, 0.1, 5, 1.0), ("a", 2, 0.2, 6, 1.0), ("a", 3, -1.0, 7, 1.0)], "fiber_id string, offset bigint, dt double, n_channels int, gauge double")
    fb = spark.createDataFrame([("b", 9, 50.0, 2.0)], "fiber_id string, n_channels int, rate double, gauge double")
    assert {r.fiber_id: (r.n_channels, r.rate) for r in dimensions.latest_params(df, fb).collect()} == {"a": (6, 5.0), "b": (9, 50.0)}


def sig(spark, x, fiber="f"):
    c, t = np.indices(x.shape)
    pdf = pd.DataFrame({"fiber_id": fiber, "section": "s", "ch": c.ravel().astype("int32"), "t_idx": t.ravel().astype("int64"), "v": x.ravel()})
    return spark.createDataFrame(pdf, "fiber_id string, section string, ch int, t_idx bigint, v double")


def grid(df, row="ch", col="t_idx", val="v"):
    return df.toPandas().pivot(index=row, columns=col, values=val).to_numpy(float)


@pytest.mark.parametrize("span", [1, 5, 16, 1000])
def test_filters_are_the_same_in_chunks(spark, span):
    """Ragged channels, gaps in time, non-finite samples and chunks of any size, against the kernels over whole channels."""
    rng = np.random.default_rng(span)
    rows, sos = [], kernels.butter_bandpass_sos(0.3, 2.0, 10.4167)
    want, back = {}, {}
    for ch, n in enumerate((1, 2, 20, 27, 28, 29, 60, 61, 61)):
        t = np.sort(rng.choice(200, n, replace=False)) - 50
        x = rng.normal(size=n)
        x[n // 2] = np.nan if ch % 2 else x[n // 2]
        rows += [("f", "s", ch * 10, int(a), float(v)) for a, v in zip(t, x)]
        want |= {(ch * 10, int(a)): y for a, y in zip(t, kernels.sosfilt(sos, x[None])[0][0])}
        back |= {(ch * 10, int(a)): y for a, y in zip(t, kernels.sosfiltfilt(sos, x[None])[0])}
    df = spark.createDataFrame(rows, "fiber_id string, section string, ch int, t_idx bigint, v double").repartition(3)
    for f, w in ((signals.bandpass, want), (signals.bandpass_zero_phase, back)):
        out = f(df, 0.3, 2.0, 10.4167, block=32, span=span)
        assert out.schema == df.schema
        got = {(r.ch, r.t_idx): r.v for r in out.collect()}
        assert got.keys() == w.keys() and max(abs(got[k] - w[k]) for k in w) < 1e-9


def test_bandpass_equals_kernel(spark):
    x = np.random.default_rng(3).normal(size=(130, 48))  # more than one block of channels
    want = kernels.sosfilt(kernels.butter_bandpass_sos(0.3, 2.0, 10.4167), x)[0]
    assert np.abs(grid(signals.bandpass(sig(spark, x), 0.3, 2.0, 10.4167)) - want).max() < 1e-12


def test_common_mode_in_arrays(spark):
    x = np.random.default_rng(4).normal(size=(3, 5))
    x[1, 2] = np.nan
    df = spark.createDataFrame([("f", x.ravel().tolist())], "fiber_id string, values array<double>")
    got = np.array(signals.cmr_arrays(df, F.lit(5)).first()["values"], float).reshape(3, 5)
    want = x - np.nanmedian(x, 1, keepdims=True)
    assert np.allclose(got, want, equal_nan=True)


def test_pipeline_order(spark):
    x = np.random.default_rng(5).normal(size=(12, 4))
    steps = [{"step": "common_mode_removal"}, {"step": "spatial_decimation", "params": {"factor": 3}}]
    first = grid(signals.build_pipeline(steps)(sig(spark, x)))
    as_is = grid(signals.build_pipeline(steps, declared_order=True)(sig(spark, x)))
    assert np.allclose(first, x[::3] - np.median(x[::3], 0)) and np.allclose(as_is, (x - np.median(x, 0))[::3])
    with pytest.raises(ValueError):
        signals.build_pipeline([{"step": "nothing"}])


def test_windows(spark):
    w = signals.spatial_windows(sig(spark, np.zeros((50, 2))), 9, 1)
    assert w.select("window").distinct().count() == 42
    t = signals.time_windows(sig(spark, np.zeros((1, 700))), 312, 234)
    assert t.select("t_window").distinct().count() == 2
    trimmed = signals.edge_trim(t, 312, 234)
    assert trimmed.groupBy("t_window").count().collect()[0]["count"] == 234


def win(spark, x):
    return sig(spark, x).select("fiber_id", F.lit(0).alias("window"), F.col("ch").alias("pos"), F.col("t_idx").cast("int").alias("t"), "v")


def test_alignment_undoes_a_shift(spark):
    rng = np.random.default_rng(6)
    base = np.convolve(rng.normal(size=200), np.ones(5) / 5, "same")
    x = np.stack([np.roll(base, 2 * k)[40:140] for k in range(9)])
    w = win(spark, x)
    s = detection.pair_shift(w, 5)
    assert {r["shift"] for r in s.select("shift").distinct().collect()} == {-2.0}
    a = grid(detection.align_shift(w, s), "pos", "t")
    assert np.abs(a[:, 20:80] - a[4, 20:80]).max() < 1e-9


@pytest.mark.parametrize("nch,step", [(4, 1), (5, 3), (12, 1), (13, 1)])
def test_shifts_once_a_pair_are_those_of_the_windows(spark, nch, step):
    x = np.cumsum(np.random.default_rng(8).normal(size=(12, 40)), 1)
    s = sig(spark, x)
    w = signals.spatial_windows(s, nch, step).select("fiber_id", "window", "pos", F.col("t_idx").cast("int").alias("t"), "v")
    shifts, lags = detection.pair_shift(w, 6), detection.pair_lags(s, 6, nch, step)
    told = lambda df, *c: sorted(tuple(round(r[k], 9) if isinstance(r[k], float) else r[k] for k in ("fiber_id", "window", *c)) for r in df.collect())
    assert told(detection.over_time(lags), "pair", "t", "shift") == told(shifts, "pair", "t", "shift")
    assert told(detection.align_windows(s, lags, nch, step), "pos", "t", "v") == told(detection.align_shift(w, shifts, nch), "pos", "t", "v")
    assert (lags.count() > 0) == (nch <= 12)


def test_glrt_margins_and_box(spark):
    x = np.random.default_rng(7).normal(size=(3, 64))
    g = grid(detection.glrt(win(spark, x)), "pair", "t", "g")
    p = x[:-1] * x[1:]
    want = np.zeros_like(p)
    for t in range(25, 39):
        want[:, t] = p[:, t - 10 : t + 10].sum(1)
    assert np.allclose(g, want)


def test_intervals_open_at_both_ends(spark):
    m = [1, 1, 0, 0, 1, 0, 1, 1, 1]
    df = spark.createDataFrame([("f", 0, i, bool(v)) for i, v in enumerate(m)], "fiber_id string, window int, t int, mask boolean")
    assert sorted((r.start_idx, r.end_idx) for r in detection.intervals(df).collect()) == [(0, 2), (4, 5), (6, 9)]


def test_count_caps(spark):
    df = spark.createDataFrame([("f", 0, 50.0, 1.0, 10.0, 5.0), ("f", 0, -3.0, 1.0, 10.0, 5.0), ("f", 0, float("nan"), 9.0, 10.0, 5.0), ("f", 0, 4.0, 9.0, 100.0, 0.0), ("f", 1, 0.0, 9.0, 100.0, 5.0)], "fiber_id string, window int, raw double, lambda_n double, duration double, speed_ms double")
    got = [r["count"] for r in counting.cap_counts(df, 10.0).orderBy("window", "duration", "raw").collect()]
    assert sorted(got) == [0.0, 0.0, 0.0, 0.0, 1.0]


def test_cooldown_is_sequential():
    s = 1_000_000_000
    keep, last = alerts.fold_cooldown([0, 100 * s, 301 * s, 500 * s, 602 * s], 300)
    assert keep == [True, False, True, False, True] and last == 602 * s
    assert alerts.fold_cooldown([0, 1], 0)[0] == [True, True]


def test_incident_opens_and_resolves():
    a = incidents.Anomalies(90.0)
    out = []
    for i in range(200):
        out += [(i, *e[:4]) for e in a.step(i * 0.5, 60, 10.0 if i < 60 else 90.0)]
    kinds = [e[1] for e in out]
    assert kinds[0] == "detected" and kinds[-1] == "resolved" and out[0][2] == 60
    # none within 120 channels of an open one
    b = incidents.Anomalies(90.0)
    ev = [e for i in range(60) for ch in (60, 120) for e in b.step(i * 0.5, ch, 10.0)]
    assert sum(e[0] == "detected" for e in ev) == 1


def test_tracker_follows_two_vehicles():
    t = ordered.Tracker(0)
    ids = set()
    for k in range(50):
        v = 72.0 / 3.6 / 1000 / 5  # channels a millisecond
        ids |= {t.step(k * 100.0, 10 + v * k * 100, 72.0)["id"], t.step(k * 100.0 + 1, 200 + v * k * 100, 72.0)["id"]}
    assert ids == {1, 2}
    assert t.step(20_000.0, 50, 60.0)["id"] == 3


def test_dedup_keeps_the_last(spark):
    ts = dt.datetime(2024, 1, 1, 0, 0, 0)
    rows = [("f", ts + dt.timedelta(milliseconds=m), 1, 0, float(s), s) for s, m in enumerate((10, 90, 110))]
    df = spark.createDataFrame(rows, "fiber_id string, ts timestamp, ch int, direction int, speed double, seq bigint")
    assert sorted(r.speed for r in rollups.dedup_hires(df).collect()) == [1.0, 2.0]


def test_empty_inputs(spark):
    e = spark.createDataFrame([], "fiber_id string, ts timestamp, ts_ns bigint, ch int, direction int, speed double, vehicle_count double, n_cars double, n_trucks double, seq bigint")
    assert rollups.rollup_1m(e, dedup=True).count() == 0
    assert ordered.track_vehicles(e).count() == 0 and incidents.detect_incidents(e, 90.0).count() == 0
    assert filters.validate(e, {"speed": F.col("speed") > 0})[0].count() == 0


