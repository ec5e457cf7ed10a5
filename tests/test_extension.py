"""Trailing frames by blocks, quantile sketches, transforms and models, against plain definitions."""

import datetime as dt
import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from fiberlake.functions import scalars as S
from fiberlake.operators import detection, health, monitors, ordered, rollups, signals


def test_trailing_frames_equal_one_pass_over_a_key(spark):
    rng = np.random.default_rng(0)
    rows = [(f, int(t), int(x)) for f in ("a", "b", None) for t, x in zip(rng.permutation(700), rng.integers(0, 50, 700))]
    df = spark.createDataFrame(rows, "f string, t bigint, x bigint").repartition(5)
    for n, block, width in ((1, 50, 100), (7, 7, 10), (50, 60, 1000), (300, 64, 33)):
        out = ordered.trailing(df, ["f"], ["t"], F.floor(F.col("t") / width), n, lambda w, r: {"l": F.collect_list("x").over(w), "r": r}, block)
        assert out.columns == ["f", "t", "x", "l", "r"]
        got = {(r.f, r.t): (list(r.l), r.r) for r in out.collect()}
        assert len(got) == len(rows)
        for f in ("a", "b", None):
            xs = [x for _, x in sorted((t, x) for g, t, x in rows if g == f)]
            assert all(got[f, i] == (xs[max(0, i - n + 1) : i + 1], i) for i in range(700))
    assert ordered.trailing(df.limit(0), ["f"], ["t"], F.col("t"), 3, lambda w, r: {"r": r}).count() == 0


def test_delays_trends_and_smooth_counts_with_hot_keys(spark):
    rng = np.random.default_rng(1)
    late = rng.integers(-100, 4000, 900)
    df = spark.createDataFrame([("hot", 1000 * i, 1000 * i + int(d)) for i, d in enumerate(late)], "fiber_id string, ts_ms bigint, arrival_ms bigint")
    seen = sorted((1000 * i + int(d), 1000 * i, int(d)) for i, d in enumerate(late) if d >= 0)
    want = {}
    for i, (_, ts, _) in enumerate(seen):
        last = sorted(d for _, _, d in seen[max(0, i - 49) : i + 1])
        want[ts] = last[min(int(len(last) * 0.9), len(last) - 1)] + 15_000.0
    got = ordered.delay_estimate(df, cell_ms=60_000)
    assert {r.ts_ms: r.delay_ms for r in got.collect()} == want and got.columns == [*df.columns, "delay_ms"]

    at = [dt.datetime(2024, 1, 1) + dt.timedelta(hours=i) for i in range(400)]
    freq = rng.normal(1.1, 0.05, 400)
    t = health.shm_trend_sliding(spark.createDataFrame([("bridge", a, float(f)) for a, f in zip(at, freq)], "infra_id string, ts timestamp, freq double"), 30)
    got = {r.ts: r for r in t.collect()}
    for i in (0, 1, 29, 30, 250, 399):
        y = freq[max(0, i - 29) : i + 1]
        slope = np.polyfit(np.arange(len(y)), y, 1)[0] * 3600 if len(y) > 1 else 0.0
        assert got[at[i]].slope_hz_h == pytest.approx(slope, abs=1e-6) and got[at[i]].n == len(y)

    counts = spark.createDataFrame([("k", i, int(c)) for i, c in enumerate(rng.integers(0, 9, 200))], "k string, seq bigint, vehicle_count int")
    plain, dealt = (ordered.smooth_counts(counts, ["k"], "seq", 5, c) for c in (None, F.floor(F.col("seq") / 20)))
    assert sorted(plain.collect()) == sorted(dealt.collect())


def test_hot_key_is_many_tasks(spark):
    df = spark.range(0, 60_000, 1, 4).select(F.concat(F.lit("hot"), (F.col("id") % 1).cast("string")).alias("f"), F.col("id").alias("t"))
    before = spark.conf.get("spark.sql.adaptive.enabled"), spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        out = ordered.trailing(df, ["f"], ["t"], F.floor(F.col("t") / 5000), 50, lambda w, r: {"n": F.count("t").over(w)}, 5000)
        rows = out.select("n", F.spark_partition_id().alias("p")).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before[0])
        spark.conf.set("spark.sql.shuffle.partitions", before[1])
    assert len({r.p for r in rows}) >= 4 and len(rows) == 60_000


def rank_off(xs, q, p):
    xs = np.asarray(xs)
    lo, hi = (xs < q).mean(), (xs <= q).mean()
    return max(lo - p, p - hi, 0.0)


def test_sketches_keep_their_bound_over_merges(spark):
    rng = np.random.default_rng(2)
    n, start = 40_000, dt.datetime(2024, 1, 1)
    speed = np.where(rng.random(n) < 0.5, rng.normal(90, 10, n), rng.normal(30, 5, n))
    pdf = pd.DataFrame({"fiber_id": np.where(np.arange(n) % 3 == 0, "a", "b"), "direction": 0, "ts": [start + dt.timedelta(seconds=int(s)) for s in rng.integers(0, 4 * 3600, n)], "speed": speed})
    df = spark.createDataFrame(pdf).repartition(6)
    tier = rollups.quantiles_1h(rollups.quantiles_1m(df))
    got = tier.select("fiber_id", "ts", *[rollups.quantile_of("sketch", p).alias(f"p{int(p * 100)}") for p in (0.05, 0.5, 0.95)]).collect()
    assert len(got) == 8
    for r in got:
        xs = pdf[(pdf.fiber_id == r.fiber_id) & (pdf.ts >= r.ts) & (pdf.ts < r.ts + dt.timedelta(hours=1))].speed
        assert all(rank_off(xs, r[f"p{int(p * 100)}"], p) < 0.015 for p in (0.05, 0.5, 0.95))
    top = rollups.merge_quantiles(tier, ["fiber_id"]).select("fiber_id", rollups.quantile_of("sketch", 0.9).alias("q"))
    assert all(rank_off(pdf[pdf.fiber_id == r.fiber_id].speed, r.q, 0.9) < 0.015 for r in top.collect())

    a = {(r.fiber_id, r.sec): r for r in monitors.speed_shift(df).collect()}
    b = {(r.fiber_id, r.sec): r for r in monitors.speed_shift(df, exact=True).collect()}
    assert a.keys() == b.keys() and len(a) == 32
    base = int(start.replace(tzinfo=dt.timezone.utc).timestamp())
    sec = base + (pdf.ts - start).dt.total_seconds()
    for (f, end), r in a.items():
        mine = (pdf.fiber_id == f) & (sec < end)
        assert rank_off(pdf[mine & (sec >= end - 900)].speed, r.short, 0.5) < 0.015
        assert rank_off(pdf[mine & (sec >= end - 7200)].speed, r.long, 0.5) < 0.015
    marks = signals.waterfall_marks(df.withColumn("ch", F.lit(1)), 10.0).groupBy("fiber_id").agg(F.min("colour").alias("lo"), F.max("colour").alias("hi"))
    for r in marks.collect():
        xs = pdf[pdf.fiber_id == r.fiber_id].speed
        assert rank_off(xs, r.lo, 0.02) < 0.01 and rank_off(xs, r.hi, 0.98) < 0.01
    stages = monitors.stage_percentiles(df.select("fiber_id", F.lit("s").alias("stage"), F.col("speed").alias("ms"))).collect()
    assert all(rank_off(pdf[pdf.fiber_id == r.fiber_id].speed, r.p95, 0.95) < 0.015 for r in stages)


def test_sketches_of_nothing(spark):
    df = spark.createDataFrame([("a", None), ("a", float("nan")), ("b", 2.0), ("b", None)], "k string, speed double")
    got = {r.k: r.q for r in rollups.quantile_states(df, ["k"]).select("k", rollups.quantile_of("sketch", 0.5).alias("q")).collect()}
    assert got == {"a": None, "b": 2.0}
    assert rollups.quantile_states(df.limit(0), ["k"]).count() == 0


def test_models_by_hint_need_no_group(spark):
    df = spark.createDataFrame([(i, None if i % 5 == 0 else f"m{i % 3}", float(i)) for i in range(300)], "id bigint, hint string, x double")

    def load(hint):
        return {"m0": lambda p: p.assign(y=p.x * 2), "m1": lambda p: p.assign(y=p.x + 1)}.get(hint)

    out = detection.score_by_model(df, "hint", load, "id bigint, hint string, x double, y double", lambda p: p.assign(y=-p.x), tasks=6)
    assert "Exchange hashpartitioning(hint" not in out._jdf.queryExecution().toString()
    want = {i: {"m0": 2.0 * i, "m1": i + 1.0}.get(None if i % 5 == 0 else f"m{i % 3}", -float(i)) for i in range(300)}
    assert {r.id: r.y for r in out.collect()} == want
    with pytest.raises(Exception, match="no model for hint"):
        detection.score_by_model(df, "hint", {"m0": lambda p: p}, "id bigint, hint string, x double").collect()


def test_records_that_fail_are_told(spark):
    def inverse(batches):
        for pdf in batches:
            if (pdf["x"] == 0).any():
                raise ZeroDivisionError("x is 0")
            yield pd.concat([pdf.assign(y=1 / pdf["x"]), pdf.assign(y=-1 / pdf["x"])])

    df = spark.range(200).select("id", (F.col("id") % 40).cast("double").alias("x"))
    rows = signals.map_records(df, inverse, "id bigint, x double, y double", tag_errors=True).collect()
    bad = [r for r in rows if r._error]
    assert len(rows) == 2 * 195 + 5 and all(r._error == "ZeroDivisionError: x is 0" and r.y is None for r in bad)
    assert sorted(json.loads(r._record)["id"] for r in bad) == [0, 40, 80, 120, 160]
    with pytest.raises(Exception, match="x is 0"):
        signals.map_records(df, inverse, "id bigint, x double, y double").collect()


def test_windows_are_whole_and_in_order(spark):
    rng = np.random.default_rng(3)
    rows = [(None if w == 0 else f"w{w}", int(t), w * 1000 + int(t)) for w in range(40) for t in rng.permutation(int(rng.integers(1, 60)))]
    df = spark.createDataFrame(rows, "w string, t bigint, v bigint").repartition(7)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "16")  # windows go over several batches
    try:
        first = lambda p: pd.DataFrame({"w": [p.w.iloc[0]], "n": [len(p)], "sorted": [bool(p.t.is_monotonic_increasing)]})
        got = {r.w: (r.n, r.sorted) for r in signals.map_windows(df, ["w"], first, "w string, n bigint, sorted boolean", ["t"]).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    sizes = pd.Series([r[0] or "null" for r in rows]).value_counts()
    assert len(got) == 40 and all(got[None if k == "null" else k] == (n, True) for k, n in sizes.items())
    assert signals.map_windows(df.limit(0), ["w"], first, "w string, n bigint, sorted boolean").count() == 0


def test_json_round_trip(spark):
    rows = [(1, "a \"quoted\" é", 2.5, [1, 2]), (2, None, None, None), (None, "", 0.0, [])]
    df = spark.createDataFrame(rows, "id bigint, s string, x double, l array<int>")
    back = df.select(S.json_out("id", "s", "x", "l").alias("j")).select(S.json_in(F.col("j"), "id bigint, s string, x double, l array<int>").alias("r")).select("r.*")
    assert {tuple(map(repr, r)) for r in back.collect()} == {tuple(map(repr, r)) for r in rows}
    odd = spark.createDataFrame([("not json",), ("{\"id\": \"x\"}",), (None,)], "j string").select(S.json_in(F.col("j"), "id bigint").alias("r"))
    assert all(r.r is None or r.r["id"] is None for r in odd.collect())
