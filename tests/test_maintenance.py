"""Stored tiers: late rows, retention and compaction on files."""

import datetime as dt
import os

import numpy as np
from pyspark.sql import functions as F

from fiberlake.operators import rollups
from fiberlake.sources import maintenance, sinks

DET = "fiber_id string, ts timestamp, ch int, direction int, speed double, vehicle_count double, n_cars double, n_trucks double, seq bigint"
T0 = dt.datetime(2024, 1, 30, tzinfo=dt.timezone.utc)


def detections(spark, n=600):
    rng = np.random.default_rng(1)
    rows = [(f"f/{i % 3}", T0 + dt.timedelta(seconds=int(rng.integers(0, 4 * 86400))), int(rng.integers(0, 5)), 0, float(rng.integers(1, 90)) if i % 11 else None, 1.0, 1.0, 0.0, i) for i in range(n)]
    return spark.createDataFrame(rows, DET)


def files(path):
    out = {}
    for at, _, names in os.walk(path):
        for n in names:
            if n.endswith(".parquet"):
                out[os.path.relpath(os.path.join(at, n), path)] = os.stat(os.path.join(at, n)).st_mtime_ns
    return out


def rows(df):
    return sorted((tuple(r[c] for c in sorted(df.columns)) for r in df.collect()), key=repr)


def stored(spark, path, tier):
    return spark.read.parquet(f"{path}/{tier}").drop("date")


def test_late_rows_mend_only_what_they_touch(spark, tmp_path):
    path, d = str(tmp_path), detections(spark)
    late = d.filter("fiber_id = 'f/1' and seq % 20 = 1 and to_date(ts) = '2024-01-31'")
    new = detections(spark, 1).withColumn("fiber_id", F.lit("f/new")).withColumn("ts", F.lit(T0))  # a fiber that no tier has
    in_time = d.join(late.select("seq"), "seq", "leftanti").select(*d.columns)
    m = rollups.rollup_1m(in_time)
    for tier, x in (("hires", in_time), ("1m", m), ("1h", rollups.rollup_1h(m))):
        sinks.write_tier(x, tier, path)
    before = files(path)
    maintenance.store_late(late.unionByName(new), path, 7)
    for _ in range(2):  # a replay changes nothing
        maintenance.store_late(late.unionByName(new), path, 7)
        maintenance.correct_tiers(spark, path, d.schema, 7)
        every = rollups.rollup_1m(d.unionByName(new))
        assert rows(stored(spark, path, "1m").select(*every.columns)) == rows(every)
        assert rows(stored(spark, path, "1h").select(*every.columns)) == rows(rollups.rollup_1h(every))
    after = files(path)
    changed = {f.rsplit("/", 1)[0] for f, t in before.items() if after.get(f) != t}
    assert changed == {"1m/fiber_id=f%2F1/date=2024-01-31", "1h/fiber_id=f%2F1/date=2024-01-01"}
    assert not [f for f in after if f.startswith("_aside")]


def test_split_late(spark):
    d = detections(spark, 50)
    sealed = T0 + dt.timedelta(days=1)
    a, b = maintenance.split_late(d, sealed)
    assert a.count() + b.count() == 50 and a.filter(F.col("ts") < F.lit(sealed)).count() == 0 and b.count() > 0


def test_old_partitions_go_and_the_edge_is_rewritten(spark, tmp_path):
    path, d = str(tmp_path), detections(spark)
    sinks.write_tier(d, "hires", path)
    before = files(path)
    now = T0 + dt.timedelta(days=3, hours=12)  # hires keeps 48 hours: the edge cuts the second day
    done = maintenance.expire(spark, path, "hires", now)
    assert done == {"dropped": 3, "rewritten": 3}
    assert rows(stored(spark, path, "hires").select(*d.columns)) == rows(sinks.apply_retention(d, "hires", now))
    after = files(path)
    assert {f for f in before if "date=2024-02" in f} == {f for f in after if "date=2024-02" in f and after[f] == before.get(f)}
    assert maintenance.expire(spark, path, "hires", now) == {"dropped": 0, "rewritten": 0}
    assert maintenance.expire(spark, path, "1h", now) == {"dropped": 0, "rewritten": 0}


def test_small_files_become_few(spark, tmp_path):
    path, d = str(tmp_path), detections(spark)
    for k in range(6):
        sinks.write_tier(d.filter(F.floor(F.col("seq") / 100) == k), "hires", path)
    many = maintenance.partitions(spark, path, "hires")
    assert {p[0] for p in many} == {"f/0", "f/1", "f/2"}
    poor = sum(p[3] > 4 for p in many)
    assert poor > 0 and maintenance.compact(spark, path, "hires") == poor
    assert rows(stored(spark, path, "hires").select(*d.columns)) == rows(d)
    assert all(p[3] <= 4 for p in maintenance.partitions(spark, path, "hires"))
    assert maintenance.compact(spark, path, "hires") == 0


def test_a_hot_day_is_several_files_in_order(spark, tmp_path):
    path = str(tmp_path)
    d = spark.range(20_000).select(F.lit("f").alias("fiber_id"), F.timestamp_seconds(F.lit(1_704_067_200) + F.col("id")).alias("ts"), F.lit(0).alias("ch"), F.lit(0).alias("direction"))
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # as with partitions of full size
    try:
        sinks.write_tier(d, "hires", path)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    spans = sorted((r.a, r.b) for r in spark.read.parquet(f"{path}/hires").groupBy(F.input_file_name()).agg(F.min("ts").alias("a"), F.max("ts").alias("b")).collect())
    assert len(spans) > 1 and all(b < a for (_, b), (a, _) in zip(spans, spans[1:]))


def test_incidents_by_id(spark, tmp_path):
    inc = spark.range(500).select(F.concat(F.lit("inc-"), "id").alias("incident_id"), F.timestamp_seconds(F.lit(1_704_067_200) + F.col("id") * 86400).alias("timestamp"))
    maintenance.write_incidents(inc, str(tmp_path / "i"))
    got = spark.read.parquet(str(tmp_path / "i")).filter("incident_id = 'inc-77'").collect()
    assert len(got) == 1 and len([f for f in files(tmp_path / "i")]) >= 17
