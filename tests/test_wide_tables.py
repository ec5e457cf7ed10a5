"""Queries against their SQL on events of more channels, and more of them a day, than the small tables have."""

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from fiberlake.operators import health, ordered
from fiberlake.plans import registry

from test_queries import norm

T0 = pd.Timestamp("2024-01-01")


@pytest.fixture(scope="module")
def wide(tmp_path_factory):
    """12 000 events of one structure on one day, on 1 500 channels; every tenth is another's, two have each time."""
    n = range(12_000)
    d = tmp_path_factory.mktemp("wide")
    events = pd.DataFrame({
        "event_id": n, "ts": [T0 + pd.Timedelta(seconds=7 * (i // 2)) for i in n], "user_id": [i * 7919 % 1500 for i in n],
        "event_type": ["view" if i % 10 == 9 else "click" for i in n], "value": [float(i * 31 % 1000) / 10 for i in n], "props": ["{}"] * len(n),
    })
    events["ts"] = events.ts.astype("datetime64[us]")
    events.to_parquet(d / "events.parquet")
    return str(d)


def both(spark, path, name):
    df = registry.QUERIES[name](spark, path)
    cols = sorted(df.columns)
    con = duckdb.connect()
    con.sql(f"create view events as select * from '{path}/events.parquet'")
    rel = con.sql(registry.ORACLES[name])
    at = [list(rel.columns).index(c) for c in cols]
    want = sorted((tuple(norm(r[i]) for i in at) for r in rel.fetchall()), key=repr)
    return sorted((tuple(norm(r[c]) for c in cols) for r in df.collect()), key=repr), want


def test_channels_of_no_section_have_the_fibers_thresholds(spark, wide):
    got, want = both(spark, wide, "lookup_thresholds")
    assert got == want and {r[0] for r in got} == {70.0, 80.0, 81.0, 82.0}


def test_a_days_peaks_are_whole(spark, wide):
    """The reference thins peaks only if it is asked to; the day itself bounds them."""
    got, want = both(spark, wide, "peaks_query")
    assert got == want and len(got) == 12_000


def test_thinned_peaks_do_not_depend_on_the_order_of_rows(spark, wide):
    e = spark.read.parquet(f"{wide}/events.parquet").select(F.col("event_type").alias("infra_id"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("freq"))
    found = [sorted(map(tuple, health.peaks_query(x.coalesce(1), most=1000).collect())) for x in (e.orderBy("freq"), e.orderBy(F.desc("freq")))]
    assert found[0] == found[1] and len(found[0]) == 2000


def test_barrier_with_more_sections_than_are_configured(spark, wide):
    got, want = both(spark, wide, "section_barrier")
    assert got == want and len(got) > 1


def test_a_section_that_is_not_configured_does_not_stand_for_another(spark):
    w = spark.createDataFrame([("f", 0, "a"), ("f", 0, "x"), ("f", 1, "a"), ("f", 1, "b"), ("f", 1, "x"), ("g", 0, "a")], "fiber_id string, window bigint, section string")
    cfg = spark.createDataFrame([("f", "a"), ("f", "b"), ("f", "b")], "fiber_id string, section string")
    assert [tuple(r) for r in ordered.section_barrier(w, cfg).collect()] == [("f", 1)]
