"""Calibration on signals with flat channels, missing values and sections without any statistic."""

import duckdb
import numpy as np
import pandas as pd
import pytest

from fiberlake.operators import calibration
from fiberlake.plans import registry

from test_queries import norm


@pytest.fixture(scope="module")
def odd(tmp_path_factory):
    """Two fibers of 31 and 40 channels; one channel is flat, one has flat stretches, some values are missing."""
    rng = np.random.default_rng(3)
    d = tmp_path_factory.mktemp("odd")
    x = {i: [float(v) for v in rng.normal(size=64).round(3)] for i in [*range(100, 133), *range(200, 240)] if i not in (110, 111)}
    x[105] = [0.1] * 64
    x[220] = [0.1] * 30 + x[220][30:]
    for i, t in ((107, 30), (108, 30), (121, 0), (121, 41), (205, 63), (231, 25)):
        x[i][t] = None
    pd.DataFrame({"vec_id": list(x), "embedding": list(x.values()), "label": [0] * len(x)}).to_parquet(d / "embeddings.parquet")
    return str(d)


@pytest.mark.parametrize("name", ["glrt_corr", "threshold_curve", "coupling_factors"])
def test_flat_channels_and_missing_values(spark, odd, name):
    df = registry.QUERIES[name](spark, odd)
    con = duckdb.connect()
    con.sql(f"create view embeddings as select * from '{odd}/embeddings.parquet'")
    rel = con.sql(registry.ORACLES[name])
    at = [list(rel.columns).index(c) for c in df.columns]
    got = sorted((tuple(norm(v) for v in r) for r in df.collect()), key=repr)
    assert got and got == sorted((tuple(norm(r[i]) for i in at) for r in rel.fetchall()), key=repr)


def test_statistic_by_definition(spark):
    """Every pair of every section by numpy; flat boxes count 0; a group of another width and step than the queries'."""
    x = np.random.default_rng(5).normal(size=(40, 9))
    x[:, 4] = 0.1
    x[10:35, 7] = 2.5
    sig = spark.createDataFrame([("f", 3 * c, t, float(x[t, c])) for t in range(40) for c in range(9)], "fiber_id string, ch int, t_idx int, v double")
    got = {(r.section_idx, r.t): r.g for r in calibration.glrt_corr(sig, 8, 4, 2).collect()}
    assert set(got) == {(s, t) for s in range(3) for t in range(40)}
    for (s, t), g in got.items():
        want = 0.0
        if 8 <= t < 32:
            for c in range(2 * s, 2 * s + 3):
                a, b = x[t - 4 : t + 4, c], x[t - 4 : t + 4, c + 1]
                want += 0.0 if np.ptp(a) == 0 or np.ptp(b) == 0 else np.corrcoef(a, b)[0, 1] ** 2
        assert g == pytest.approx(want, abs=1e-12)


@pytest.mark.parametrize("method", ["MAD", "percentile"])
def test_curve_by_definition(spark, method):
    rng = np.random.default_rng(7)
    v = {(f, s): np.where(rng.random(25) < 0.3, 0.0, rng.random(25)) for f in "ab" for s in range(3)}
    v["b", 1] = np.zeros(25)
    g = spark.createDataFrame([(f, s, t, float(y)) for (f, s), ys in v.items() for t, y in enumerate(ys)], "fiber_id string, section_idx int, t int, g double")
    got = {(r.fiber_id, r.section_idx): (r.threshold, r.baseline, r.noise) for r in calibration.threshold_curve(g, method, 3.0).collect()}
    assert set(got) == set(v) and got["b", 1] == (3.0, 0.0, 1.0)
    for key, ys in v.items():
        if len(ys := ys[ys > 0]):
            med = np.median(ys)
            mad = np.median(np.abs(ys - med))
            assert got[key] == pytest.approx((med + 3 * mad, med, mad) if method == "MAD" else (np.percentile(ys, 98), med, np.std(ys)))


def test_the_statistic_is_computed_once(spark, tmp_path):
    """Medians, deviations and sections without values come from one reading of the statistic."""
    spark.range(40).selectExpr("'f' AS fiber_id", "CAST(id % 2 AS int) AS section_idx", "CAST(id AS int) AS t", "id / 7D AS g").write.parquet(str(tmp_path / "g"))
    g = spark.read.parquet(str(tmp_path / "g"))
    for df in (calibration.threshold_curve(g), calibration.threshold_curve(g, "percentile"), calibration.coupling_factors(g)):
        assert df._jdf.queryExecution().optimizedPlan().toString().count("Relation [") == 1
