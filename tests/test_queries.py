"""Every registered query against its SQL on the small tables."""

import math
import os

import duckdb
import numpy as np
import pytest

from fiberlake.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def norm(x):
    if isinstance(x, (float, np.floating)):
        return None if math.isnan(x) else float(f"{x + 0.0:.8g}")
    if isinstance(x, (list, tuple, np.ndarray)):
        return tuple(norm(y) for y in x)
    if isinstance(x, dict):
        return tuple(norm(v) for v in x.values())
    return x


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf}/{t}.parquet"):
            c.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_matches_sql(spark, sf, con, name):
    df = registry.QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    got = sorted((tuple(norm(r[c]) for c in cols) for r in df.collect()), key=repr)
    rel = con.sql(registry.ORACLES[name])
    assert sorted(rel.columns) == cols
    at = [list(rel.columns).index(c) for c in cols]
    want = sorted((tuple(norm(r[i]) for i in at) for r in rel.fetchall()), key=repr)
    assert got == want


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))  # their rows: test_by_hand.py
def test_runs(spark, sf, name):
    assert registry.QUERIES[name](spark, sf).count() > 0
