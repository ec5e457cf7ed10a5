"""Incidents and actions of every order, against the registered SQL."""

import duckdb
import pytest

from fiberlake.plans import registry
from fiberlake.plans.adapters import Views

from test_queries import norm


@pytest.mark.parametrize("name", ["incident_window", "incident_snapshot", "incident_snapshot_norm", "workflow_check", "workflow_status"])
def test_every_order(spark, sf, name):
    con = duckdb.connect()
    for t in ("orders", "lineitem", "events"):
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    rel = con.sql(registry.ORACLES[name])
    cols = sorted(rel.columns)
    at = [list(rel.columns).index(c) for c in cols]
    want = sorted((tuple(norm(r[i]) for i in at) for r in rel.fetchall()), key=repr)
    got = sorted((tuple(norm(r[c]) for c in cols) for r in registry.QUERIES[name](spark, sf).collect()), key=repr)
    assert got == want


def test_views_have_every_order(spark, sf):
    v = Views(spark, sf)
    n = v.table("orders").count()
    assert v.live_incidents().count() == n
    assert v.actions().count() == 3 * n
