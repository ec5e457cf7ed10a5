"""Alert rules over detections and incidents, with cooldown."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from .filters import in_scope
from .ordered import fold_sorted


def _owned(rules: DataFrame, assign: DataFrame, kind: str) -> DataFrame:
    """Active rules of a kind with each fiber of their org."""
    r = rules.filter((F.col("rule_type") == kind) & F.col("is_active"))
    return r.join(assign.withColumnRenamed("fiber_id", "_fiber"), "org").select("rule_id", "_fiber", "fibers", F.col("channel_start").alias("_lo"), F.col("channel_end").alias("_hi"), "threshold", "types", "severities", "cooldown_s")


def eval_detection_rules(det: DataFrame, rules: DataFrame, assign: DataFrame) -> DataFrame:
    """(rule, detection) pairs that fire: speed below the threshold, in scope, of the owner's fibers."""
    r = _owned(rules, assign, "speed_below")
    hit = (F.col("fiber_id") == F.col("_fiber")) & (F.col("speed") < F.col("threshold")) & in_scope(F.col("fibers"), F.col("_lo"), F.col("_hi"), F.col("fiber_id"), F.col("ch"))
    rows = det.join(r, hit)
    return rows.select("rule_id", "fiber_id", "ch", "ts_ns", "speed", S.speed_reason(F.col("speed"), F.col("threshold")).alias("detail"), "cooldown_s")


def eval_incident_rules(inc: DataFrame, rules: DataFrame, assign: DataFrame) -> DataFrame:
    r = _owned(rules, assign, "incident_type")
    none = lambda c: F.coalesce(F.size(c), F.lit(0)) <= 0
    ch = F.col("channel_start")
    hit = (F.col("fiber_id") == F.col("_fiber")) & in_scope(F.col("fibers"), F.col("_lo"), F.col("_hi"), F.col("fiber_id"), ch)
    hit = hit & (none("types") | F.array_contains("types", F.col("incident_type"))) & (none("severities") | F.array_contains("severities", F.col("severity")))
    rows = inc.join(r, hit)
    return rows.select("rule_id", "incident_id", "fiber_id", ch.alias("ch"), (F.unix_micros("timestamp") * 1000).alias("ts_ns"), S.incident_reason(F.col("incident_id"), F.col("incident_type"), F.col("severity")).alias("detail"), "cooldown_s")


def fold_cooldown(times, cooldown_s: float, last: int | None = None):
    """Which of the ordered times are dispatched; each dispatch starts the cooldown again."""
    out = []
    for t in times:
        go = cooldown_s <= 0 or last is None or t - last > cooldown_s * 1_000_000_000
        out.append(go)
        last = t if go else last
    return out, last


def apply_cooldown(alerts: DataFrame, log: DataFrame | None = None) -> DataFrame:
    """Alerts that are dispatched: by rule, fiber and channel, in order of time.

    The fold is sequential within a key; tasks pass once over sorted rows. ``log`` holds
    dispatches (rule_id, fiber_id, ch, ts_ns) of before.
    """
    keys = ["rule_id", "fiber_id", "ch"]
    rows = alerts
    if log is not None:
        rows = rows.join(log.groupBy(*keys).agg(F.max("ts_ns").alias("_last")), keys, "left")
    else:
        rows = rows.withColumn("_last", F.lit(None).cast("bigint"))

    names = alerts.columns

    def fold(batches):
        now, last = None, None
        for batch in batches:
            keep = []
            cols = (batch.column(c).to_pylist() for c in ("ts_ns", "cooldown_s", "_last"))
            for k, t, cool, before in zip(zip(*(batch.column(c).to_pylist() for c in keys)), *cols):
                if k != now:
                    now, last = k, before
                (go,), last = fold_cooldown((t,), cool or 0, last)
                keep.append(go)
            yield batch.select(names).filter(pa.array(keep, pa.bool_()))

    return fold_sorted(rows, keys, ["ts_ns", "detail"], fold, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in alerts.schema.fields))
