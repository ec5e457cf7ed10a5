"""Latest versions, dedup and the rollup tiers with mergeable states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scalars as S

KEYS = ["fiber_id", "ts", "ch", "direction"]


def latest(df: DataFrame, keys: list[str], version: str, ties: list[str] | None = None) -> DataFrame:
    """One row a key: that of the highest version, and among those of the greatest ties, in their order; nulls are lowest.

    An aggregate with partial combination, not a window: a hot key leaves each task once.
    """
    rest = [c for c in df.columns if c not in keys]
    row = F.max_by(F.struct(*[F.col(f"`{c}`") for c in rest]), F.struct(version, *(ties or [])))
    return df.groupBy(*keys).agg(row.alias("_row")).select(*[F.col(c) if c in keys else F.col(f"_row.`{c}`").alias(c) for c in df.columns])


def dedup_hires(df: DataFrame, seq: str = "seq") -> DataFrame:
    """The last insert of each (fiber, 100 ms, channel, direction).

    An aggregate with partial combination, not a window: a hot key leaves each task once.
    """
    rows = df.withColumn("ts", S.trunc_interval(F.col("ts"), 0.1))
    rest = [c for c in rows.columns if c not in KEYS]
    out = rows.groupBy(*KEYS).agg(F.max_by(F.struct(*rest), F.col(seq)).alias("r"))
    return out.select(*KEYS, *[F.col(f"r.{c}").alias(c) for c in rest]).select(*rows.columns)


def state_agg(df: DataFrame, keys: list[str | Column]) -> DataFrame:
    """Mergeable states of raw detections."""
    return df.groupBy(*keys).agg(
        F.max("speed").alias("speed_max"), F.sum("speed").alias("speed_sum"), F.count("speed").alias("speed_n"), F.min("speed").alias("speed_min"),
        F.sum("vehicle_count").alias("count_sum"), F.sum("n_cars").alias("cars_sum"), F.sum("n_trucks").alias("trucks_sum"), F.count(F.lit(1)).alias("samples"),
    )


def merge_states(df: DataFrame, keys: list[str | Column]) -> DataFrame:
    """States of states: maxima of maxima, sums of sums."""
    return df.groupBy(*keys).agg(
        F.max("speed_max").alias("speed_max"), F.sum("speed_sum").alias("speed_sum"), F.sum("speed_n").alias("speed_n"), F.min("speed_min").alias("speed_min"),
        F.sum("count_sum").alias("count_sum"), F.sum("cars_sum").alias("cars_sum"), F.sum("trucks_sum").alias("trucks_sum"), F.sum("samples").alias("samples"),
    )


def rollup_1m(hires: DataFrame, dedup: bool = False, seq: str = "seq") -> DataFrame:
    rows = dedup_hires(hires, seq) if dedup else hires
    return state_agg(rows.withColumn("ts", F.date_trunc("minute", "ts")), KEYS)


def rollup_1h(tier_1m: DataFrame) -> DataFrame:
    return merge_states(tier_1m.withColumn("ts", F.date_trunc("hour", "ts")), KEYS)


def finalize(tier: DataFrame, by: list[str | Column]) -> DataFrame:
    """Values of merged states."""
    m = merge_states(tier, by)
    names = [c for c in m.columns if c not in ("speed_max", "speed_sum", "speed_n", "speed_min", "count_sum", "cars_sum", "trucks_sum", "samples")]
    return m.select(*names, (F.col("speed_sum") / F.nullif("speed_n", F.lit(0))).alias("speed_avg"), "speed_min", "speed_max", F.col("count_sum").alias("vehicles"), F.col("cars_sum").alias("cars"), F.col("trucks_sum").alias("trucks"), "samples")


def quantile_states(df: DataFrame, keys: list[str | Column], value: str = "speed", k: int = 800) -> DataFrame:
    """A quantile sketch of each key's values as column ``sketch``, which merges as the other states do.

    Its size is bounded by ``k`` (some kB), whatever the number of rows; a quantile's rank is off
    by about 2.3 / k of the rows, and exact up to ``k`` rows. Nulls and NaN do not count.
    """
    x = F.col(value).cast("double")
    return df.groupBy(*keys).agg(F.kll_sketch_agg_double(F.when(~F.isnan(x), x), k).alias("sketch"))


def merge_quantiles(tier: DataFrame, keys: list[str | Column], k: int = 800) -> DataFrame:
    """Sketches of sketches: hours of minutes, ranges of hours."""
    return tier.groupBy(*keys).agg(F.kll_merge_agg_double("sketch", k).alias("sketch"))


def quantile_of(sketch: str, p: float) -> Column:
    """The quantile of a sketch, null if it holds no value."""
    return F.when(F.kll_sketch_get_n_double(sketch) > 0, F.kll_sketch_get_quantile_double(sketch, F.lit(float(p))))


def quantiles_1m(hires: DataFrame, keys: tuple[str, ...] = ("fiber_id", "direction"), k: int = 800) -> DataFrame:
    """The minute tier of speed sketches."""
    return quantile_states(hires.withColumn("ts", F.date_trunc("minute", "ts")), [*keys, "ts"], "speed", k)


def quantiles_1h(tier_1m: DataFrame, keys: tuple[str, ...] = ("fiber_id", "direction"), k: int = 800) -> DataFrame:
    """The hour tier, from the minute tier."""
    return merge_quantiles(tier_1m.withColumn("ts", F.date_trunc("hour", "ts")), [*keys, "ts"], k)


def two_level_rollup(det: DataFrame) -> DataFrame:
    """Per minute: mean of the second means, maximum, sum."""
    sec = det.groupBy("fiber_id", "ch", "direction", F.date_trunc("second", "ts").alias("s")).agg(F.avg("speed").alias("a"), F.max("speed").alias("m"), F.sum("vehicle_count").alias("n"))
    return sec.groupBy("fiber_id", "ch", "direction", F.date_trunc("minute", "s").alias("ts")).agg(F.avg("a").alias("speed_avg"), F.max("m").alias("speed_max"), F.sum("n").alias("vehicles"))


def merge_channels(buckets: DataFrame, lo: int, hi: int, bucket_s: int) -> DataFrame:
    """A section's buckets: mean of the channels' means, greatest maximum, flow over all its channels, occupancy."""
    n = max(1, hi - lo + 1)
    rows = buckets.filter(F.col("ch").between(lo, hi)).groupBy("fiber_id", "direction", "ts").agg(F.avg("speed_avg").alias("speed"), F.max("speed_max").alias("speed_max"), F.sum("vehicles").alias("vehicles"))
    rows = rows.withColumn("flow", F.bround(F.col("vehicles") / n * (3600 / bucket_s)))
    return rows.withColumn("occupancy", S.occupancy(F.col("speed"), F.col("flow")))
