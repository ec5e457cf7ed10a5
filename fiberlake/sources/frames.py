"""Raw and processed frames, detection batches, dead letters.

Every function works on batch and streaming DataFrames alike unless it says otherwise.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas
from ..functions import scalars as S

def read_raw_frames(spark: SparkSession, source: str, streaming: bool = False, fmt: str = "json", servers: str | None = None) -> DataFrame:
    """Frames from files (``fmt``) or, with ``servers``, from all topics matching ``source``.

    The fiber is the last part of the topic; ``floatData`` wins over ``longData``;
    empty frames go.
    """
    if servers:
        reader = (spark.readStream if streaming else spark.read).format("kafka").option("kafka.bootstrap.servers", servers).option("subscribePattern", source)
        rows = reader.load().select("topic", F.from_json(F.col("value").cast("string"), schemas.RAW_FRAME).alias("r"), "offset")
        rows = rows.select("topic", "r.ts_ns", "r.floatData", "r.longData", F.col("offset").alias("frame_seq"))
    else:
        reader = (spark.readStream if streaming else spark.read).schema(schemas.RAW_FRAME + ", frame_seq bigint")
        rows = reader.format(fmt).load(source)
    return normalize_frames(rows)


def normalize_frames(rows: DataFrame) -> DataFrame:
    values = F.coalesce(F.when(F.size("floatData") > 0, F.col("floatData").cast("array<double>")), F.col("longData").cast("array<double>"))
    out = rows.select(F.element_at(F.split("topic", r"\."), -1).alias("fiber_id"), "frame_seq", "ts_ns", values.alias("values"))
    return out.filter(F.size("values") > 0)


def good_shape(n: Column) -> Column:
    return (n > 0) & (F.pmod(F.size("values"), n) == 0)


def assign_sample_ts(df: DataFrame, fs: Column, index: Column, base: str = "ts_ns", fallback: Column | None = None) -> DataFrame:
    """``ts_ns`` of each sample: the base plus its index times whole nanoseconds; a base <= 0 falls back."""
    start = F.when(F.col(base) > 0, F.col(base)).otherwise(fallback if fallback is not None else F.lit(0).cast("bigint"))
    return df.withColumn("ts_ns", start + index * S.sample_ns(fs))


def explode_frames(frames: DataFrame, params: DataFrame, start: int = 0, stop: int | None = None, factor: int = 1) -> DataFrame:
    """Frames to long rows (fiber_id, frame_seq, sample, ch, ts_ns, v).

    Frames whose length is no multiple of the fiber's channels go (see ``with_dlq``).
    A channel range and step are applied inside the explode, so other channels never
    become rows.
    """
    known = known_fibers(frames, params).join(F.broadcast(params.select("fiber_id", "n_channels", "rate")), "fiber_id")
    rows = known.filter(good_shape(F.col("n_channels"))).select("fiber_id", "frame_seq", "ts_ns", "n_channels", "rate", F.posexplode("values").alias("pos", "v"))
    rows = rows.withColumn("sample", F.floor(F.col("pos") / F.col("n_channels")).cast("int")).withColumn("ch", (F.col("pos") % F.col("n_channels")).cast("int"))
    keep = (F.col("ch") >= start) & ((F.col("ch") - start) % factor == 0)
    if stop is not None:
        keep = keep & (F.col("ch") < stop)
    rows = assign_sample_ts(rows.filter(keep), F.col("rate"), F.col("sample"))
    return rows.select("fiber_id", "frame_seq", "sample", "ch", "ts_ns", "v")


def known_fibers(df: DataFrame, params: DataFrame) -> DataFrame:
    """Only rows of fibers with channels and a rate."""
    ready = params.filter("n_channels > 0 and rate > 0").select("fiber_id")
    return df.join(F.broadcast(ready), "fiber_id", "leftsemi")


@F.pandas_udf(T.BinaryType())
def to_float32(values):
    """Arrays of numbers to little-endian float32 bytes."""
    return values.map(lambda v: None if v is None else np.asarray(v, "<f4").tobytes())


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def from_float32(values):
    """Little-endian float32 bytes to numbers; null where the length is no multiple of 4."""
    return values.map(lambda b: None if b is None or len(b) % 4 else np.frombuffer(b, "<f4").astype(np.float64))


def signal_stats(sig: DataFrame, *by: str) -> DataFrame:
    return sig.groupBy(*by).agg(F.min("v").alias("min"), F.max("v").alias("max"), F.avg("v").alias("mean"), F.sqrt(F.avg(F.col("v") * F.col("v"))).alias("rms"))


def encode_processed(sig: DataFrame, section: str, rate: Column) -> DataFrame:
    """Long rows to one record a frame: float32 bytes, channel range, rate and statistics."""
    rows = sig.groupBy("fiber_id", "frame_seq").agg(
        F.sort_array(F.collect_list(F.struct("sample", "ch", "v"))).alias("c"), F.min("ts_ns").alias("ts_ns"), F.min("ch").alias("channel_start"),
        F.countDistinct("ch").cast("int").alias("channel_count"), F.countDistinct("sample").cast("int").alias("n_samples"),
        F.min("v").alias("min"), F.max("v").alias("max"), F.avg("v").alias("mean"), F.sqrt(F.avg(F.col("v") * F.col("v"))).alias("rms"),
    )
    return rows.select("fiber_id", F.lit(section).alias("section"), "frame_seq", "ts_ns", to_float32(F.transform("c", lambda x: x["v"])).alias("values"), "n_samples", "channel_start", "channel_count", rate.alias("sampling_rate_hz"), F.struct("min", "max", "mean", "rms").alias("stats"))


def decode_processed(df: DataFrame, expected_rate: float, tolerance: float = 0.1) -> tuple[DataFrame, DataFrame]:
    """(long rows, rejected): rejects wrong byte counts and rates off by more than the tolerance."""
    rows = df.withColumn("v", from_float32("values")).withColumn(
        "error",
        F.when(F.col("v").isNull() | (F.size("v") != F.col("n_samples") * F.col("channel_count")), "bad payload length")
        .when(F.abs(F.col("sampling_rate_hz") - expected_rate) > tolerance, "unexpected sampling rate"),
    )
    ok = rows.filter("error is null").select("fiber_id", "section", "frame_seq", "ts_ns", "channel_start", "channel_count", "sampling_rate_hz", F.posexplode("v").alias("pos", "v"))
    sample = F.floor(F.col("pos") / F.col("channel_count")).cast("int")
    ok = ok.select("fiber_id", "section", "frame_seq", sample.alias("sample"), (F.col("channel_start") + F.col("pos") % F.col("channel_count")).cast("int").alias("ch"), (F.col("ts_ns") + sample * S.sample_ns(F.col("sampling_rate_hz"))).alias("ts_ns"), "v")
    return ok, rows.filter("error is not null").drop("v")


def pack_detections(det: DataFrame, engine: str = "fiberlake", *by: str) -> DataFrame:
    """All detections of a section's window in one record, ordered by time and channel."""
    d = F.struct(
        F.col("ts_ns").alias("timestamp_ns"), F.col("ch").alias("channel"), F.coalesce("direction", F.lit(0)).alias("direction"), F.coalesce("speed", F.lit(0.0)).alias("speed_kmh"),
        *[F.coalesce(F.col(c).cast("double"), F.lit(x)).alias(c) for c, x in (("vehicle_count", 1.0), ("n_cars", 0.0), ("n_trucks", 0.0), ("glrt_max", 0.0), ("strain_peak", 0.0), ("strain_rms", 0.0))],
    )
    keys = by or ("fiber_id",)
    return det.groupBy(*keys).agg(F.sort_array(F.collect_list(d)).alias("detections")).withColumn("engine_version", F.lit(engine))


def flatten_detections(batches: DataFrame) -> DataFrame:
    """One row a detection; a record without an array but with a time is one detection itself."""
    names = ["timestamp_ns", "channel", "direction", "speed_kmh", "vehicle_count", "n_cars", "n_trucks", "glrt_max", "strain_peak", "strain_rms"]
    lone = set(names) <= set(batches.columns)
    d = F.coalesce("detections", F.array().cast(f"array<{schemas.DETECTION_STRUCT}>"))
    if lone:
        d = F.when((F.size(d) == 0) & F.col("timestamp_ns").isNotNull(), F.array(F.struct(*names).cast(schemas.DETECTION_STRUCT))).otherwise(d)
    rows = batches.select("fiber_id", F.inline(d))
    return rows.select("fiber_id", S.trunc_interval(S.ns_to_ts(F.col("timestamp_ns")), 0.1).alias("ts"), F.col("timestamp_ns").alias("ts_ns"), F.col("channel").alias("ch"), "direction", F.col("speed_kmh").alias("speed"), *names[4:])


def with_dlq(df: DataFrame, checks: dict[str, Column], source: Column, payload: Column) -> tuple[DataFrame, DataFrame]:
    """(rows that pass all checks, dead letters of the others with the first failed check)."""
    failed = F.coalesce(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks.items()])
    rows = df.withColumn("_error", failed)
    dlq = rows.filter("_error is not null").select(
        source.alias("source"), F.lit(None).cast("int").alias("partition"), F.lit(None).cast("bigint").alias("offset"), F.col("_error").alias("error_type"),
        S.clip_error(F.concat(F.lit("check failed: "), "_error", F.lit(" in "), payload.cast("string"))).alias("error_message"), payload.cast("string").cast("binary").alias("payload"),
    )
    return rows.filter("_error is null").drop("_error"), dlq


def modal_frames(frames: DataFrame) -> DataFrame:
    """Only frames whose length is their fiber's most frequent one."""
    modal = frames.groupBy("fiber_id").agg(F.mode(F.size("values"), True).alias("_n"))
    return frames.join(modal, "fiber_id").filter(F.size("values") == F.col("_n")).drop("_n")


def capture(frames: DataFrame, out: str, *by: str) -> None:
    """Stores frames of the modal length, partitioned (batch)."""
    modal_frames(frames).write.mode("append").partitionBy(*(by or ("fiber_id",))).parquet(out)


