"""Column functions: time, rounding, occupancy, classes, text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

VEHICLE_M = 6.0  # mean vehicle length for occupancy


# time ------------------------------------------------------------------------
def ns_to_ts(c: Column) -> Column:
    """Nanoseconds to a timestamp (microseconds; the rest is cut)."""
    return F.timestamp_micros(idiv(c, 1000))


def idiv(c: Column, n: int) -> Column:
    """Whole-number division towards minus infinity, exact for all longs."""
    return F.call_function("div", c - F.pmod(c, F.lit(n)), F.lit(n))


def ms_to_ts(c: Column) -> Column:
    return F.timestamp_millis(c)


def ts_to_ms(c: Column) -> Column:
    return F.unix_millis(c)


def ts_to_s(c: Column) -> Column:
    return F.unix_seconds(c)


def ts_to_ns(c: Column) -> Column:
    return F.unix_micros(c) * 1000


def ns_to_ms(c: Column) -> Column:
    return idiv(c, 1_000_000)


def sample_ns(fs: Column) -> Column:
    """Nanoseconds between samples, as a whole number."""
    return F.floor(F.lit(1e9) / fs).cast("bigint")


def trunc_ts(c: Column, unit: str) -> Column:
    return F.date_trunc(unit, c)


def trunc_interval(c: Column, seconds: float) -> Column:
    """Start of the interval of so many seconds, counted from the epoch."""
    us = F.unix_micros(c)
    return F.timestamp_micros(us - F.pmod(us, F.lit(int(seconds * 1_000_000))))


def day(c: Column) -> Column:
    return F.to_date(c)


def month_bounds(month: str) -> tuple[Column, Column]:
    """First instant of the month 'YYYY-MM' and of the next one."""
    first = F.to_date(F.lit(f"{month}-01"))
    return first.cast("timestamp"), F.add_months(first, 1).cast("timestamp")


def iso(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def parse_bound(c: Column, end: bool = False) -> Column:
    """ISO text to a timestamp; a bare date is the start or the last second of its day."""
    return F.when(F.length(c) == 10, F.try_to_timestamp(F.concat(c, F.lit("T23:59:59" if end else "T00:00:00")))).otherwise(F.try_to_timestamp(c))


# numbers ---------------------------------------------------------------------
def narrow(c: Column, lo: int, hi: int) -> Column:
    """An integer within bounds, else null (never wrapped)."""
    v = c.cast(T.StringType()).try_cast("bigint")
    return F.when(v.between(lo, hi), v.cast("int"))


def at(arr: Column, i: Column) -> Column:
    """Element ``i`` from 1, null outside."""
    return F.when(i > 0, F.try_element_at(arr, i))


def dflt(c: Column, v) -> Column:
    return F.coalesce(c, F.lit(v))


def safe_ratio(a: Column, b: Column, empty=None) -> Column:
    return F.when(b != 0, a / b).otherwise(F.lit(empty))


def round_py(c: Column, n: int = 0) -> Column:
    """Half to even."""
    return F.bround(c, n)


def round_js(c: Column) -> Column:
    """Half up."""
    return F.floor(c + 0.5)


def occupancy(speed: Column, flow: Column, variant: str = "history") -> Column:
    """Road occupancy in percent; see the README for the three variants.

    history: ceiling, 100 if anything stands still; snapshot: half-even, null at speed
    zero (flow is a count of one second); share: distinct channels over all channels.
    """
    if variant == "history":
        x = F.ceil(flow * VEHICLE_M / F.nullif(speed * (1000 / 3600) * 1000, F.lit(0.0)))
        return F.when(speed < 1.0, F.when(flow > 0, 100).otherwise(0)).otherwise(F.least(F.lit(100), x)).cast("int")
    if variant == "snapshot":
        x = F.bround(flow * 3600 * VEHICLE_M / F.nullif(speed * (1000 / 3600) * 1000, F.lit(0.0)))
        return F.when(speed > 0, F.least(F.lit(100.0), x).cast("int"))
    return speed / flow  # share: (distinct channels, channels)


def travel_time(channels: Column, speed: Column, metres: float = 5.0) -> Column:
    """Minutes for so many channels at a speed in km/h, to one decimal; null if it stands."""
    return F.when(speed > 0, round_js(channels * metres / F.nullif(speed * 1000 / 3600, F.lit(0.0)) / 60 * 10) / 10)


def log_power(arr: Column) -> Column:
    return F.transform(arr, lambda x: F.log10(x + 1e-10))


def level256(c: Column, lo: Column, hi: Column) -> Column:
    """Of 256 levels between lo and hi; 0 if they are equal."""
    return F.when(hi > lo, F.least(F.lit(255), F.floor((c - lo) / F.nullif(hi - lo, F.lit(0.0)) * 255))).otherwise(0).cast("int")


def to_ch_per_ms(speed: Column, metres: float = 5.0) -> Column:
    """km/h to channels per millisecond."""
    return speed / 3.6 / 1000 / metres


# classes and text ------------------------------------------------------------
def speed_class(speed: Column, green=80.0, yellow=60.0, orange=30.0) -> Column:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.when(speed >= lit(green), "fast").when(speed >= lit(yellow), "normal").when(speed >= lit(orange), "slow").otherwise("stopped")


def shm_severity(sigma: Column) -> Column:
    return F.when(sigma < 2, "normal").when(sigma < 3, "warning").when(sigma < 4, "alert").otherwise("critical")


def shm_status(severity: Column) -> Column:
    return F.when(severity == "alert", "warning").when(severity == "normal", "nominal").otherwise(severity)


def section_id(fiber: Column, direction: Column, start: Column, stop: Column) -> Column:
    return F.format_string("auto-%s-%d-%d-%d", fiber, direction, start, stop)


def speed_reason(speed: Column, threshold: Column) -> Column:
    return F.format_string("Speed %.1f km/h below threshold %.1f km/h", speed, threshold)


def incident_reason(incident: Column, kind: Column, severity: Column) -> Column:
    return F.concat(F.lit("Incident "), F.coalesce(incident, F.lit("?")), F.lit(" type="), kind, F.lit(" severity="), severity)


def json_in(c: Column, schema: str) -> Column:
    return F.from_json(c, schema)


def json_out(*cols: str) -> Column:
    return F.to_json(F.struct(*cols))


def clip_error(c: Column, most: int = 1000) -> Column:
    return F.when(F.length(c) > most, F.concat(F.left(c, F.lit(most - 3)), F.lit("..."))).otherwise(c)
