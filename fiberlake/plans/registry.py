"""Registered queries, each a reference query over whole tables, with its SQL.

Results carry times as whole milli- or microseconds.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import kernels
from ..functions import scalars as S
from ..operators import alerts, calibration, counting, detection, filters, geometry, health, history, incidents, joins, monitors, ordered, paging, reports, rollups, signals
from ..sources import dimensions, frames, maintenance, sinks
from .adapters import T0_US, Views, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

T0 = dt.datetime(2024, 1, 1)
DAY = dt.timedelta(days=1)
END_US = T0_US + 3_600_000_000


def query(name: str, sql: str | None = None):
    """Registers a function of the views as a query."""

    def add(f: Callable[[Views], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: f(Views(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = with_views(sql)
        return f

    return add


def day(text: str):
    return F.lit(text).cast("timestamp")


def lit_us(us: int):
    return F.timestamp_micros(F.lit(us))


# tiers -------------------------------------------------------------------------
@query("report_speed_tiers", """
WITH h AS (SELECT * FROM (SELECT *, make_timestamp(us - us % 100000) AS t FROM detections) QUALIFY row_number() OVER (PARTITION BY fiber_id, t, ch, direction ORDER BY seq DESC) = 1),
m AS (SELECT fiber_id, date_trunc('minute', t) AS t, ch, direction, max(speed) AS mx, sum(speed) AS s, count(speed) AS n, min(speed) AS mn FROM h GROUP BY ALL),
k AS (SELECT fiber_id, date_trunc('hour', t) AS t, ch, direction, max(mx) AS mx, sum(s) AS s, sum(n) AS n, min(mn) AS mn FROM m GROUP BY ALL)
SELECT fiber_id, direction, round_even(sum(s) / sum(n), 1) AS avg, round_even(min(mn), 1) AS min, round_even(max(mx), 1) AS max, sum(n)::BIGINT AS samples FROM k GROUP BY ALL""")
def _(v):
    return history.speed_stats_tier(rollups.rollup_1h(rollups.rollup_1m(v.detections(), dedup=True)))


@query("dedup_hires", "SELECT fiber_id, us - us % 100000 AS us, ch, direction, arg_max(speed, seq) AS speed, max(seq) AS seq FROM detections_dup GROUP BY ALL")
def _(v):
    return rollups.dedup_hires(v.detections_dup()).select("fiber_id", F.unix_micros("ts").alias("us"), "ch", "direction", "speed", "seq")


@query("rollup_1m", "SELECT * REPLACE (epoch_ms(ts) AS ts) FROM m1")
def _(v):
    return rollups.rollup_1m(v.detections()).withColumn("ts", F.unix_millis("ts"))


@query("rollup_corrected", "SELECT * REPLACE (epoch_ms(ts) AS ts) FROM m1")
def _(v):
    """Every twentieth row comes late; the minute tier after correction is that of all rows."""
    d = v.detections()
    path = sinks.scratch(d.sparkSession, "tiers")
    return maintenance.rebuilt(d.sparkSession, path, d.filter("seq % 20 <> 0"), d.filter("seq % 20 = 0")).withColumn("ts", F.unix_millis("ts"))


@query("rollup_1h", "SELECT fiber_id, epoch_ms(date_trunc('hour', ts)) AS ts, ch, direction, max(speed_max) AS speed_max, sum(speed_sum) AS speed_sum, sum(speed_n)::BIGINT AS speed_n, min(speed_min) AS speed_min, sum(count_sum)::BIGINT AS count_sum, sum(cars_sum)::BIGINT AS cars_sum, sum(trucks_sum)::BIGINT AS trucks_sum, sum(samples)::BIGINT AS samples FROM m1 GROUP BY ALL")
def _(v):
    return rollups.rollup_1h(rollups.rollup_1m(v.detections())).withColumn("ts", F.unix_millis("ts"))


@query("finalize_tier", "SELECT fiber_id, direction, sum(speed_sum) / sum(speed_n) AS speed_avg, min(speed_min) AS speed_min, max(speed_max) AS speed_max, sum(count_sum)::BIGINT AS vehicles, sum(cars_sum)::BIGINT AS cars, sum(trucks_sum)::BIGINT AS trucks, sum(samples)::BIGINT AS samples FROM m1 GROUP BY ALL")
def _(v):
    return rollups.finalize(rollups.rollup_1m(v.detections()), ["fiber_id", "direction"])


@query("two_level_rollup", """
WITH s AS (SELECT fiber_id, ch, direction, date_trunc('second', ts) AS s, avg(speed) AS a, max(speed) AS m, sum(vehicle_count) AS n FROM detections_dense GROUP BY ALL)
SELECT fiber_id, ch, direction, epoch_ms(date_trunc('minute', s)) AS ts, avg(a) AS speed_avg, max(m) AS speed_max, sum(n)::BIGINT AS vehicles FROM s GROUP BY ALL""")
def _(v):
    return rollups.two_level_rollup(v.detections_dense()).withColumn("ts", F.unix_millis("ts"))


_OCC = "CASE WHEN {s} < 1 THEN CASE WHEN {f} > 0 THEN 100 ELSE 0 END ELSE least(100, ceil({f} * 6 / ({s} * (1000.0::DOUBLE / 3600) * 1000))) END::INT"


@query("merge_channels", f"""
WITH b AS (SELECT fiber_id, ch, direction, date_trunc('minute', s) AS ts, avg(a) AS a, max(m) AS m, sum(n) AS n FROM (SELECT fiber_id, ch, direction, date_trunc('second', ts) AS s, avg(speed) AS a, max(speed) AS m, sum(vehicle_count) AS n FROM detections_dense GROUP BY ALL) GROUP BY ALL),
c AS (SELECT fiber_id, direction, epoch_ms(ts) AS ts, avg(a) AS speed, max(m) AS speed_max, sum(n)::BIGINT AS vehicles, round_even(sum(n) / 50 * 60.0, 0) AS flow FROM b WHERE ch BETWEEN 20 AND 69 GROUP BY ALL)
SELECT *, {_OCC.format(s='speed', f='flow')} AS occupancy FROM c""")
def _(v):
    return rollups.merge_channels(rollups.two_level_rollup(v.detections_dense()), 20, 69, 60).withColumn("ts", F.unix_millis("ts"))


@query("apply_retention", f"SELECT fiber_id, count(*) AS n FROM detections WHERE us >= {T0_US} + 18 * 86400000000 GROUP BY ALL")
def _(v):
    return sinks.apply_retention(v.detections(), "hires", T0 + 20 * DAY).groupBy("fiber_id").agg(F.count(F.lit(1)).alias("n"))


# filters -----------------------------------------------------------------------
@query("filter_range", "SELECT seq, us, speed FROM detections WHERE ts BETWEEN '2024-01-10' AND '2024-01-20' AND direction = 1 AND ch BETWEEN 10 AND 90 AND fiber_id IN ('click', 'view')")
def _(v):
    d = filters.by_fibers(filters.by_channels(filters.by_direction(filters.time_range(v.detections(), day("2024-01-10"), day("2024-01-20")), 1), 10, 90), ["click", "view"])
    return d.select("seq", F.unix_micros("ts").alias("us"), "speed")


@query("filter_last", f"SELECT seq FROM detections_dense WHERE us >= {END_US} - 600000000")
def _(v):
    return filters.last(v.detections_dense(), 600, lit_us(END_US)).select("seq")


@query("filter_since", f"SELECT 'hires' AS tier, count(*) AS n FROM detections_dense WHERE us // 1000 >= {T0_US // 1000 + 1_800_000} + 1000 UNION ALL SELECT '1m', count(*) FROM m1d WHERE epoch_ms(ts) > {T0_US // 1000 + 1_800_000}")
def _(v):
    ms = T0_US // 1000 + 1_800_000
    n = lambda d, t: d.agg(F.count(F.lit(1)).alias("n")).select(F.lit(t).alias("tier"), "n")
    return n(filters.since(v.detections_dense(), "hires", ms), "hires").unionByName(n(filters.since(rollups.rollup_1m(v.detections_dense()), "1m", ms), "1m"))


@query("public_detections", """SELECT fiber_id AS "fiberId", direction, ch AS channel, round_even(abs(speed), 1) AS speed, vehicle_count::DOUBLE AS count, n_cars::DOUBLE AS "nCars", n_trucks::DOUBLE AS "nTrucks",
round_even(glrt_max, 1) AS "glrtMax", round_even(strain_peak, 6) AS "strainPeak", round_even(strain_rms, 6) AS "strainRms", ts_ns // 1000000 AS timestamp FROM detections""")
def _(v):
    return filters.to_public_detection(v.detections())


@query("public_incidents", """SELECT incident_id AS id, incident_type AS type, severity, fiber_id AS "fiberId", direction, channel_start AS channel, channel_end AS "channelEnd", strftime(timestamp, '%Y-%m-%dT%H:%M:%S') || '.' || lpad((epoch_ms(timestamp) % 1000)::VARCHAR, 3, '0') || 'Z' AS "detectedAt", status,
nullif(duration_seconds, 0) * 1000 AS duration, speed_drop_percent AS "speedDropPercent" FROM incidents""")
def _(v):
    return filters.to_public_incident(v.incidents())


@query("validate_drops", "SELECT CASE WHEN NOT speed > 5 THEN 'speed' ELSE 'channel' END AS rule, count(*) AS dropped FROM detections WHERE NOT (speed > 5 AND ch < 140) GROUP BY ALL")
def _(v):
    return filters.validate(v.detections(), {"speed": F.col("speed") > 5, "channel": F.col("ch") < 140}, {"glrt_max": 0.0})[1]


@query("speed_classes", "SELECT CASE WHEN speed >= 80 THEN 'fast' WHEN speed >= 60 THEN 'normal' WHEN speed >= 30 THEN 'slow' ELSE 'stopped' END AS class, count(*) AS n FROM detections GROUP BY ALL")
def _(v):
    return v.detections().groupBy(S.speed_class(F.col("speed")).alias("class")).agg(F.count(F.lit(1)).alias("n"))


@query("filter_incidents", "SELECT incident_id FROM incidents WHERE severity IN ('critical', 'high') AND status <> 'resolved'")
def _(v):
    return filters.filter_incidents(v.incidents(), ["critical", "high"], hide_resolved=True).select("incident_id")


@query("search_incidents", "SELECT incident_id FROM incidents WHERE lower(incident_type) LIKE '%cid%' OR lower(fiber_id) LIKE '%cid%'")
def _(v):
    return filters.search(v.incidents(), ["incident_type", "fiber_id"], "CID").select("incident_id")


@query("incidents_on_day", "SELECT incident_id FROM incidents WHERE timestamp::DATE = DATE '1996-01-02'")
def _(v):
    return filters.incidents_on(v.incidents(), F.lit("1996-01-02").cast("date")).select("incident_id")


@query("coverage_filter", "SELECT fiber_id, count(*) AS n FROM detections WHERE (ch BETWEEN 5 AND 40) OR (ch BETWEEN 35 AND 60) GROUP BY ALL")
def _(v):
    ranges = v.cables().select("fiber_id", F.inline(F.array(F.struct(F.lit(5).alias("start"), F.lit(40).alias("end")), F.struct(F.lit(35).alias("start"), F.lit(60).alias("end")))))
    return filters.in_coverage(v.detections(), ranges).groupBy("fiber_id").agg(F.count(F.lit(1)).alias("n"))


@query("min_extent", "SELECT s.fiber_id, count(*) AS n FROM sig s JOIN (SELECT fiber_id FROM sig GROUP BY fiber_id HAVING count(DISTINCT ch) >= 9 AND count(DISTINCT t_idx) >= 64) USING (fiber_id) GROUP BY ALL")
def _(v):
    return filters.min_extent(v.signal(), ["fiber_id"], 9, 64).groupBy("fiber_id").agg(F.count(F.lit(1)).alias("n"))


# latest versions, workflow, paging ------------------------------------------------
@query("incidents_latest", "SELECT incident_id, status, severity, epoch_us(updated_at) AS updated_us, duration_seconds FROM incidents")
def _(v):
    return v.incidents().select("incident_id", "status", "severity", F.unix_micros("updated_at").alias("updated_us"), "duration_seconds")


@query("incident_by_id", "SELECT incident_id, status, epoch_us(updated_at) AS updated_us FROM incidents WHERE incident_id = 'inc-7'")
def _(v):
    ties = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
    return incidents.incident_by_id(v.incident_versions(), "inc-7", ties).select("incident_id", "status", F.unix_micros("updated_at").alias("updated_us"))


@query("page_keyset", "SELECT us, ch, direction, speed FROM detections WHERE (us, ch, direction) > (1704700800000000, 0, 0) ORDER BY us, ch, direction LIMIT 101")
def _(v):
    d = v.detections().withColumn("us", F.unix_micros("ts"))
    return paging.page(d, ["us", "ch", "direction"], (1704700800000000, 0, 0), 100).select("us", "ch", "direction", "speed")


@query("page_desc", "SELECT incident_id, epoch_us(timestamp) AS us FROM incidents WHERE timestamp < TIMESTAMP '1997-01-01' OR (timestamp = TIMESTAMP '1997-01-01' AND incident_id > 'inc-5') ORDER BY timestamp DESC, incident_id LIMIT 51")
def _(v):
    return paging.page_desc(v.incidents(), "timestamp", "incident_id", (dt.datetime(1997, 1, 1, tzinfo=dt.timezone.utc), "inc-5"), 50).select("incident_id", F.unix_micros("timestamp").alias("us"))


@query("page_offset", "SELECT incident_id FROM incidents ORDER BY incident_id LIMIT 51 OFFSET 100")
def _(v):
    return paging.offset_page(v.incidents(), ["incident_id"], 100, 50).select("incident_id")


@query("latest_n", "SELECT incident_id, epoch_us(timestamp) AS us FROM incidents ORDER BY timestamp DESC, incident_id LIMIT 200")
def _(v):
    return paging.latest_n(v.incidents(), 200).select("incident_id", F.unix_micros("timestamp").alias("us"))


@query("workflow_status", "SELECT incident_id, coalesce(arg_max(to_status, at_us), 'active') AS workflow_status FROM (SELECT DISTINCT incident_id FROM incident_versions) LEFT JOIN actions USING (incident_id) GROUP BY incident_id")
def _(v):
    return incidents.current_status(v.incidents(), v.actions())


@query("workflow_check", """SELECT incident_id, at_us, from_status = lag(to_status, 1, 'active') OVER (PARTITION BY incident_id ORDER BY at_us) AND (from_status, to_status) IN (('active', 'acknowledged'), ('active', 'investigating'), ('active', 'resolved'), ('acknowledged', 'investigating'), ('acknowledged', 'resolved'), ('investigating', 'resolved'), ('resolved', 'active')) AS valid FROM actions""")
def _(v):
    return incidents.check_transitions(v.actions()).select("incident_id", F.unix_micros("performed_at").alias("at_us"), "valid")


# history -------------------------------------------------------------------------
@query("summary_hires", "SELECT count(*) AS detections, sum(vehicle_count)::BIGINT AS vehicles, avg(speed) AS speed_avg, min(speed) AS speed_min, max(speed) AS speed_max, count(DISTINCT ch) AS channels FROM detections")
def _(v):
    return history.summary_hires(v.detections())


@query("summary_tier", "SELECT sum(samples)::BIGINT AS detections, sum(count_sum)::BIGINT AS vehicles, avg(speed_sum / speed_n) AS speed_avg, min(speed_sum / speed_n) AS speed_min, max(speed_sum / speed_n) AS speed_max, count(DISTINCT ch) AS channels FROM m1")
def _(v):
    return history.summary_tier(rollups.rollup_1m(v.detections()))


_POINT = f"round_even(round_even(speed_avg, 6), 1) AS speed, round_even(speed_max, 1) AS speed_max, round_even(samples, 4) AS samples, round_even(samples * {{k}}, 0)::BIGINT AS flow, {_OCC.format(s='round_even(round_even(speed_avg, 6), 1)', f='round_even(samples * {k}, 0)')} AS occupancy"


@query("section_history_1s", f"WITH h AS (SELECT us // 1000000 * 1000 AS time_ms, avg(speed) AS speed_avg, max(speed) AS speed_max, count(*) / 50.0::DOUBLE AS samples FROM detections_dense WHERE fiber_id = 'click' AND direction = 0 AND ch BETWEEN 20 AND 69 GROUP BY ALL) SELECT time_ms, {_POINT.replace('{k}', '3600.0')} FROM h")
def _(v):
    return history.section_history_1s(filters.by_direction(filters.by_fibers(v.detections_dense(), ["click"]), 0), 20, 69)


@query("section_history_1m", f"WITH h AS (SELECT epoch_ms(ts) AS time_ms, sum(speed_sum) / sum(speed_n) AS speed_avg, max(speed_max) AS speed_max, sum(samples) / 50.0::DOUBLE AS samples FROM m1d WHERE fiber_id = 'click' AND direction = 0 AND ch BETWEEN 20 AND 69 GROUP BY ALL) SELECT time_ms, {_POINT.replace('{k}', '60.0')} FROM h")
def _(v):
    return history.section_history_1m(rollups.rollup_1m(v.detections_dense()).filter("fiber_id = 'click' and direction = 0"), 20, 69)


@query("batch_history", f"WITH h AS (SELECT section_id, us // 1000000 * 1000 AS time_ms, avg(speed) AS speed_avg, max(speed) AS speed_max, count(*) / (channel_end - channel_start + 1)::DOUBLE AS samples FROM detections_dense d JOIN sections s ON d.fiber_id = s.fiber_id AND d.direction = s.direction AND ch BETWEEN channel_start AND channel_end WHERE ord <> 1 OR us // 1000 >= {T0_US // 1000 + 1_801_000} GROUP BY section_id, channel_start, channel_end, time_ms) SELECT section_id, time_ms, {_POINT.replace('{k}', '3600.0')} FROM h")
def _(v):
    cursors = v.sections().select("section_id", F.when(F.col("ord") == 1, T0_US // 1000 + 1_800_000).otherwise(0).alias("since_ms"))
    return history.batch_history(v.detections_dense(), v.sections(), cursors)


@query("section_series", "SELECT us // 1000000 * 1000 AS time_ms, avg(speed) AS speed, count(*) / 50.0::DOUBLE AS flow, count(DISTINCT ch) / 50.0::DOUBLE AS occupancy FROM detections_dense WHERE ch BETWEEN 20 AND 69 GROUP BY ALL")
def _(v):
    return history.section_series(v.detections_dense(), 20, 69)


@query("section_series_tier", "SELECT epoch_ms(ts) AS time_ms, sum(speed_sum) / sum(speed_n) AS speed, sum(count_sum) / 50.0::DOUBLE AS flow, count(DISTINCT ch) / 50.0::DOUBLE AS occupancy FROM m1d WHERE ch BETWEEN 20 AND 69 GROUP BY ALL")
def _(v):
    return history.section_series_tier(rollups.rollup_1m(v.detections_dense()), 20, 69)


@query("live_stats", f"""SELECT (SELECT count(*) FROM detections_dense WHERE us >= {END_US} - 10000000) AS rows_10s, (SELECT coalesce(sum(vehicle_count), 0)::BIGINT FROM detections_dense WHERE us >= {END_US} - 30000000) AS vehicles_30s,
(SELECT count(*) FROM incidents WHERE status = 'active') AS active_incidents, (SELECT count(*) FROM fibers) AS fibers, (SELECT count(*) FROM geo) AS channels""")
def _(v):
    return history.live_stats(v.detections_dense(), v.incidents(), v.cables(), lit_us(END_US))


@query("traffic_totals", "SELECT count(*) AS detections, sum(vehicle_count)::BIGINT AS vehicles, avg(speed) AS speed_avg, sum(n_trucks) / sum(vehicle_count) AS truck_ratio, count(DISTINCT fiber_id) AS fibers FROM detections")
def _(v):
    return history.traffic_totals(v.detections())


@query("traffic_series", "SELECT fiber_id, (us - us % 21600000000) // 1000 AS time_ms, count(*) AS n, avg(speed) AS speed_avg, max(speed) AS speed_max FROM detections GROUP BY ALL")
def _(v):
    return history.traffic_series(v.detections(), 21_600, "fiber_id")


@query("speed_stats", "SELECT fiber_id, direction, round_even(avg(abs(speed)), 1) AS avg, round_even(min(abs(speed)), 1) AS min, round_even(max(abs(speed)), 1) AS max, count(*) AS samples FROM detections GROUP BY ALL")
def _(v):
    return history.speed_stats(v.detections())


@query("hourly_volume", "SELECT fiber_id, direction, epoch_ms(date_trunc('hour', ts)) AS hour_ms, sum(vehicle_count)::BIGINT AS vehicles, count(*) AS detections FROM detections GROUP BY ALL")
def _(v):
    return history.hourly_volume(v.detections())


@query("availability", "SELECT fiber_id, epoch_us(min(date_trunc('hour', ts))) AS first_us, epoch_us(max(date_trunc('hour', ts))) AS last_us FROM detections GROUP BY ALL")
def _(v):
    return history.availability(rollups.rollup_1h(rollups.rollup_1m(v.detections())))


_HIST = f"h0 AS (SELECT section_id, us // 1000000 * 1000 AS time_ms, avg(speed) AS speed_avg, max(speed) AS speed_max, count(*) / (channel_end - channel_start + 1)::DOUBLE AS samples FROM detections_dense d JOIN sections s ON d.fiber_id = s.fiber_id AND d.direction = s.direction AND ch BETWEEN channel_start AND channel_end GROUP BY section_id, channel_start, channel_end, time_ms), hist AS (SELECT section_id, time_ms, {_POINT.replace('{k}', '3600.0')} FROM h0)"


@query("live_cards", f"""WITH {_HIST}, c AS (SELECT section_id, floor(avg(speed) + 0.5)::BIGINT AS speed, floor(avg(flow) + 0.5)::BIGINT AS flow, floor(avg(occupancy) + 0.5)::BIGINT AS occupancy FROM (SELECT * FROM hist QUALIFY row_number() OVER (PARTITION BY section_id ORDER BY time_ms DESC) <= 10) GROUP BY ALL)
SELECT section_id, speed, flow, occupancy, CASE WHEN speed > 0 THEN floor((channel_end - channel_start) * 5.0::DOUBLE / (speed * 1000 / 3600.0::DOUBLE) / 60 * 10 + 0.5) / 10 END AS travel_min FROM sections LEFT JOIN c USING (section_id)""")
def _(v):
    return history.live_cards(history.batch_history(v.detections_dense(), v.sections()), v.sections())


@query("tail_points", f"WITH {_HIST} SELECT section_id, time_ms, speed, flow FROM hist WHERE time_ms >= {END_US // 1000} - 60000 QUALIFY row_number() OVER (PARTITION BY section_id ORDER BY time_ms DESC) <= 60")
def _(v):
    return history.tail_points(history.batch_history(v.detections_dense(), v.sections()), F.lit(END_US // 1000)).select("section_id", "time_ms", "speed", "flow")


@query("live_dots", f"WITH d AS (SELECT fiber_id, ch, direction, max({{'t': ts_ns, 's': speed}}) AS d FROM detections_dense GROUP BY ALL) SELECT fiber_id, ch, direction, d.s AS speed, 1 - ({END_US // 1000} - d.t // 1000000) / 60000.0::DOUBLE AS opacity FROM d WHERE 1 - ({END_US // 1000} - d.t // 1000000) / 60000.0::DOUBLE BETWEEN 1e-300 AND 1")
def _(v):
    return history.live_dots(v.detections_dense(), lit_us(END_US), 60_000)


@query("waterfall_window", "SELECT d.fiber_id, seq FROM detections_dense d JOIN (SELECT fiber_id, max(ts_ns) AS m FROM detections_dense GROUP BY ALL) USING (fiber_id) WHERE ts_ns >= m - 120000000000")
def _(v):
    return history.waterfall_window(v.detections_dense()).select("fiber_id", "seq")


@query("downsample_rows", "WITH r AS (SELECT fiber_id, seq, row_number() OVER (PARTITION BY fiber_id ORDER BY seq) - 1 AS i, count(*) OVER (PARTITION BY fiber_id) AS n FROM detections) SELECT DISTINCT fiber_id, seq FROM r, range(100) j(j) WHERE n <= 100 OR i = floor(j * ((n - 1) / 99.0::DOUBLE))")
def _(v):
    return history.downsample_rows(v.detections(), 100, "seq", "fiber_id").select("fiber_id", "seq")


@query("slice_time", "SELECT fiber_id, seq, (us - min(us) OVER (PARTITION BY fiber_id)) / 1e6::DOUBLE AS t_rel FROM detections WHERE ts BETWEEN '2024-01-10' AND '2024-01-20'")
def _(v):
    return history.slice_time(v.detections(), day("2024-01-10"), day("2024-01-20"), "fiber_id").select("fiber_id", "seq", "t_rel")


# sources and sinks -----------------------------------------------------------------
@query("pack_flatten", "SELECT fiber_id, ts_ns, ch, direction, speed, vehicle_count::DOUBLE AS vehicle_count, n_cars::DOUBLE AS n_cars, n_trucks::DOUBLE AS n_trucks FROM detections")
def _(v):
    d = v.detections().withColumn("minute", F.date_trunc("minute", "ts"))
    return frames.flatten_detections(frames.pack_detections(d, "x", "fiber_id", "minute")).select("fiber_id", "ts_ns", "ch", "direction", "speed", "vehicle_count", "n_cars", "n_trucks")


@query("explode_frames", "SELECT fiber_id, t_idx::BIGINT AS frame_seq, ch, t_idx::BIGINT * 1000000000 + 1 AS ts_ns, v FROM sig JOIN (SELECT fiber_id, count(DISTINCT ch) AS n, min(ch) AS c0 FROM sig GROUP BY ALL) USING (fiber_id) WHERE n = 100")
def _(v):
    f = v.signal().groupBy("fiber_id", F.col("t_idx").cast("bigint").alias("frame_seq")).agg(F.transform(F.sort_array(F.collect_list(F.struct("ch", "v"))), lambda x: x["v"]).alias("values"))
    f = f.withColumn("ts_ns", F.col("frame_seq") * 1_000_000_000 + 1)
    p = f.groupBy("fiber_id").agg(F.max(F.size("values")).alias("n_channels")).filter("n_channels = 100").withColumn("rate", F.lit(10.0))
    return frames.explode_frames(f, p).select("fiber_id", "frame_seq", "ch", "ts_ns", "v")


@query("codec_round_trip", "SELECT fiber_id, t_idx::BIGINT AS frame_seq, ch, v FROM sig")
def _(v):
    sig = v.signal().select("fiber_id", F.col("t_idx").cast("bigint").alias("frame_seq"), F.lit(0).alias("sample"), "ch", (F.col("t_idx") * 1_000_000_000 + 1).cast("bigint").alias("ts_ns"), "v")
    ok, _bad = frames.decode_processed(frames.encode_processed(sig, "main", F.lit(10.0)), 10.0)
    return ok.select("fiber_id", "frame_seq", "ch", "v")


@query("signal_stats", "SELECT fiber_id, t_idx, min(v) AS min, max(v) AS max, avg(v) AS mean, sqrt(avg(v * v)) AS rms FROM sig GROUP BY ALL")
def _(v):
    return frames.signal_stats(v.signal(), "fiber_id", "t_idx")


@query("dead_letters", "SELECT CASE WHEN NOT ch < 140 THEN 'channel' ELSE 'speed' END AS error_type, count(*) AS n FROM detections WHERE ch >= 140 OR speed <= 5 GROUP BY ALL")
def _(v):
    _ok, dlq = frames.with_dlq(v.detections(), {"channel": F.col("ch") < 140, "speed": F.col("speed") > 5}, F.lit("detections"), F.col("seq"))
    return monitors.dlq_stats(dlq).select("error_type", "n")


@query("upsert_dim", "SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN 'new' ELSE 'old' END AS name FROM customer")
def _(v):
    c = v.table("customer").select(F.col("c_custkey").alias("id"))
    old = c.select("id", F.lit("old").alias("name"), F.lit(1).alias("version"))
    new = c.filter("id % 3 = 0").select("id", F.lit("new").alias("name"), F.lit(1).alias("version"))
    return dimensions.upsert_dim(old, new, ["id"], "version").select("id", "name")


@query("dim_diff", "SELECT 'added' AS change, count(*) AS n FROM customer WHERE c_custkey % 5 = 1 UNION ALL SELECT 'deleted', count(*) FROM customer WHERE c_custkey % 5 = 2 UNION ALL SELECT 'updated', count(*) FROM customer WHERE c_custkey % 5 = 3")
def _(v):
    c = v.table("customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    want = c.filter("id % 5 <> 2").withColumn("name", F.when(F.col("id") % 5 == 3, "x").otherwise(F.col("name")))
    return dimensions.dim_diff(want, c.filter("id % 5 <> 1"), ["id"])


@query("default_sections", "SELECT o.org, 'auto-' || fiber_id || '-' || d || '-0-' || (channels - 1) AS section_id FROM wfibers, (VALUES ('A'), ('B')) o(org), range(2) r(d) WHERE NOT EXISTS (SELECT 1 FROM wsections s WHERE s.org = o.org AND s.fiber_id = wfibers.fiber_id)")
def _(v):
    c = v.wide_cables()
    owners = c.select(F.explode(F.array(F.lit("A"), F.lit("B"))).alias("org"), "fiber_id")
    cover = c.select("fiber_id", F.lit(0).alias("start"), (F.size("coordinates") - 1).alias("end"))
    return dimensions.default_sections(owners, cover, v.wide_sections()).select("org", "section_id")


@query("export_detections", "SELECT us, ch, direction, speed FROM detections WHERE ts BETWEEN '2024-01-10' AND '2024-01-20' AND direction = 0 AND fiber_id = 'view' ORDER BY us, ch, direction LIMIT 500000")
def _(v):
    d = sinks.export_detections(v.detections(), day("2024-01-10"), day("2024-01-20"), ["view"], 0)
    return d.select(F.unix_micros("ts").alias("us"), "ch", "direction", "speed")


@query("export_incidents", "SELECT incident_id, epoch_us(timestamp) AS us FROM incidents WHERE timestamp BETWEEN '1994-01-01' AND '1996-01-01' ORDER BY timestamp DESC, incident_id LIMIT 100000")
def _(v):
    return sinks.export_incidents(v.incidents(), F.lit("1994-01-01").cast("timestamp"), F.lit("1996-01-01").cast("timestamp")).select("incident_id", F.unix_micros("timestamp").alias("us"))


@query("estimate_export", "SELECT count(*) AS rows, count(*) * 80 AS bytes FROM detections")
def _(v):
    return sinks.estimate_export(v.detections(), "hires", "csv")


# joins -----------------------------------------------------------------------------
@query("enrich_geo", "SELECT seq, lng, lat FROM detections LEFT JOIN geo USING (fiber_id, ch)")
def _(v):
    return joins.enrich_geo(v.detections(), v.cables()).select("seq", "lng", "lat")


@query("in_sections", "SELECT seq, section_id FROM detections d JOIN sections s ON d.fiber_id = s.fiber_id AND d.direction = s.direction AND ch BETWEEN channel_start AND channel_end")
def _(v):
    return joins.in_sections(v.detections(), v.sections()).select("seq", "section_id")


@query("pipeline_section", "SELECT seq, CASE WHEN ch < 50 THEN 'a' ELSE 'b' END AS section FROM detections WHERE ch < 120")
def _(v):
    cfg = v.cables().select("fiber_id", F.inline(F.array(*[F.struct(F.lit(o).alias("ord"), F.lit(n).alias("section"), F.lit(a).alias("start"), F.lit(b).alias("stop")) for o, n, a, b in ((0, "a", 0, 50), (1, "b", 40, 120))])))
    return joins.pipeline_section(v.detections(), cfg).select("seq", "section")


@query("tenant_scope", "SELECT seq FROM detections WHERE fiber_id IN (SELECT fiber_id FROM assignments WHERE org = 'A')")
def _(v):
    return joins.scope(v.detections(), v.assignments(), "A").select("seq")


@query("tenant_fan_out", "SELECT seq, org FROM detections JOIN assignments USING (fiber_id) UNION ALL SELECT seq, '__all__' FROM detections")
def _(v):
    return joins.fan_out(v.detections(), v.assignments()).select("seq", "org")


_SCOPE = "(len(fibers) = 0 OR list_contains(fibers, d.fiber_id)) AND (lo IS NULL OR {c} >= lo) AND (hi IS NULL OR {c} <= hi)"
_FIRED = f"fired AS (SELECT rule_id, d.fiber_id, ch, ts_ns, speed, printf('Speed %.1f km/h below threshold %.1f km/h', speed, threshold::DOUBLE) AS detail, cooldown_s FROM detections_dense d JOIN assignments a ON d.fiber_id = a.fiber_id JOIN rules r ON r.org = a.org WHERE is_active AND rule_type = 'speed_below' AND {_SCOPE.format(c='ch')} AND speed < threshold)"


@query("alerts_detections", f"WITH {_FIRED} SELECT rule_id, fiber_id, ch, ts_ns, speed FROM fired")
def _(v):
    return alerts.eval_detection_rules(v.detections_dense(), v.rules(), v.assignments()).select("rule_id", "fiber_id", "ch", "ts_ns", "speed")


@query("alerts_incidents", f"SELECT rule_id, incident_id, 'Incident ' || incident_id || ' type=' || incident_type || ' severity=' || severity AS detail FROM incidents d JOIN assignments a ON d.fiber_id = a.fiber_id JOIN rules r ON r.org = a.org WHERE is_active AND rule_type = 'incident_type' AND {_SCOPE.format(c='channel_start')} AND (len(types) = 0 OR list_contains(types, incident_type)) AND (len(severities) = 0 OR list_contains(severities, severity))")
def _(v):
    return alerts.eval_incident_rules(v.incidents(), v.rules(), v.assignments()).select("rule_id", "incident_id", "detail")


@query("alerts_cooldown", f"""WITH RECURSIVE {_FIRED}, r AS (SELECT *, row_number() OVER (PARTITION BY rule_id, fiber_id, ch ORDER BY ts_ns, detail) AS i FROM fired),
f AS (SELECT rule_id, fiber_id, ch, ts_ns, i, cooldown_s, true AS go, ts_ns AS last FROM r WHERE i = 1 UNION ALL
SELECT r.rule_id, r.fiber_id, r.ch, r.ts_ns, r.i, r.cooldown_s, r.cooldown_s <= 0 OR r.ts_ns - f.last > r.cooldown_s::BIGINT * 1000000000, CASE WHEN r.cooldown_s <= 0 OR r.ts_ns - f.last > r.cooldown_s::BIGINT * 1000000000 THEN r.ts_ns ELSE f.last END FROM f JOIN r ON r.rule_id = f.rule_id AND r.fiber_id = f.fiber_id AND r.ch = f.ch AND r.i = f.i + 1)
SELECT rule_id, fiber_id, ch, ts_ns FROM f WHERE go""")
def _(v):
    return alerts.apply_cooldown(alerts.eval_detection_rules(v.detections_dense(), v.rules(), v.assignments())).select("rule_id", "fiber_id", "ch", "ts_ns")


@query("incident_window", "SELECT incident_id, seq FROM live_incidents i JOIN detections_dense d ON i.fiber_id = d.fiber_id AND i.direction = d.direction AND ch BETWEEN greatest(0, (channel_start + channel_end) // 2 - 50) AND (channel_start + channel_end) // 2 + 50 AND abs(us - i_us) <= 60000000")
def _(v):
    return incidents.incident_window(v.live_incidents(), v.detections_dense()).select("incident_id", "seq")


_SNAP = """WITH w AS (SELECT incident_id, us // 1000000 AS sec, round_even(avg(abs(speed)), 0) AS speed, sum(vehicle_count) AS n FROM live_incidents i JOIN detections_dense d ON i.fiber_id = d.fiber_id AND i.direction = d.direction AND ch BETWEEN greatest(0, (channel_start + channel_end) // 2 - {a}) AND (channel_start + channel_end) // 2 + {a} AND abs(us - i_us) <= 60000000 GROUP BY ALL),
f AS (SELECT *, {flow} AS flow FROM w) SELECT i.incident_id, (i_us // 1000000 - 60 + k) * 1000 AS time_ms, speed, flow, {occ} AS occupancy FROM live_incidents i CROSS JOIN range(120) r(k) LEFT JOIN f ON f.incident_id = i.incident_id AND f.sec = i_us // 1000000 - 60 + k"""


@query("incident_snapshot", _SNAP.format(a=50, flow="n::DOUBLE", occ="CASE WHEN speed > 0 THEN least(100, round_even(flow * 3600 * 6 / (speed * (1000.0::DOUBLE / 3600) * 1000), 0))::INT END"))
def _(v):
    return incidents.incident_snapshot(v.live_incidents(), v.detections_dense())


@query("incident_snapshot_norm", _SNAP.format(a=30, flow="round_even(n * 3600 / 61.0::DOUBLE, 0)", occ=f"CASE WHEN speed IS NOT NULL THEN {_OCC.format(s='speed', f='flow')} END"))
def _(v):
    return incidents.incident_snapshot(v.live_incidents(), v.detections_dense(), norm=True)


@query("incident_changes", "SELECT incident_id, fiber_id, direction, 'new' AS change FROM incidents WHERE severity = 'high' AND incident_type <> 'anomaly' UNION ALL SELECT incident_id, fiber_id, direction, 'resolved' FROM incidents WHERE incident_type = 'anomaly' AND severity <> 'high'")
def _(v):
    i = v.incidents()
    return incidents.incident_changes(i.filter("incident_type = 'anomaly'"), i.filter("severity = 'high'"))


@query("incident_calendar", "SELECT strftime(timestamp, '%Y-%m-%d') AS day, count(*) AS n FROM incidents WHERE timestamp >= '1996-01-01' AND timestamp < '1996-02-01' GROUP BY ALL")
def _(v):
    return incidents.incident_calendar(v.incidents(), "1996-01")


@query("incident_breakdown", "SELECT incident_type, severity, count(*) AS n FROM incidents GROUP BY ALL")
def _(v):
    return incidents.incident_breakdown(v.incidents())


@query("lookup_thresholds", """SELECT seq, CASE WHEN a.green IS NOT NULL THEN a.green WHEN h.fiber_id IS NOT NULL THEN 70 ELSE 80 END::DOUBLE AS green, CASE WHEN a.yellow IS NOT NULL THEN a.yellow WHEN h.fiber_id IS NOT NULL THEN 50 ELSE 60 END::DOUBLE AS yellow FROM detections d
LEFT JOIN (SELECT d.fiber_id, d.direction, ch, arg_min(green, ord) AS green, arg_min(yellow, ord) AS yellow FROM (SELECT DISTINCT fiber_id, direction, ch FROM detections) d JOIN sections s ON d.fiber_id = s.fiber_id AND d.direction = s.direction AND ch BETWEEN channel_start AND channel_end GROUP BY ALL) a ON d.fiber_id = a.fiber_id AND d.direction = a.direction AND d.ch = a.ch
LEFT JOIN (SELECT DISTINCT fiber_id, direction FROM sections) h ON d.fiber_id = h.fiber_id AND d.direction = h.direction""")
def _(v):
    fallback = v.cables().select("fiber_id", F.lit(70.0).alias("green"), F.lit(50.0).alias("yellow"), F.lit(20.0).alias("orange"))
    return joins.lookup_thresholds(v.detections(), v.sections(), fallback).select("seq", "green", "yellow")


@query("nearest_channel", """WITH p AS (SELECT c_custkey AS point_id, 7.2::DOUBLE + (c_custkey % 997) * 0.0002::DOUBLE AS px, 43.7::DOUBLE + (c_custkey % 499) * 0.0002::DOUBLE AS py FROM customer), q AS (SELECT point_id, sqrt((lng - px) ** 2 + (lat - py) ** 2) AS dist, fiber_id, ch FROM p JOIN geo ON abs(lng - px) <= 0.01 AND abs(lat - py) <= 0.01 WHERE lng IS NOT NULL)
SELECT point_id, b.fiber_id, b.ch, b.dist FROM (SELECT point_id, min({'dist': dist, 'fiber_id': fiber_id, 'ch': ch}) AS b FROM q WHERE dist <= 0.01 GROUP BY point_id)""")
def _(v):
    k = F.col("c_custkey")
    p = v.table("customer").select(k.alias("point_id"), (F.lit(7.2) + (k % 997) * 0.0002).alias("lng"), (F.lit(43.7) + (k % 499) * 0.0002).alias("lat"))
    return joins.nearest_channel(p, v.geo(), 0.01)


@query("infra_detections", "SELECT seq, 'b-' || fiber_id AS infra_id FROM detections WHERE ch BETWEEN 10 AND 40 UNION ALL SELECT seq, 't-' || fiber_id FROM detections WHERE ch BETWEEN 30 AND 90 AND direction = 1")
def _(v):
    ids = v.cables().select("fiber_id")
    infra = ids.select(F.concat(F.lit("b-"), "fiber_id").alias("infra_id"), "fiber_id", F.lit(None).cast("int").alias("direction"), F.lit(10).alias("channel_start"), F.lit(40).alias("channel_end"))
    infra = infra.unionByName(ids.select(F.concat(F.lit("t-"), "fiber_id").alias("infra_id"), "fiber_id", F.lit(1).alias("direction"), F.lit(30).alias("channel_start"), F.lit(90).alias("channel_end")))
    return joins.infra_det(infra, v.detections()).select("seq", "infra_id")


@query("fiber_listing", "SELECT fiber_id, 150 AS channels, epoch_us(min(date_trunc('hour', ts))) AS first_us, epoch_us(max(date_trunc('hour', ts))) AS last_us FROM detections WHERE fiber_id IN ('purchase', 'view', 'error') GROUP BY ALL")
def _(v):
    return joins.fiber_listing(v.assignments(), v.cables(), rollups.rollup_1h(rollups.rollup_1m(v.detections())), "B")


@query("alert_log_view", f"WITH {_FIRED} SELECT rule_id, org, ts_ns FROM fired JOIN rules USING (rule_id) WHERE org = 'A'")
def _(v):
    log = alerts.eval_detection_rules(v.detections_dense(), v.rules(), v.assignments())
    return joins.alert_log_view(log, v.rules(), "A").select("rule_id", "org", "ts_ns")


@query("adjacent_pairs", 'SELECT fiber_id, "window", pos AS pair, t, v, v_next FROM (SELECT *, lead(v) OVER (PARTITION BY fiber_id, "window", t ORDER BY pos) AS v_next FROM win) WHERE v_next IS NOT NULL')
def _(v):
    return joins.pairs(v.windows(), ["fiber_id", "window", "t"])


@query("compare_periods", f"""WITH c AS (SELECT avg(freq) AS m, stddev_pop(freq) AS s, count(*) AS n FROM peak_freqs WHERE us >= {T0_US} + 15 * 86400000000 AND us < {T0_US} + 16 * 86400000000 AND freq BETWEEN 1.06 AND 1.16),
p AS (SELECT avg(freq) AS m, stddev_pop(freq) AS s, count(*) AS n FROM peak_freqs WHERE us >= {T0_US} + 14 * 86400000000 AND us < {T0_US} + 15 * 86400000000 AND freq BETWEEN 1.06 AND 1.16)
SELECT c.m AS cur_mean, c.s AS cur_std, c.n AS cur_n, p.m AS prev_mean, p.s AS prev_std, p.n AS prev_n, c.m - p.m AS diff, (c.m - p.m) / p.m * 100 AS percent FROM c, p""")
def _(v):
    return joins.compare_periods(v.peak_freqs(), F.lit("2024-01-16 12:00:00").cast("timestamp"))


# signals ---------------------------------------------------------------------------
@query("spatial_decimate_scale", "SELECT fiber_id, ch, t_idx, v * 213.05::DOUBLE AS v FROM sig WHERE ch >= 10 AND ch < 70 AND (ch - 10) % 3 = 0")
def _(v):
    p = signals.build_pipeline([{"step": "scale", "params": {"factor": 213.05}}, {"step": "spatial_decimation", "params": {"factor": 3}}], (10, 70))
    return p(v.signal()).select("fiber_id", "ch", "t_idx", "v")


@query("common_mode_median", "SELECT fiber_id, ch, t_idx, v - median(v) OVER (PARTITION BY fiber_id, t_idx) AS v FROM sig")
def _(v):
    return signals.common_mode_removal(v.signal()).select("fiber_id", "ch", "t_idx", "v")


@query("common_mode_mean", "SELECT fiber_id, ch, t_idx, v - avg(v) OVER (PARTITION BY fiber_id, t_idx) AS v FROM sig")
def _(v):
    return signals.common_mode_removal(v.signal(), "mean").select("fiber_id", "ch", "t_idx", "v")


@query("warmup_drop", "SELECT fiber_id, ch, t_idx, v FROM sig WHERE t_idx >= 20")
def _(v):
    s = v.signal().withColumn("frame_seq", F.floor(F.col("t_idx") / 4)).withColumn("sample", F.col("t_idx") % 4)
    return signals.warmup_drop(s, 1.8, 10.0).select("fiber_id", "ch", "t_idx", "v")


@query("temporal_decimate", "SELECT fiber_id, ch, t_idx, v FROM sig WHERE (t_idx + 1) % 12 = 0")
def _(v):
    return signals.temporal_decimate(v.signal(), 12).select("fiber_id", "ch", "t_idx", "v")


def _filter_sql(sos) -> str:
    """The cascade of sections as a recursion over time: states z and outputs o of each section."""
    d, first, step = "CAST({!r} AS DOUBLE)".format, [], []
    for k, (b0, b1, b2, _, a1, a2) in enumerate(sos.tolist()):
        for out, x, z in ((first, "v" if k == 0 else f"p{k - 1}", ("0.0::DOUBLE", "0.0::DOUBLE")), (step, "s.v" if k == 0 else f"p{k - 1}", (f"r.y{k}", f"r.z{k}"))):
            out += [f"{d(b0)} * {x} + {z[0]} AS p{k}", f"{d(b1)} * {x} - {d(a1)} * p{k} + {z[1]} AS q{k}", f"{d(b2)} * {x} - {d(a2)} * p{k} AS w{k}"]
    names = ", ".join(f"o{k}, y{k}, z{k}" for k in range(len(sos)))
    return f"""WITH RECURSIVE r(fiber_id, ch, t_idx, {names}) AS (SELECT fiber_id, ch, t_idx, {', '.join(first)} FROM sig WHERE t_idx = 0
UNION ALL SELECT s.fiber_id, s.ch, s.t_idx, {', '.join(step)} FROM r JOIN sig s ON s.fiber_id = r.fiber_id AND s.ch = r.ch AND s.t_idx = r.t_idx + 1) SELECT fiber_id, ch, t_idx, round_even(o{len(sos) - 1}, 9) AS v FROM r"""


@query("bandpass", _filter_sql(kernels.butter_bandpass_sos(0.3, 2.0, 10.4167)))
def _(v):
    return signals.bandpass(v.signal(), 0.3, 2.0, 10.4167).select("fiber_id", "ch", "t_idx", F.bround("v", 9).alias("v"))


@query("bandpass_zero_phase")
def _(v):
    return signals.bandpass_zero_phase(v.signal(), 0.3, 2.0, 10.4167).select("fiber_id", "ch", "t_idx", "v")


@query("channel_profile", "SELECT fiber_id, ch, avg(v) AS mean, stddev_pop(v) AS std, max(abs(v)) AS peak, sqrt(avg(v * v)) AS rms, stddev_pop(v) < 1e-6 AS dead FROM sig GROUP BY ALL")
def _(v):
    return signals.channel_profile(v.signal())


@query("demean_zscore", "WITH d AS (SELECT fiber_id, ch, t_idx, v - avg(v) OVER (PARTITION BY fiber_id, ch) AS v FROM sig) SELECT fiber_id, ch, t_idx, (v - avg(v) OVER (PARTITION BY fiber_id)) / (stddev_pop(v) OVER (PARTITION BY fiber_id) + 1e-8::DOUBLE) AS v FROM d")
def _(v):
    return signals.zscore(signals.demean(v.signal()), ("fiber_id",)).select("fiber_id", "ch", "t_idx", F.bround("v", 9).alias("v")).select("fiber_id", "ch", "t_idx", "v")


ORACLES["demean_zscore"] = ORACLES["demean_zscore"].replace("(v - avg(v) OVER (PARTITION BY fiber_id)) / (stddev_pop(v) OVER (PARTITION BY fiber_id) + 1e-8::DOUBLE) AS v", "round_even((v - avg(v) OVER (PARTITION BY fiber_id)) / (stddev_pop(v) OVER (PARTITION BY fiber_id) + 1e-8::DOUBLE), 9) AS v")


@query("normalize_energy", """WITH d AS (SELECT fiber_id, ch, t_idx, v - avg(v) OVER (PARTITION BY fiber_id, ch) AS v FROM sig), e AS (SELECT fiber_id, ch, sum(v * v) AS e FROM d GROUP BY ALL), m AS (SELECT fiber_id, avg(e) AS m FROM e GROUP BY ALL)
SELECT fiber_id, ch, t_idx, round_even(v * CASE WHEN e > 0 THEN sqrt(m / e) ELSE 1 END, 9) AS v FROM d JOIN e USING (fiber_id, ch) JOIN m USING (fiber_id)""")
def _(v):
    return signals.normalize_energy(v.signal()).select("fiber_id", "ch", "t_idx", F.bround("v", 9).alias("v"))


@query("spatial_windows", 'SELECT fiber_id, "window", pos, t, v FROM win')
def _(v):
    return v.windows()


@query("time_windows", "SELECT fiber_id, ch, w.w::INT AS t_window, (t_idx - w.w * 12)::INT AS t, v FROM sig JOIN range(20) w(w) ON w.w * 12 <= t_idx AND t_idx < w.w * 12 + 16 AND w.w * 12 + 16 <= 64")
def _(v):
    return signals.time_windows(v.signal(), 16, 12).select("fiber_id", "ch", "t_window", "t", "v")


@query("edge_trim", 'SELECT fiber_id, "window", pos, t, v FROM win WHERE t BETWEEN 15 AND 48')
def _(v):
    return signals.edge_trim(v.windows(), 64, 48).select("fiber_id", "window", "pos", "t", "v")


@query("both_directions", "SELECT fiber_id, 0 AS direction, ch, t_idx, v FROM sig UNION ALL SELECT fiber_id, 1, (m - ch)::INT, t_idx, v FROM sig JOIN (SELECT fiber_id, max(ch) AS m FROM sig GROUP BY ALL) USING (fiber_id)")
def _(v):
    return signals.both_directions(v.signal()).select("fiber_id", "direction", "ch", "t_idx", "v")


@query("training_windows", """WITH w9 AS (SELECT fiber_id, i // 9 AS w, i % 9 AS pos, t_idx, v FROM si WHERE i // 9 * 9 + 9 <= n), x AS (SELECT fiber_id, w, tw.tw, pos, t_idx - tw.tw * 16 AS t, v FROM w9 JOIN range(4) tw(tw) ON tw.tw * 16 <= t_idx AND t_idx < tw.tw * 16 + 32 AND tw.tw * 16 + 32 <= 64),
s AS (SELECT *, stddev_pop(v) OVER p AS sd, avg(v) OVER p AS m FROM x WINDOW p AS (PARTITION BY fiber_id, w, tw))
SELECT fiber_id, w::INT AS "window", tw::INT AS t_window, pos::INT AS pos, t::INT AS t, round_even((v - m) / sd, 9) AS v FROM s WHERE sd >= 1e-8""")
def _(v):
    return signals.training_windows(v.signal(), 9, 32, 9, 16).select("fiber_id", "window", "t_window", "pos", "t", F.bround("v", 9).alias("v"))


@query("waterfall", "WITH d AS (SELECT fiber_id, ch, t_idx, v - avg(v) OVER (PARTITION BY fiber_id, ch) AS v FROM sig), b AS (SELECT fiber_id, ch // 5 AS d, t_idx // 8 AS t, avg(v) AS amp FROM d GROUP BY ALL) SELECT fiber_id, d::BIGINT AS d, t::BIGINT AS t, round_even(amp, 9) AS amp, round_even(2 * stddev_pop(amp) OVER (PARTITION BY fiber_id), 9) AS range, d * 5 * 15.3846::DOUBLE / 1000 AS km FROM b")
def _(v):
    return signals.waterfall(v.signal(), 15.3846, 5, 8).withColumn("amp", F.bround("amp", 9)).withColumn("range", F.bround("range", 9))


@query("waterfall_marks", "SELECT seq, ch * 15.3846::DOUBLE / 1000 AS km, greatest(lo, least(hi, speed)) AS colour FROM detections_dense JOIN (SELECT fiber_id, quantile_cont(speed, 0.02) AS lo, quantile_cont(speed, 0.98) AS hi FROM detections_dense GROUP BY ALL) USING (fiber_id)")
def _(v):
    return signals.waterfall_marks(v.detections_dense(), 15.3846, exact=True).select("seq", "km", "colour")


# detection -------------------------------------------------------------------------
@query("glrt", 'SELECT fiber_id, "window", pair, t, round_even(g, 12) AS g FROM g')
def _(v):
    return detection.glrt_windows(v.signal(), 9, 3).withColumn("g", F.bround("g", 12))


@query("glrt_plain", 'SELECT fiber_id, "window", pair, t, round_even(s, 12) AS g FROM (SELECT *, sum(p) OVER (PARTITION BY fiber_id, "window", pair ORDER BY t ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING) AS s FROM (SELECT fiber_id, "window", pos AS pair, t, v * lead(v) OVER (PARTITION BY fiber_id, "window", t ORDER BY pos) AS p FROM win) WHERE p IS NOT NULL) WHERE t < 44')
def _(v):
    return detection.glrt_windows(v.signal(), 9, 3, 20, None).withColumn("g", F.bround("g", 12))


@query("glrt_intervals", "SELECT * FROM iv")
def _(v):
    g = detection.glrt_sum(detection.glrt_windows(v.signal(), 9, 3))
    return detection.intervals(detection.mask(g, 0.05)).select("fiber_id", "window", F.col("start_idx").cast("int").alias("start_idx"), F.col("end_idx").cast("int").alias("end_idx"))


def _speeds(v):
    """A made displacement by pair and time, so that speeds follow from the data in SQL too."""
    g = detection.glrt_windows(v.signal(), 9, 3)
    return detection.pair_speed(g.withColumn("shift", F.lit(2.0) + F.col("pair") + (F.col("t") % 5) + F.col("g")), 10.4167, 15.3846)


_SPD = 'spd AS (SELECT fiber_id, "window", pair, t, g, abs((3.6::DOUBLE * 10.4167::DOUBLE * 15.3846::DOUBLE) / (2.0::DOUBLE + pair + t % 5 + g + 1e-8::DOUBLE)) AS speed FROM g)'


@query("pair_speed", f'WITH {_SPD} SELECT fiber_id, "window", pair, t, round_even(speed, 7) AS speed FROM spd')
def _(v):
    return _speeds(v).select("fiber_id", "window", "pair", "t", F.bround("speed", 7).alias("speed"))


_RUN = 'PARTITION BY fiber_id, "window", pair, mask'


@query("gate_speed", f"""WITH {_SPD}, m AS (SELECT *, g >= 0.01 AS mask FROM spd), r AS (SELECT *, t - row_number() OVER ({_RUN} ORDER BY t) AS run FROM m), e AS (SELECT *, min(t) OVER ({_RUN}, run) AS a, max(t) OVER ({_RUN}, run) + 1 AS b FROM r),
f AS (SELECT *, max(CASE WHEN t = least((a + b) // 2, b - 1) THEN speed END) OVER ({_RUN}, run) AS rep FROM e)
SELECT fiber_id, "window", pair, t, round_even(CASE WHEN NOT mask THEN 0 WHEN rep BETWEEN 60 AND 120 THEN speed END, 7) AS speed FROM f""")
def _(v):
    s = _speeds(v)
    gated = detection.gate_speed(s, detection.mask(s, 0.01), 60, 120)
    return gated.withColumn("speed", F.bround("speed", 7))


@query("fuse_pair_speed", f'WITH {_SPD} SELECT fiber_id, "window", t, round_even(CASE WHEN sum(greatest(g, 0)) FILTER (ok) > 0 THEN sum(speed * g) FILTER (ok) / sum(g) FILTER (ok) ELSE median(speed) FILTER (ok) END, 6) AS speed FROM (SELECT *, speed BETWEEN 20 AND 120 AND g > 0 AS ok FROM spd) GROUP BY ALL')
def _(v):
    s = _speeds(v)
    return detection.fuse_pair_speed(s, s).withColumn("speed", F.bround("speed", 6))


@query("section_speed", f'WITH {_SPD} SELECT fiber_id, "window", t, round_even(median(speed), 6) AS speed FROM spd GROUP BY ALL')
def _(v):
    return detection.section_speed(_speeds(v)).withColumn("speed", F.bround("speed", 6))


@query("interval_speed", f'WITH {_SPD} SELECT fiber_id, "window", start_idx, end_idx, round_even(median(m), 6) AS speed FROM (SELECT s.fiber_id, s."window", start_idx, end_idx, pair, median(speed) AS m FROM spd s JOIN iv i ON s.fiber_id = i.fiber_id AND s."window" = i."window" AND t >= start_idx AND t < end_idx WHERE speed > 0 GROUP BY ALL) GROUP BY ALL')
def _(v):
    g = detection.glrt_sum(detection.glrt_windows(v.signal(), 9, 3))
    out = detection.interval_speed(detection.intervals(detection.mask(g, 0.05)), _speeds(v))
    return out.select("fiber_id", "window", F.col("start_idx").cast("int").alias("start_idx"), F.col("end_idx").cast("int").alias("end_idx"), F.bround("speed", 6).alias("speed"))


@query("interval_strain", 'SELECT fiber_id, "window", start_idx, end_idx, round_even(avg(p), 9) AS strain_peak, round_even(avg(r), 9) AS strain_rms FROM (SELECT w.fiber_id, w."window", start_idx, end_idx, pos, max(abs(v)) AS p, sqrt(avg(v * v)) AS r FROM win w JOIN iv i ON w.fiber_id = i.fiber_id AND w."window" = i."window" AND t >= start_idx AND t < end_idx GROUP BY ALL) GROUP BY ALL')
def _(v):
    g = detection.glrt_sum(detection.glrt_windows(v.signal(), 9, 3))
    out = detection.interval_strain(detection.intervals(detection.mask(g, 0.05)), v.windows())
    return out.select("fiber_id", "window", F.col("start_idx").cast("int").alias("start_idx"), F.col("end_idx").cast("int").alias("end_idx"), F.bround("strain_peak", 9).alias("strain_peak"), F.bround("strain_rms", 9).alias("strain_rms"))


#: Vehicles of intervals ``ivs(fiber_id, window, start_idx, end_idx, detect, classify)``: strict maxima of ``gs`` inside that reach a height and stand out; else the highest sample.
_PEAKS = """seg AS (SELECT i.*, t, g, lag(g) OVER o AS g0, lead(g) OVER o AS g1 FROM ivs i JOIN gs USING (fiber_id, "window") WHERE t >= start_idx AND t < end_idx WINDOW o AS (PARTITION BY fiber_id, "window", start_idx ORDER BY t)),
top AS (SELECT * FROM seg WHERE g > g0 AND g > g1 AND g >= detect),
edge AS (SELECT p.fiber_id, p."window", p.start_idx, p.t, any_value(p.g) AS g, coalesce(max(q.t) FILTER (q.t < p.t AND q.g > p.g), -1) AS lo, coalesce(min(q.t) FILTER (q.t > p.t AND q.g > p.g), 1000000) AS hi FROM top p JOIN seg q ON p.fiber_id = q.fiber_id AND p."window" = q."window" AND p.start_idx = q.start_idx GROUP BY ALL),
low AS (SELECT e.fiber_id, e."window", e.start_idx, e.t, any_value(e.g) AS g, min(q.g) FILTER (q.t <= e.t AND q.t > lo) AS a, min(q.g) FILTER (q.t >= e.t AND q.t < hi) AS b FROM edge e JOIN seg q ON e.fiber_id = q.fiber_id AND e."window" = q."window" AND e.start_idx = q.start_idx GROUP BY e.fiber_id, e."window", e.start_idx, e.t, lo, hi),
found AS (SELECT i.fiber_id, i."window", i.start_idx, count(l.t) AS n, count(l.t) FILTER (l.g >= classify) AS trucks FROM ivs i LEFT JOIN low l ON i.fiber_id = l.fiber_id AND i."window" = l."window" AND i.start_idx = l.start_idx AND l.g - greatest(a, b) >= greatest(1, 0.1::DOUBLE * detect) GROUP BY ALL),
high AS (SELECT fiber_id, "window", start_idx, max(g) AS m FROM seg GROUP BY ALL),
counted AS (SELECT i.*, m AS glrt_max, CASE WHEN n > 0 THEN n WHEN m >= detect THEN 1 ELSE 0 END AS n, CASE WHEN n > 0 THEN n - trucks WHEN m >= detect AND m < classify THEN 1 ELSE 0 END AS cars, CASE WHEN n > 0 THEN trucks WHEN m >= detect AND m >= classify THEN 1 ELSE 0 END AS trucks
FROM ivs i JOIN found USING (fiber_id, "window", start_idx) JOIN high USING (fiber_id, "window", start_idx))"""


def _aligned_sql(lag: int) -> str:
    """Views shift (a channel pair's displacement in samples) and al (windows moved by them)."""
    return f"""c AS (SELECT a.fiber_id, a.i, l.l AS lag, sum(a.v * b.v) AS s FROM si a JOIN range(-{lag}, {lag + 1}) l(l) ON true JOIN si b ON b.fiber_id = a.fiber_id AND b.i = a.i + 1 AND b.t_idx = a.t_idx + l.l GROUP BY ALL), shift AS (SELECT fiber_id, i, -arg_max(lag, s) AS shift FROM c GROUP BY ALL),
cs AS (SELECT chs.fiber_id, chs.i, n, coalesce(sum(shift) OVER (PARTITION BY chs.fiber_id ORDER BY chs.i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS c FROM chs LEFT JOIN shift USING (fiber_id, i)),
moved AS (SELECT a.fiber_id, w.w, a.i, b.c - a.c AS shift FROM cs a JOIN range(1000) w(w) ON w.w * 3 <= a.i AND a.i < w.w * 3 + 9 AND w.w * 3 + 9 <= a.n JOIN cs b ON b.fiber_id = a.fiber_id AND b.i = w.w * 3 + 4),
al AS (SELECT moved.fiber_id, w::INT AS "window", (moved.i - w * 3)::INT AS pos, t.t::INT AS t, si.v FROM moved JOIN range(64) t(t) ON true JOIN si ON si.fiber_id = moved.fiber_id AND si.i = moved.i AND si.t_idx = greatest(0, least(63, t.t + moved.shift)))"""


@query("align_shift", f'WITH {_aligned_sql(5)} SELECT fiber_id, "window", pos, t, round_even(v, 9) AS v FROM al')
def _(v):
    s = v.signal()
    return detection.align_windows(s, detection.pair_lags(s, 5, 9, 3), 9, 3).withColumn("v", F.bround("v", 9))


@query("extract_detections", f"""WITH {_aligned_sql(3)}, ivs AS (SELECT fiber_id, "window", start_idx, end_idx, 0.05::DOUBLE AS detect, 0.1::DOUBLE AS classify FROM iv WHERE end_idx - start_idx >= 3), {_PEAKS},
sp AS (SELECT fiber_id, w.w::INT AS "window", median(abs((3.6::DOUBLE * 10.4167::DOUBLE * 15.3846::DOUBLE) / (abs(shift) + 6 + 1e-8::DOUBLE))) AS speed FROM shift JOIN chs USING (fiber_id, i) JOIN range(1000) w(w) ON w.w * 3 <= i AND i < w.w * 3 + 8 AND w.w * 3 + 9 <= n GROUP BY ALL),
st AS (SELECT fiber_id, "window", start_idx, avg(p) AS strain_peak, avg(r) AS strain_rms FROM (SELECT a.fiber_id, a."window", start_idx, pos, max(abs(v)) AS p, sqrt(avg(v * v)) AS r FROM al a JOIN ivs USING (fiber_id, "window") WHERE t >= start_idx AND t < end_idx GROUP BY ALL) GROUP BY ALL)
SELECT fiber_id, "window", start_idx, end_idx, ((start_idx + end_idx) // 2)::BIGINT AS t_mid, round_even(speed, 6) AS speed, round_even(glrt_max, 9) AS glrt_max, greatest(1, n)::DOUBLE AS vehicle_count, cars::DOUBLE AS n_cars, trucks::DOUBLE AS n_trucks, round_even(strain_peak, 9) AS strain_peak, round_even(strain_rms, 9) AS strain_rms, ("window" * 3)::INT AS ch
FROM counted JOIN sp USING (fiber_id, "window") JOIN st USING (fiber_id, "window", start_idx) WHERE speed BETWEEN 20 AND 120""")
def _(v):
    s, g = v.signal(), detection.glrt_windows(v.signal(), 9, 3)
    lags = detection.pair_lags(s, 3, 9, 3)
    aligned = detection.align_windows(s, lags, 9, 3)
    s = detection.pair_speed(detection.over_time(lags).withColumn("shift", F.abs("shift") + 6), 10.4167, 15.3846)
    out = detection.map_channel(detection.extract_detections(detection.glrt_sum(g), s, aligned, 10.4167, 0.05 / 8), 0, 3)
    ints, rounded = ("start_idx", "end_idx"), {"speed": 6, "glrt_max": 9, "strain_peak": 9, "strain_rms": 9}
    return out.select(*[F.col(c).cast("int").alias(c) if c in ints else F.bround(c, rounded[c]).alias(c) if c in rounded else c for c in out.columns])


@query("coupling_mask", 'SELECT fiber_id, "window", t, g * (1 + "window" % 3) AS g, g * (1 + "window" % 3) >= 0.02 * (1 + "window" % 2) AS mask FROM gs')
def _(v):
    g = detection.glrt_sum(detection.glrt_windows(v.signal(), 9, 3))
    c = g.select("fiber_id", F.col("window").alias("section_idx")).distinct().withColumn("correction", (1 + F.col("section_idx") % 3).cast("double")).withColumn("threshold", 0.02 * (1 + F.col("section_idx") % 2))
    return detection.mask_by_section(detection.coupling_correct(g, c), c, 1.0).select("fiber_id", "window", "t", "g", "mask")


# calibration -----------------------------------------------------------------------
_CG = """cg AS (SELECT fiber_id, w AS section_idx, t, sum(c) AS g FROM (SELECT fiber_id, w, pos, t, CASE WHEN t >= 20 AND t < 44 THEN coalesce(CASE WHEN isnan(r) THEN 0 ELSE r * r END, 0) ELSE 0 END AS c FROM (SELECT *, corr(v, v2) OVER (PARTITION BY fiber_id, w, pos ORDER BY t ROWS BETWEEN 10 PRECEDING AND 9 FOLLOWING) AS r FROM
(SELECT fiber_id, "window" AS w, pos, t, v, lead(v) OVER (PARTITION BY fiber_id, "window", t ORDER BY pos) AS v2 FROM win) WHERE v2 IS NOT NULL)) GROUP BY ALL)"""


@query("glrt_corr", f"WITH {_CG} SELECT fiber_id, section_idx, t, round_even(g, 8) AS g FROM cg")
def _(v):
    return calibration.glrt_corr(v.signal(), 20, 9, 3).withColumn("g", F.bround("g", 8))


@query("threshold_curve", f"WITH {_CG}, m AS (SELECT fiber_id, section_idx, median(g) AS b FROM cg WHERE g > 0 GROUP BY ALL) SELECT fiber_id, section_idx, round_even(b + 5 * median(abs(g - b)), 7) AS threshold, round_even(b, 7) AS baseline, round_even(median(abs(g - b)), 7) AS noise FROM cg JOIN m USING (fiber_id, section_idx) WHERE g > 0 GROUP BY fiber_id, section_idx, b")
def _(v):
    t = calibration.threshold_curve(calibration.glrt_corr(v.signal(), 20, 9, 3))
    return t.select("fiber_id", "section_idx", *[F.bround(c, 7).alias(c) for c in ("threshold", "baseline", "noise")])


@query("coupling_factors", f"WITH {_CG}, m AS (SELECT fiber_id, section_idx, coalesce(median(g) FILTER (g > 0), 1) AS m FROM cg GROUP BY ALL) SELECT fiber_id, section_idx, round_even(median(m) OVER (PARTITION BY fiber_id) / greatest(m, 1e-8), 7) AS correction FROM m")
def _(v):
    c = calibration.coupling_factors(calibration.glrt_corr(v.signal(), 20, 9, 3))
    return c.select("fiber_id", "section_idx", F.bround("correction", 7).alias("correction"))


@query("threshold_sweep", 'SELECT fiber_id, "window" AS section_idx, x.x::DOUBLE AS threshold, sum((g >= x.x AND NOT coalesce(p >= x.x, false))::INT)::BIGINT AS edges FROM (SELECT *, lag(g) OVER (PARTITION BY fiber_id, "window" ORDER BY t) AS p FROM gs), (VALUES (0.01), (0.05), (0.1)) x(x) GROUP BY ALL')
def _(v):
    g = detection.glrt_sum(detection.glrt_windows(v.signal(), 9, 3)).withColumnRenamed("window", "section_idx")
    return calibration.threshold_sweep(g, [0.01, 0.05, 0.1])


# counting --------------------------------------------------------------------------
@query("count_features", f"""WITH {_SPD} SELECT i.fiber_id, i."window", start_idx, end_idx, (end_idx - start_idx)::DOUBLE AS duration, round_even(gs, 8) AS glrt_sum, round_even(coalesce(sp, 0) / 3.6, 7) AS speed_ms, sum(end_idx - start_idx) OVER (PARTITION BY i.fiber_id, i."window") / 3750.0::DOUBLE AS occupancy, round_even(en, 8) AS energy FROM iv i
JOIN (SELECT i.fiber_id AS f, i."window" AS w, start_idx AS s, sum(g - 0.05) AS gs FROM iv i JOIN gs ON gs.fiber_id = i.fiber_id AND gs."window" = i."window" AND t >= start_idx AND t < end_idx GROUP BY ALL) a ON a.f = i.fiber_id AND a.w = i."window" AND a.s = start_idx
JOIN (SELECT i.fiber_id AS f, i."window" AS w, start_idx AS s, median(speed) AS sp FROM iv i JOIN spd ON spd.fiber_id = i.fiber_id AND spd."window" = i."window" AND t >= start_idx AND t < end_idx GROUP BY ALL) b ON b.f = i.fiber_id AND b.w = i."window" AND b.s = start_idx
JOIN (SELECT i.fiber_id AS f, i."window" AS w, start_idx AS s, sum(v * v) AS en FROM iv i JOIN win ON win.fiber_id = i.fiber_id AND win."window" = i."window" AND t >= start_idx AND t < end_idx GROUP BY ALL) c ON c.f = i.fiber_id AND c.w = i."window" AND c.s = start_idx""")
def _(v):
    g = detection.glrt_sum(detection.glrt_windows(v.signal(), 9, 3))
    iv = detection.intervals(detection.mask(g, 0.05)).withColumn("detect", F.lit(0.05))
    f = counting.count_features(iv, g, _speeds(v), v.windows(), 3750.0)
    return f.select("fiber_id", "window", F.col("start_idx").cast("int").alias("start_idx"), F.col("end_idx").cast("int").alias("end_idx"), "duration", F.bround("glrt_sum", 8).alias("glrt_sum"), F.bround("speed_ms", 7).alias("speed_ms"), "occupancy", F.bround("energy", 8).alias("energy"))


_NORM = [(20.0, 10.0), (50.0, 30.0), (20.0, 8.0), (0.01, 0.01), (5.0, 3.0)]
_NET = [([[0.1 * ((i * 5 + j) % 7 - 3) for j in range(5)] for i in range(10)], [0.1] * 10), ([[0.1 * ((i * 10 + j) % 5 - 1) for j in range(10)] for i in range(5)], [0.1] * 5), ([[0.5, 0.4, 0.3, 0.2, 0.1]], [0.2])]


def _net_sql(table: str) -> str:
    """The dense net as nested selects over ``table``, with its output as raw."""
    d = "CAST({!r} AS DOUBLE)".format
    x, sql = [f"(({c} - {d(m)}) / {d(s)})" for c, (m, s) in zip(counting.FEATURES, _NORM)], table
    for k, (w, b) in enumerate(_NET):
        rows = [" + ".join([d(bi), *(f"{xi} * {d(wi)}" for xi, wi in zip(x, row))]) for row, bi in zip(w, b)]
        last = k == len(_NET) - 1
        cols = [f"{r} AS raw" if last else f"greatest(0, {r}) AS h{k}_{i}" for i, r in enumerate(rows)]
        sql, x = f"(SELECT *, {', '.join(cols)} FROM {sql})", [f"h{k}_{i}" for i in range(len(rows))]
    return sql


@query("count_vehicles", f"""WITH {_SPD}, gh AS (SELECT fiber_id, "window", t, g * 100 AS g FROM gs), ih AS (SELECT fiber_id, "window", min(t)::INT AS start_idx, (max(t) + 1)::INT AS end_idx FROM (SELECT *, t - row_number() OVER (PARTITION BY fiber_id, "window" ORDER BY t) AS r FROM gh WHERE g >= 5.0) GROUP BY fiber_id, "window", r),
ivs AS (SELECT *, CASE "window" WHEN 1 THEN 6.0::DOUBLE ELSE 5.0 END AS detect, CASE "window" WHEN 1 THEN 12.0::DOUBLE ELSE 10.0 END AS classify FROM ih), {_PEAKS.replace("JOIN gs USING", "JOIN gh USING")},
a1 AS (SELECT fiber_id, "window", start_idx, sum(g - 5.0) AS glrt_sum FROM gh JOIN ih USING (fiber_id, "window") WHERE t >= start_idx AND t < end_idx GROUP BY ALL), a2 AS (SELECT fiber_id, "window", start_idx, coalesce(median(speed), 0) / 3.6::DOUBLE AS speed_ms FROM spd JOIN ih USING (fiber_id, "window") WHERE t >= start_idx AND t < end_idx GROUP BY ALL),
a3 AS (SELECT fiber_id, "window", start_idx, sum(v * v) AS energy FROM win JOIN ih USING (fiber_id, "window") WHERE t >= start_idx AND t < end_idx GROUP BY ALL), a4 AS (SELECT fiber_id, "window", sum(end_idx - start_idx) / 3750.0::DOUBLE AS occupancy FROM ih GROUP BY ALL),
f AS (SELECT c.fiber_id, c."window", c.start_idx, c.end_idx, n AS lambda_n, (end_idx - start_idx)::DOUBLE AS duration, glrt_sum, speed_ms, occupancy, energy FROM counted c JOIN a1 USING (fiber_id, "window", start_idx) JOIN a2 USING (fiber_id, "window", start_idx) JOIN a3 USING (fiber_id, "window", start_idx) JOIN a4 USING (fiber_id, "window")),
r AS (SELECT *, max((raw <> 0)::INT) OVER (PARTITION BY fiber_id, "window") AS live FROM {_net_sql("f")})
SELECT fiber_id, "window", start_idx, end_idx, lambda_n::INT AS lambda_n, round_even(raw, 6) AS raw, round_even(CASE WHEN live = 0 THEN raw WHEN speed_ms = 0 THEN 0 ELSE least(greatest(raw, 0), greatest(1, ceil(duration / 10.4167::DOUBLE)), greatest(1, lambda_n * 3 + 2)) END, 6) AS count FROM r""")
def _(v):
    g = detection.glrt_sum(detection.glrt_windows(v.signal(), 9, 3)).withColumn("g", F.col("g") * 100)
    iv = detection.intervals(detection.mask(g, 5.0))
    thr = v.spark.createDataFrame([(0, 5.0, 10.0), (1, 6.0, 12.0)], "section_idx int, detect double, classify double")
    lam = counting.lambda_count(iv, g, thr, 10.4167, 5.0, 10.0)
    feats = counting.count_features(iv.withColumn("detect", F.lit(5.0)), g, _speeds(v), v.windows(), 3750.0)
    raw = counting.score_counts(feats, _NORM, _NET)
    rows = raw.join(lam.select("fiber_id", "window", "start_idx", F.col("n").alias("lambda_n")), ["fiber_id", "window", "start_idx"])
    ints = [F.col(c).cast("int").alias(c) for c in ("start_idx", "end_idx", "lambda_n")]
    return counting.cap_counts(rows, 10.4167).select("fiber_id", "window", *ints, F.bround("raw", 6).alias("raw"), F.bround("count", 6).alias("count"))


@query("collapse_sections", f'WITH {_SPD} SELECT fiber_id, t, round_even(avg(g), 9) AS g, round_even(median(speed), 6) AS speed, round_even(avg(v), 9) AS v FROM spd JOIN win w USING (fiber_id, "window", t) WHERE w.pos = pair GROUP BY ALL')
def _(v):
    s = _speeds(v).join(v.windows().withColumnRenamed("pos", "pair"), ["fiber_id", "window", "pair", "t"])
    return counting.collapse_sections(s).select("fiber_id", "t", F.bround("g", 9).alias("g"), F.bround("speed", 6).alias("speed"), F.bround("v", 9).alias("v"))


@query("apply_counts", "WITH d AS (SELECT fiber_id, seq, seq % 300 AS t_mid FROM detections), b AS (SELECT fiber_id, max(t_mid) + 1 AS b FROM d GROUP BY ALL) SELECT seq, CASE WHEN 3750 - b + t_mid >= 3500 AND 3750 - b + t_mid < 3600 THEN 4 WHEN 3750 - b + t_mid >= 3550 AND 3750 - b + t_mid < 3700 THEN 1 ELSE 2 END::DOUBLE AS vehicle_count FROM d JOIN b USING (fiber_id)")
def _(v):
    d = v.detections().withColumn("t_mid", F.col("seq") % 300).withColumn("vehicle_count", F.lit(2.0))
    iv = v.cables().select("fiber_id", F.inline(F.array(*[F.struct(F.lit(i).alias("idx"), F.lit(a).alias("start_idx"), F.lit(b).alias("end_idx"), F.lit(c).alias("count")) for i, a, b, c in ((0, 3500, 3600, 4.0), (1, 3550, 3700, 0.4))])))
    return counting.apply_counts(d, iv, 3750).select("seq", "vehicle_count")


# geometry --------------------------------------------------------------------------
@query("offset_polyline", """WITH d AS (SELECT *, lng - lag(lng) OVER w AS dx1, lat - lag(lat) OVER w AS dy1, lead(lng) OVER w - lng AS dx2, lead(lat) OVER w - lat AS dy2 FROM wgeo, range(2) r(direction) WHERE lng IS NOT NULL WINDOW w AS (PARTITION BY fiber_id, direction ORDER BY ch)),
n AS (SELECT *, coalesce(dy1, 0) + coalesce(dy2, 0) AS nx, -(coalesce(dx1, 0) + coalesce(dx2, 0)) AS ny FROM d), s AS (SELECT *, CASE WHEN direction = 0 THEN 12 ELSE -12 END / sqrt((nx * 111320.0::DOUBLE * cos(radians(lat))) ** 2 + (ny * 111320.0::DOUBLE) ** 2) AS k FROM n)
SELECT fiber_id, direction::INT AS direction, ch, round_even(lng + nx * k, 9) AS lng, round_even(lat + ny * k, 9) AS lat FROM s""")
def _(v):
    g = v.wide_geo().withColumn("direction", F.explode(F.array(F.lit(0), F.lit(1))))
    out = geometry.offset_polyline(g, geometry.direction_offset(F.col("direction")))
    return out.select("fiber_id", "direction", "ch", F.bround("lng", 9).alias("lng"), F.bround("lat", 9).alias("lat"))


@query("expand_directions", "SELECT fiber_id, d::INT AS direction, false AS precomputed, channels::INT AS n FROM wfibers, range(2) r(d)")
def _(v):
    return geometry.expand_directions(v.wide_cables()).select("fiber_id", "direction", "precomputed", F.size("coordinates").alias("n"))


@query("landmarks", "SELECT fiber_id, ch, 'L' || ch AS label FROM wgeo WHERE ch % 25 = 0")
def _(v):
    return geometry.landmarks(v.wide_cables())


@query("section_coords", "SELECT section_id, count(*)::INT AS n, round_even(sum(lng), 7) AS x FROM wgeo JOIN wsections s ON s.fiber_id = wgeo.fiber_id AND ch BETWEEN channel_start AND channel_end WHERE lng IS NOT NULL GROUP BY ALL")
def _(v):
    p = geometry.section_coords(v.wide_sections(), v.wide_geo())
    return p.select("section_id", F.size("path").alias("n"), F.bround(F.aggregate("path", F.lit(0.0), lambda a, q: a + q["lng"]), 7).alias("x"))


@query("simplify_cables")
def _(v):
    g = v.wide_geo().withColumn("lat", F.col("lat") + F.when(F.col("ch") % 10 == 5, 0.01).otherwise(0.0))
    return geometry.simplify(g, 0.002)


@query("coverage_segments", "SELECT fiber_id, 30 AS lo, 80 AS hi, count(*)::INT AS n FROM wgeo WHERE ch BETWEEN 30 AND 80 AND lng IS NOT NULL GROUP BY ALL")
def _(v):
    cover = v.wide_cables().select("fiber_id", F.inline(F.array(F.struct(F.lit(30).alias("start"), F.lit(80).alias("end")), F.struct(F.lit(37).alias("start"), F.lit(38).alias("end")))))
    return geometry.coverage_segments(v.wide_geo(), cover).select("fiber_id", "lo", "hi", F.size("path").alias("n"))


@query("dense_index", "SELECT fiber_id, ch, (row_number() OVER (PARTITION BY fiber_id ORDER BY ch) - 1)::INT AS idx FROM wgeo WHERE lng IS NOT NULL")
def _(v):
    return geometry.dense_index(v.wide_geo()).select("fiber_id", "ch", "idx")


# structural health --------------------------------------------------------------------
@query("spectral_peaks")
def _(v):
    return health.spectral_peaks(v.spectra())


@query("shm_baseline", "SELECT infra_id, avg(freq) AS mean, stddev_samp(freq) AS std, count(*) AS n FROM peak_freqs GROUP BY ALL")
def _(v):
    return health.shm_baseline(v.peak_freqs())


@query("shm_baseline_robust", "WITH m AS (SELECT infra_id, median(freq) AS m, count(*) AS n FROM peak_freqs GROUP BY ALL) SELECT infra_id, m AS mean, median(abs(freq - m)) * 1.4826::DOUBLE AS std, n FROM peak_freqs JOIN m USING (infra_id) GROUP BY infra_id, m, n")
def _(v):
    return health.shm_baseline(v.peak_freqs(), robust=True)


_SHIFT = """b AS (SELECT infra_id, avg(freq) AS mean, stddev_samp(freq) AS std FROM peak_freqs WHERE us < {t} GROUP BY ALL), c AS (SELECT infra_id, avg(freq) AS current FROM peak_freqs WHERE us >= {t} GROUP BY ALL), s AS (SELECT *, current - mean AS delta, abs(current - mean) / std AS sigma FROM b JOIN c USING (infra_id))""".format(t=T0_US + 10 * 86_400_000_000)


@query("shm_shift", f"WITH {_SHIFT} SELECT infra_id, current, sigma, CASE WHEN abs(delta) < 1e-6 THEN 'stable' WHEN delta > 0 THEN 'increase' ELSE 'decrease' END AS direction, sigma >= 3 AS anomalous, CASE WHEN sigma < 2 THEN 'normal' WHEN sigma < 3 THEN 'warning' WHEN sigma < 4 THEN 'alert' ELSE 'critical' END AS severity FROM s")
def _(v):
    p, t = v.peak_freqs(), T0_US + 10 * 86_400_000_000
    rows = health.shm_shift(p.filter(F.unix_micros("ts") >= t), health.shm_baseline(p.filter(F.unix_micros("ts") < t)))
    return rows.select("infra_id", "current", "sigma", "direction", "anomalous", "severity")


@query("shm_status", f"WITH {_SHIFT} SELECT infra_id, CASE WHEN sigma < 2 THEN 'nominal' WHEN sigma < 4 THEN 'warning' ELSE 'critical' END AS status, round_even(current, 4) AS current, round_even(mean, 4) AS baseline, round_even(sigma, 2) AS sigma, CASE WHEN abs(delta) < 1e-6 THEN 'stable' WHEN delta > 0 THEN 'increase' ELSE 'decrease' END AS direction FROM s")
def _(v):
    p, t = v.peak_freqs(), T0_US + 10 * 86_400_000_000
    return health.shm_status_row(p.filter(F.unix_micros("ts") >= t), health.shm_baseline(p.filter(F.unix_micros("ts") < t)))


@query("shm_trend", "SELECT infra_id, round_even(regr_slope(freq, x) * 3600, 9) AS slope_hz_h, round_even(regr_r2(freq, x), 9) AS r2, CASE WHEN abs(regr_slope(freq, x) * 3600) < 0.01 THEN 'stable' WHEN regr_slope(freq, x) > 0 THEN 'increasing' ELSE 'decreasing' END AS direction, count(*) AS n FROM (SELECT infra_id, freq, (row_number() OVER (PARTITION BY infra_id ORDER BY ts) - 1)::DOUBLE AS x FROM peak_freqs) GROUP BY ALL")
def _(v):
    t = health.shm_trend(v.peak_freqs())
    return t.withColumn("slope_hz_h", F.bround("slope_hz_h", 9)).withColumn("r2", F.bround("r2", 9))


@query("shm_trend_sliding", "WITH x AS (SELECT infra_id, us, freq, (row_number() OVER (PARTITION BY infra_id ORDER BY ts) - 1)::DOUBLE AS x FROM peak_freqs) SELECT infra_id, us, CASE WHEN count(*) OVER w > 1 THEN round_even(regr_slope(freq, x) OVER w * 3600, 5) ELSE 0 END + 0.0::DOUBLE AS slope_hz_h, count(*) OVER w AS n FROM x WINDOW w AS (PARTITION BY infra_id ORDER BY x ROWS BETWEEN 49 PRECEDING AND CURRENT ROW)")
def _(v):
    t = health.shm_trend_sliding(v.peak_freqs(), 50)
    return t.select("infra_id", F.unix_micros("ts").alias("us"), (F.bround("slope_hz_h", 5) + 0.0).alias("slope_hz_h"), "n")


@query("peaks_query", "SELECT infra_id, us, freq FROM peak_freqs JOIN (SELECT infra_id, max(us) AS m FROM peak_freqs GROUP BY ALL) USING (infra_id) WHERE us >= m - 86400000000")
def _(v):
    return health.peaks_query(v.peak_freqs()).select("infra_id", F.unix_micros("ts").alias("us"), "freq")


@query("spectra_query", """WITH b AS (SELECT infra_id, min(t_idx) AS lo, max(t_idx) AS hi FROM spectra GROUP BY ALL), r AS (SELECT s.*, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY infra_id) AS n FROM spectra s JOIN b USING (infra_id) WHERE t_idx BETWEEN lo + (hi - lo) * 0.1::DOUBLE AND hi - (hi - lo) * 0.1::DOUBLE WINDOW w AS (PARTITION BY infra_id ORDER BY t_idx)),
k AS (SELECT * FROM r WHERE n <= 40 OR list_contains(list_transform(range(40), lambda j: floor(j * ((n - 1) / 39.0::DOUBLE))::BIGINT), i))
SELECT infra_id, t_idx, list_transform(list_transform(range(10), lambda j: power[floor(j * 63 / 9.0::DOUBLE)::INT + 1]), lambda x: round_even(log10(x + 1e-10::DOUBLE), 9)) AS power FROM k""")
def _(v):
    s = v.spectra()
    ends = s.groupBy("infra_id").agg(F.min("t_idx").alias("lo"), F.max("t_idx").alias("hi"))
    cut = (F.col("hi") - F.col("lo")) * 0.1
    out = health.spectra_query(s.join(ends, "infra_id"), F.col("lo") + cut, F.col("hi") - cut, 40, 10)
    return out.select("infra_id", "t_idx", F.transform("power", lambda x: F.bround(x, 9)).alias("power"))


@query("spectra_summary", "SELECT infra_id, count(*) AS samples, 64 AS bins, min(list_min(freqs)) AS f_min, max(list_max(freqs)) AS f_max, min(ts_us) AS t0_us, max(ts_us) AS end_us, (max(ts_us) - min(ts_us)) / 1e6::DOUBLE AS duration_s FROM spectra GROUP BY ALL")
def _(v):
    return health.spectra_summary(v.spectra())


_BAND = "(SELECT infra_id, avg(freq) AS m, stddev_pop(freq) AS s, count(*) AS n FROM peak_freqs WHERE us {c} AND freq BETWEEN 1.06 AND 1.16 GROUP BY ALL)"


@query("compare_bands", f"SELECT a.infra_id, a.m AS mean, a.s AS std, a.n, b.m AS mean_b, b.s AS std_b, b.n AS n_b, a.m - b.m AS diff, (a.m - b.m) / b.m * 100 AS percent FROM {_BAND.format(c=f'>= {T0_US + 10 * 86_400_000_000}')} a JOIN {_BAND.format(c=f'< {T0_US + 10 * 86_400_000_000}')} b USING (infra_id)")
def _(v):
    p, t = v.peak_freqs(), T0_US + 10 * 86_400_000_000
    return health.compare_bands(p.filter(F.unix_micros("ts") >= t), p.filter(F.unix_micros("ts") < t))


# ordered folds, tracks, incidents ---------------------------------------------------------
@query("ema", """WITH RECURSIVE r AS (SELECT fiber_id, direction, ch, seq, speed, row_number() OVER (PARTITION BY fiber_id, direction, ch ORDER BY ts_ns, speed) AS i FROM detections), e AS (SELECT fiber_id, direction, ch, seq, i, speed AS ema FROM r WHERE i = 1 UNION ALL SELECT r.fiber_id, r.direction, r.ch, r.seq, r.i, 0.3::DOUBLE * r.speed + (1 - 0.3::DOUBLE) * e.ema FROM e JOIN r ON r.fiber_id = e.fiber_id AND r.direction = e.direction AND r.ch = e.ch AND r.i = e.i + 1) SELECT seq, round_even(ema, 8) AS ema FROM e""")
def _(v):
    d = v.detections().select("fiber_id", "direction", "ch", "ts_ns", "seq", "speed")
    return ordered.ema(d, ["fiber_id", "direction", "ch"], "ts_ns", 0.3).select("seq", F.bround("ema", 8).alias("ema"))


def _arrivals(v):
    d = v.detections_dense().withColumn("ts_ms", S.ns_to_ms(F.col("ts_ns")))
    return d.withColumn("arrival_ms", F.col("ts_ms") + F.pmod(F.col("seq") * 37, F.lit(5000)))


_ARR = "a AS (SELECT fiber_id, seq, ts_ns // 1000000 AS ts_ms, ts_ns // 1000000 + seq * 37 % 5000 AS arrival_ms FROM detections_dense), d AS (SELECT *, list_sort(list(arrival_ms - ts_ms) OVER (PARTITION BY fiber_id ORDER BY arrival_ms, ts_ms ROWS BETWEEN 49 PRECEDING AND CURRENT ROW)) AS l FROM a), e AS (SELECT *, l[least(floor(len(l) * 0.9::DOUBLE), len(l) - 1)::INT + 1] + 15000.0::DOUBLE AS delay_ms FROM d)"


@query("delay_estimate", f"WITH {_ARR} SELECT fiber_id, sum(delay_ms) AS total, min(delay_ms) AS lo, max(delay_ms) AS hi FROM e GROUP BY ALL")
def _(v):
    return ordered.delay_estimate(_arrivals(v)).groupBy("fiber_id").agg(F.sum("delay_ms").alias("total"), F.min("delay_ms").alias("lo"), F.max("delay_ms").alias("hi"))


@query("release_schedule", f"WITH {_ARR} SELECT fiber_id, count(*) AS n, max(ceil(greatest(ts_ms + delay_ms, arrival_ms) / 100) * 100)::BIGINT AS last_ms FROM e GROUP BY ALL")
def _(v):
    return ordered.release_schedule(_arrivals(v)).groupBy("fiber_id").agg(F.count(F.lit(1)).alias("n"), F.max("release_ms").alias("last_ms"))


@query("smooth_counts", "SELECT seq, l[len(l) // 2 + 1] AS smooth FROM (SELECT seq, list_sort(list(vehicle_count) OVER (PARTITION BY fiber_id, direction, ch ORDER BY seq ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)) AS l FROM detections)")
def _(v):
    return ordered.smooth_counts(v.detections(), ["fiber_id", "direction", "ch"], "seq").select("seq", "smooth")


@query("track_vehicles")
def _(v):
    return ordered.track_vehicles(v.detections_dense())


@query("detect_incidents")
def _(v):
    return incidents.detect_incidents(v.detections_dense().withColumn("speed", F.col("speed") / 5), 90.0)


@query("section_barrier", "SELECT fiber_id, us // 60000000 AS \"window\" FROM detections_dense GROUP BY ALL HAVING count(DISTINCT floor(ch / 50)) FILTER (floor(ch / 50) IN (0, 1, 2)) = 3")
def _(v):
    w = v.detections_dense().select("fiber_id", F.floor(F.unix_micros("ts") / 60_000_000).alias("window"), F.floor(F.col("ch") / 50).cast("string").alias("section"))
    cfg = v.cables().select("fiber_id", F.explode(F.array(F.lit("0"), F.lit("1"), F.lit("2"))).alias("section"))
    return ordered.section_barrier(w, cfg)


# monitors, reports ---------------------------------------------------------------------
@query("window_metrics", """WITH d AS (SELECT fiber_id, us // 60000000 AS w, direction, count(*) AS n, max(glrt_max) AS m, median(abs(speed)) AS s FROM detections_dense WHERE speed > 40 GROUP BY ALL), a AS (SELECT DISTINCT fiber_id, us // 60000000 AS w FROM detections_dense)
SELECT fiber_id, w AS "window", 0 AS direction, coalesce(n, 0) AS n, coalesce(m, 0) AS glrt_max, coalesce(s, 0) AS speed FROM a LEFT JOIN (SELECT * FROM d WHERE direction = 0) USING (fiber_id, w) UNION ALL SELECT fiber_id, w, 1, n, m, s FROM d WHERE direction = 1""")
def _(v):
    d = v.detections_dense().withColumn("window", F.floor(F.unix_micros("ts") / 60_000_000))
    return monitors.window_metrics(d, d.filter("speed > 40"))


@query("rate_monitor", f"WITH n AS (SELECT fiber_id, (us - us % 600000000) // 1000000 AS sec, count(*) AS n, count(*) FILTER (speed > 200) AS bad FROM detections_dense GROUP BY ALL) SELECT fiber_id, {T0_US // 1_000_000} + k * 600 AS sec, coalesce(n, 0) / 600.0::DOUBLE AS rate, coalesce(bad / n::DOUBLE, 0) AS error_rate, coalesce(n, 0) = 0 AS no_data FROM fibers CROSS JOIN range(13) r(k) LEFT JOIN n ON n.fiber_id = fibers.fiber_id AND n.sec = {T0_US // 1_000_000} + k * 600".replace("SELECT fiber_id, 1704067200 + k", "SELECT fibers.fiber_id, 1704067200 + k"))
def _(v):
    return monitors.rate_monitor(v.detections_dense(), lit_us(T0_US), lit_us(T0_US + 7_200_000_000), 10, F.col("speed") > 200)


@query("tier_quantiles", "SELECT fiber_id, direction, epoch_us(date_trunc('hour', ts)) AS us, count(*) AS n, true AS p05, true AS p50, true AS p95 FROM detections_dense GROUP BY ALL")
def _(v):
    """Hours of sketches, merged from minutes, against the ranks of all rows: off by 2 % at most."""
    det, keys = v.detections_dense(), ["fiber_id", "direction", "ts"]
    tier = rollups.quantiles_1h(rollups.quantiles_1m(det))
    ps = {"p05": 0.05, "p50": 0.5, "p95": 0.95}
    q = tier.select(*keys, *[rollups.quantile_of("sketch", p).alias(f"q{c}") for c, p in ps.items()])
    rows = det.select("fiber_id", "direction", F.date_trunc("hour", "ts").alias("ts"), "speed").join(q, keys)
    share = lambda on: F.count_if(on) / F.count("speed")
    near = [((share(F.col("speed") < F.col(f"q{c}")) <= p + 0.02) & (share(F.col("speed") <= F.col(f"q{c}")) >= p - 0.02)).alias(c) for c, p in ps.items()]
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *near).select("fiber_id", "direction", F.unix_micros("ts").alias("us"), "n", *ps)


@query("quality_vs_yesterday", "WITH h AS (SELECT fiber_id, us // 3600000000 AS hour, median(glrt_max) AS m FROM detections GROUP BY ALL) SELECT a.fiber_id, a.hour, a.m, b.m AS m_before, a.m > 0 AND b.m > 0 AND a.m < 0.2 * b.m AS degraded FROM h a JOIN h b ON a.fiber_id = b.fiber_id AND a.hour = b.hour + 24")
def _(v):
    return monitors.quality_vs_yesterday(v.detections())


@query("speed_shift", "WITH r AS (SELECT fiber_id, us // 900000000 AS k, speed FROM detections), x AS (SELECT fiber_id, k, k + j AS q, speed FROM r, range(8) t(j)), m AS (SELECT fiber_id, q, median(speed) FILTER (q = k) AS short, median(speed) AS long FROM x GROUP BY ALL) SELECT fiber_id, (q + 1) * 900 AS sec, short, long, abs(short - long) > 15 AND short > 10 AND long > 10 AS shifted FROM m WHERE short IS NOT NULL")
def _(v):
    return monitors.speed_shift(v.detections(), exact=True)


@query("stage_percentiles", "SELECT fiber_id, 'd' || direction AS stage, quantile_cont(speed, 0.5) AS p50, quantile_cont(speed, 0.95) AS p95, count(*) AS n FROM detections GROUP BY ALL")
def _(v):
    return monitors.stage_percentiles(v.detections().select("fiber_id", F.concat(F.lit("d"), F.col("direction").cast("string")).alias("stage"), F.col("speed").alias("ms")), exact=True)


@query("report", """WITH d AS (SELECT * FROM detections WHERE fiber_id IN ('click', 'view') AND ts BETWEEN '2024-01-10' AND '2024-01-20'), s AS (SELECT fiber_id, direction, round_even(avg(abs(speed)), 1) AS a, round_even(min(abs(speed)), 1) AS b, round_even(max(abs(speed)), 1) AS c, count(*)::DOUBLE AS n FROM d GROUP BY ALL), h AS (SELECT fiber_id, direction, epoch_ms(date_trunc('hour', ts)) AS h, sum(vehicle_count)::DOUBLE AS v, count(*)::DOUBLE AS n FROM d GROUP BY ALL)
SELECT 'speed' AS part, fiber_id AS k1, direction::VARCHAR AS k2, '' AS k3, m AS metric, CASE m WHEN 'avg' THEN a WHEN 'min' THEN b WHEN 'max' THEN c ELSE n END AS value FROM s, (VALUES ('avg'), ('min'), ('max'), ('samples')) t(m)
UNION ALL SELECT 'volume', fiber_id, direction::VARCHAR, h::VARCHAR, m, CASE m WHEN 'vehicles' THEN v ELSE n END FROM h, (VALUES ('vehicles'), ('detections')) t(m)
UNION ALL SELECT 'incidents', incident_type, severity, '', 'n', count(*)::DOUBLE FROM incidents WHERE fiber_id IN ('click', 'view') AND timestamp BETWEEN '2024-01-10' AND '2024-01-20' GROUP BY incident_type, severity""")
def _(v):
    return reports.build_report(v.detections(), v.incidents(), day("2024-01-10"), day("2024-01-20"), ["click", "view"], ["incidents", "speed", "volume"])


# extension points --------------------------------------------------------------------------
@query("map_records", "SELECT seq, speed * 2 AS speed FROM detections")
def _(v):
    def twice(batches):
        for pdf in batches:
            yield pdf.assign(speed=pdf["speed"] * 2)

    return signals.map_records(v.detections().select("seq", "speed"), twice, "seq bigint, speed double")


@query("map_records_tagged", "SELECT CASE WHEN seq % 5000 <> 0 THEN seq END AS seq, CASE WHEN seq % 5000 <> 0 THEN speed * 2 END AS speed, CASE WHEN seq % 5000 = 0 THEN 'ValueError: bad record' END AS error, CASE WHEN seq % 5000 = 0 THEN seq END AS of FROM detections")
def _(v):
    def twice(batches):
        for pdf in batches:
            if (pdf["seq"] % 5000 == 0).any():
                raise ValueError("bad record")
            yield pdf.assign(speed=pdf["speed"] * 2)

    rows = signals.map_records(v.detections().select("seq", "speed"), twice, "seq bigint, speed double", tag_errors=True)
    return rows.select("seq", "speed", F.col("_error").alias("error"), S.json_in(F.col("_record"), "seq bigint")["seq"].alias("of"))


@query("map_windows", 'SELECT fiber_id, "window", pos, t, round_even(v - avg(v) OVER (PARTITION BY fiber_id, "window"), 9) AS v FROM win')
def _(v):
    w = v.windows()
    out = signals.map_windows(w, ["fiber_id", "window"], lambda pdf: pdf.assign(v=pdf["v"] - pdf["v"].mean()), ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in w.schema.fields))
    return out.withColumn("v", F.bround("v", 9))


@query("score_by_model", "SELECT seq, CASE WHEN direction = 0 THEN speed * 0.5::DOUBLE + 1 ELSE speed - 1 END AS score FROM detections")
def _(v):
    line = lambda a, b: lambda pdf: pdf.assign(score=pdf["speed"] * a + b)[["seq", "score"]]
    return detection.score_by_model(v.detections().select("seq", "direction", "speed"), "direction", {0: line(0.5, 1.0)}, "seq bigint, score double", line(1.0, -1.0))


@query("count_windows", "SELECT fiber_id, ch, w.w::INT AS t_window, (t_idx - w.w * 12)::INT AS t, v FROM sig JOIN range(20) w(w) ON w.w * 12 <= t_idx AND t_idx < w.w * 12 + 16 AND w.w * 12 + 16 <= 64")
def _(v):
    return counting.count_windows(v.signal(), 10.0, 1.6, 12).select("fiber_id", "ch", "t_window", "t", "v")


@query("interval_thresholds", 'SELECT fiber_id, "window", start_idx, k.k::INT AS n_sections, CASE WHEN k.k = 3 THEN 5.0::DOUBLE WHEN "window" = 0 THEN 4.0 WHEN "window" = 1 THEN 6.0 ELSE 5.0 END AS detect, CASE WHEN k.k = 3 THEN 10.0::DOUBLE WHEN "window" = 0 THEN 8.0 WHEN "window" = 1 THEN 12.0 ELSE 10.0 END AS classify FROM iv, range(2, 4) k(k)')
def _(v):
    g = detection.glrt_sum(detection.glrt_windows(v.signal(), 9, 3))
    iv = detection.intervals(detection.mask(g, 0.05)).select("fiber_id", "window", F.col("start_idx").cast("int").alias("start_idx"))
    thr = v.spark.createDataFrame([(0, 4.0, 8.0), (1, 6.0, 12.0)], "section_idx int, detect double, classify double")
    two, three = (counting.interval_thresholds(iv, thr, 5.0, 10.0, n).withColumn("n_sections", F.lit(n)) for n in (2, 3))
    return two.unionByName(three).select("fiber_id", "window", "start_idx", "n_sections", "detect", "classify")
