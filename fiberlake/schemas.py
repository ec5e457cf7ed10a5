"""Schemas of the tables and streams, as DDL (no inference anywhere)."""

RAW_FRAME = ("topic string, ts_ns bigint, floatData array<float>, longData array<bigint>")
FRAME = ("fiber_id string, frame_seq bigint, ts_ns bigint, values array<double>")
SIGNAL = ("fiber_id string, section string, ch int, t_idx bigint, ts_ns bigint, v double")
PROCESSED_FRAME = (
    "fiber_id string, section string, frame_seq bigint, ts_ns bigint, values binary, n_samples int, channel_start int, channel_count int, "
    "sampling_rate_hz double, stats struct<min:double,max:double,mean:double,rms:double>"
)
DETECTION_STRUCT = (
    "struct<timestamp_ns:bigint,channel:int,direction:int,speed_kmh:double,vehicle_count:double,n_cars:double,n_trucks:double,"
    "glrt_max:double,strain_peak:double,strain_rms:double>"
)
DETECTION_BATCH = (
    f"fiber_id string, engine_version string, detections array<{DETECTION_STRUCT}>, timestamp_ns bigint, channel int, direction int, speed_kmh double, "
    "vehicle_count double, n_cars double, n_trucks double, glrt_max double, strain_peak double, strain_rms double"
)
DETECTION = (
    "fiber_id string, ts timestamp, ts_ns bigint, ch int, direction int, speed double, vehicle_count double, n_cars double, n_trucks double, "
    "glrt_max double, strain_peak double, strain_rms double, lng double, lat double"
)
TIER = (
    "fiber_id string, ts timestamp, ch int, direction int, speed_max double, speed_sum double, speed_n bigint, speed_min double, count_sum double, "
    "cars_sum double, trucks_sum double, samples bigint"
)
CABLE = (
    "fiber_id string, coordinates array<struct<lng:double,lat:double>>, labels array<string>, directional_paths map<string,array<struct<lng:double,lat:double>>>, "
    "channel_count int, updated_at timestamp"
)
INCIDENT = (
    "incident_id string, fiber_id string, direction int, timestamp timestamp, timestamp_ns bigint, incident_type string, severity string, status string, "
    "channel_start int, channel_end int, duration_seconds double, speed_before_kmh double, speed_during_kmh double, speed_drop_percent double, updated_at timestamp"
)
SECTION = ("org string, section_id string, fiber_id string, direction int, channel_start int, channel_end int, ord int, green double, yellow double, orange double")
PIPELINE_SECTION = ("fiber_id string, section string, start int, stop int, ord int, steps array<struct<step:string,params:map<string,string>>>, model_hint string")
PARAMS = ("fiber_id string, n_channels int, rate double, gauge double")
ASSIGNMENT = ("org string, fiber_id string")
RULE = (
    "rule_id string, org string, rule_type string, is_active boolean, fibers array<string>, channel_start int, channel_end int, threshold double, "
    "types array<string>, severities array<string>, cooldown_s int"
)
ALERT_LOG = ("rule_id string, incident_id string, fiber_id string, ch int, detail string, dispatched_at timestamp")
ACTION = ("incident_id string, from_status string, to_status string, performed_at timestamp, performed_by string")
SPECTRUM = ("infra_id string, t_idx bigint, ts timestamp, power array<double>")
CALIBRATION = ("fiber_id string, date string, section_idx int, threshold double, baseline double, noise double, correction double, method string, median_glrt double")
INTERVAL = ("start_idx bigint, end_idx bigint")
INFRASTRUCTURE = ("infra_id string, fiber_id string, direction int, channel_start int, channel_end int, kind string")
DEAD_LETTER = ("source string, partition int, offset bigint, error_type string, error_message string, payload binary, failed_at timestamp")
REPORT = ("report_id string, org string, start timestamp, end timestamp, fibers array<string>, parts array<string>")
