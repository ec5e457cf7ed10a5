"""Views over the test tables, the same in Spark and in SQL.

The operators take any DataFrames of the documented schemas; these views only map the
star-schema tables to them so that results can be compared.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

T0_US = 1_704_067_200_000_000  # 2024-01-01T00:00:00Z


class Views:
    """Views of one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir
        spark.conf.set("spark.sql.session.timeZone", "UTC")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def _events(self) -> DataFrame:
        return self.table("events").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))

    def _detections(self, us, seq=None) -> DataFrame:
        e = self._events().withColumn("us", us)
        n, heavy = 1 + F.col("event_id") % 3, F.when(F.col("event_id") % 10 == 0, 1).otherwise(0)
        return e.select(
            F.col("event_type").alias("fiber_id"), F.timestamp_micros("us").alias("ts"), (F.col("us") * 1000).alias("ts_ns"), F.col("user_id").cast("int").alias("ch"),
            (F.col("event_id") % 2).cast("int").alias("direction"), F.col("value").alias("speed"), n.alias("vehicle_count"), heavy.cast("bigint").alias("n_trucks"), (n - heavy).alias("n_cars"),
            (F.col("value") * 10).alias("glrt_max"), (F.col("value") / 100).alias("strain_peak"), (F.col("value") / 200).alias("strain_rms"), F.col("event_id").alias("seq"),
        )

    def detections(self) -> DataFrame:
        return self._detections(F.col("us"))

    def detections_dense(self) -> DataFrame:
        """Time compressed by 720: all rows within an hour."""
        return self._detections(F.lit(T0_US) + F.floor((F.col("us") - T0_US) / 720))

    def detections_dup(self) -> DataFrame:
        d = self.detections_dense()
        again = d.filter("seq % 20 = 0").withColumn("speed", F.col("speed") + 1).withColumn("seq", F.col("seq") + 1_000_000_000)
        return d.unionByName(again)

    def cables(self) -> DataFrame:
        ids = self.table("events").select(F.col("event_type").alias("fiber_id")).distinct()
        ch = F.sequence(F.lit(0), F.lit(149))
        point = lambda c: F.struct(F.when(c % 37 != 0, F.lit(7.2) + c * 0.001).alias("lng"), F.when(c % 37 != 0, F.lit(43.7) + c * 0.0005).alias("lat"))
        return ids.select("fiber_id", F.transform(ch, point).alias("coordinates"), F.transform(ch, lambda c: F.when(c % 25 == 0, F.concat(F.lit("L"), c.cast("string")))).alias("labels"))

    def wide_cables(self) -> DataFrame:
        """A cable of up to 100 channels for each 100 vectors, so their number grows with the data."""
        e = self.table("embeddings").select(F.concat(F.lit("f"), F.floor(F.col("vec_id") / 100).cast("string")).alias("fiber_id"), (F.col("vec_id") % 100).cast("int").alias("ch"), "embedding")
        x = lambda i: F.get("embedding", F.lit(i)).cast("double")
        known = F.col("ch") % 37 != 0
        rows = e.select("fiber_id", "ch", F.struct(F.when(known, F.lit(7.2) + F.col("ch") * 0.001 + x(0) * 0.0001).alias("lng"), F.when(known, F.lit(43.7) + F.col("ch") * 0.0005 + x(1) * 0.0001).alias("lat")).alias("p"))
        points = F.sort_array(F.collect_list(F.struct("ch", "p")))
        rows = rows.groupBy("fiber_id").agg(points.alias("c"))
        return rows.select("fiber_id", F.transform("c", lambda x: x["p"]).alias("coordinates"), F.transform("c", lambda x: F.when(x["ch"] % 25 == 0, F.concat(F.lit("L"), x["ch"].cast("string")))).alias("labels"))

    def wide_geo(self) -> DataFrame:
        from ..operators.joins import channel_geo

        return channel_geo(self.wide_cables())

    def wide_sections(self) -> DataFrame:
        r = F.array(*[F.struct(F.lit(k).alias("ord"), F.lit(a).alias("channel_start"), F.lit(b).alias("channel_end")) for k, (a, b) in enumerate(((0, 29), (20, 69), (70, 99)))])
        rows = self.wide_cables().select("fiber_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("direction")).select("fiber_id", "direction", F.inline(r))
        return rows.withColumn("section_id", F.format_string("%s-%d-%d", "fiber_id", "direction", "ord")).withColumn("org", F.when(F.substring("fiber_id", -1, 1) == "0", "A").otherwise("B"))

    def geo(self) -> DataFrame:
        from ..operators.joins import channel_geo

        return channel_geo(self.cables())

    def sections(self) -> DataFrame:
        ids = self.table("events").select(F.col("event_type").alias("fiber_id")).distinct()
        r = F.array(*[F.struct(F.lit(k).alias("ord"), F.lit(a).alias("channel_start"), F.lit(b).alias("channel_end")) for k, (a, b) in enumerate(((0, 29), (20, 69), (70, 149)))])
        rows = ids.withColumn("direction", F.explode(F.array(F.lit(0), F.lit(1)))).select("fiber_id", "direction", F.inline(r))
        return rows.withColumn("section_id", F.format_string("%s-%d-%d", "fiber_id", "direction", "ord")).withColumn("org", F.lit("A")).withColumn("green", F.lit(80.0) + F.col("ord")).withColumn("yellow", F.lit(60.0) + F.col("ord")).withColumn("orange", F.lit(30.0) + F.col("ord"))

    def assignments(self) -> DataFrame:
        return self.spark.createDataFrame([("A", "click"), ("A", "view"), ("B", "view"), ("B", "purchase"), ("B", "error")], "org string, fiber_id string")

    def rules(self) -> DataFrame:
        from .. import schemas

        rows = [
            ("r1", "A", "speed_below", True, [], None, None, 20.0, [], [], 0),
            ("r2", "A", "speed_below", True, ["click"], 10, 100, 50.0, [], [], 300),
            ("r3", "B", "speed_below", False, [], None, None, 50.0, [], [], 0),
            ("r4", "B", "speed_below", True, ["view", "error"], None, 80, 5.0, [], [], 300),
            ("r5", "A", "incident_type", True, [], None, None, None, ["accident", "congestion"], ["critical", "high"], 0),
            ("r6", "B", "incident_type", True, ["error"], 20, None, None, [], ["low"], 300),
        ]
        return self.spark.createDataFrame(rows, schemas.RULE)

    def incident_versions(self) -> DataFrame:
        o, l = self.table("orders"), self.table("lineitem")  # noqa: E741
        pick = lambda c, *v: F.element_at(F.array(*[F.lit(x) for x in v]), (F.pmod(c, F.lit(len(v))) + 1).cast("int"))
        k = F.col("o_orderkey")
        p = F.substring("o_orderpriority", 1, 1)
        start = (F.col("o_custkey") % 150).cast("int")
        return o.join(l, F.col("o_orderkey") == F.col("l_orderkey")).select(
            F.concat(F.lit("inc-"), k.cast("string")).alias("incident_id"), pick(k, "click", "error", "purchase", "signup", "view").alias("fiber_id"), (k % 2).cast("int").alias("direction"),
            F.col("o_orderdate").cast("timestamp").alias("timestamp"), pick(k, "accident", "congestion", "slowdown", "anomaly").alias("incident_type"),
            F.when(p == "1", "critical").when(p == "2", "high").when(p == "3", "medium").otherwise("low").alias("severity"),
            F.when(F.col("o_orderstatus") == "O", "active").when(F.col("o_orderstatus") == "P", "investigating").otherwise("resolved").alias("status"),
            start.alias("channel_start"), (start + (k % 10).cast("int")).alias("channel_end"), F.col("l_quantity").alias("duration_seconds"), (F.col("l_discount") * 100).alias("speed_drop_percent"),
            F.col("l_shipdate").cast("timestamp").alias("updated_at"), "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice",
        )

    def incidents(self) -> DataFrame:
        from ..operators.incidents import latest_incidents

        return latest_incidents(self.incident_versions(), ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]).drop("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")

    def live_incidents(self) -> DataFrame:
        """Incidents moved into the hour of the dense detections, whole seconds."""
        i = self.table("orders")
        k = F.col("o_orderkey")
        pick = F.element_at(F.array(*[F.lit(x) for x in ("click", "error", "purchase", "signup", "view")]), (k % 5 + 1).cast("int"))
        return i.select(F.concat(F.lit("inc-"), k.cast("string")).alias("incident_id"), pick.alias("fiber_id"), (k % 2).cast("int").alias("direction"), F.timestamp_micros(F.lit(T0_US) + (k % 3600) * 1_000_000).alias("timestamp"), (F.col("o_custkey") % 150).cast("int").alias("channel_start"), (F.col("o_custkey") % 150 + k % 10).cast("int").alias("channel_end"), F.lit("accident").alias("incident_type"), F.lit("high").alias("severity"), F.lit("active").alias("status"))

    def actions(self) -> DataFrame:
        o = self.table("orders")
        k = F.col("o_orderkey")
        steps = F.array(*[F.struct(F.lit(n).alias("n"), a.alias("from_status"), b.alias("to_status")) for n, a, b in ((0, F.lit("active"), F.lit("acknowledged")), (1, F.when(k % 3 == 0, "active").otherwise("acknowledged"), F.lit("investigating")), (2, F.lit("investigating"), F.when(k % 5 == 0, "acknowledged").otherwise("resolved")))])
        rows = o.select(F.concat(F.lit("inc-"), k.cast("string")).alias("incident_id"), F.col("o_orderdate").cast("timestamp").alias("d"), F.inline(steps))
        return rows.select("incident_id", "from_status", "to_status", F.timestamp_micros(F.unix_micros("d") + F.col("n") * 60_000_000).alias("performed_at"))

    def signal(self) -> DataFrame:
        e = self.table("embeddings").select("vec_id", F.posexplode("embedding").alias("pos", "x"))
        return e.select(F.concat(F.lit("f"), F.floor(F.col("vec_id") / 100).cast("string")).alias("fiber_id"), F.lit("main").alias("section"), (F.col("vec_id") % 100).cast("int").alias("ch"), F.col("pos").alias("t_idx"), F.col("x").cast("double").alias("v"))

    def windows(self) -> DataFrame:
        """Windows of nine channels, every third: (fiber_id, window, pos, t, v)."""
        from ..operators.signals import spatial_windows

        return spatial_windows(self.signal(), 9, 3).select("fiber_id", "window", "pos", F.col("t_idx").alias("t"), "v")

    def spectra(self) -> DataFrame:
        e = self.table("embeddings")
        return e.select(F.concat(F.lit("b"), F.col("label").cast("string")).alias("infra_id"), F.col("vec_id").alias("t_idx"), (F.lit(T0_US) + F.col("vec_id") * 1_000_000).alias("ts_us"), F.transform("embedding", lambda x: F.abs(x.cast("double"))).alias("power"), F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.lit(0.5) + i * 0.02).alias("freqs"))

    def peak_freqs(self) -> DataFrame:
        e = self._events()
        return e.select(F.col("event_type").alias("infra_id"), F.timestamp_micros("us").alias("ts"), (F.lit(1.06) + (F.col("value") % 10) / 100).alias("freq"))


#: The same views in SQL, in order of use.
SQL = {
    "ev": "SELECT *, epoch_us(ts) AS us FROM events",
    "detections": """SELECT event_type AS fiber_id, ts, us, us * 1000 AS ts_ns, user_id::INT AS ch, (event_id % 2)::INT AS direction, value AS speed, 1 + event_id % 3 AS vehicle_count,
        CASE WHEN event_id % 10 = 0 THEN 1 ELSE 0 END AS n_trucks, 1 + event_id % 3 - CASE WHEN event_id % 10 = 0 THEN 1 ELSE 0 END AS n_cars,
        value * 10 AS glrt_max, value / 100 AS strain_peak, value / 200 AS strain_rms, event_id AS seq FROM ev""",
    "detections_dense": f"SELECT * REPLACE (make_timestamp({T0_US} + (us - {T0_US}) // 720) AS ts, {T0_US} + (us - {T0_US}) // 720 AS us, ({T0_US} + (us - {T0_US}) // 720) * 1000 AS ts_ns) FROM detections",
    "detections_dup": "SELECT * FROM detections_dense UNION ALL SELECT * REPLACE (speed + 1 AS speed, seq + 1000000000 AS seq) FROM detections_dense WHERE seq % 20 = 0",
    "fibers": "SELECT DISTINCT event_type AS fiber_id FROM events",
    "geo": "SELECT fiber_id, c::INT AS ch, CASE WHEN c % 37 <> 0 THEN 7.2::DOUBLE + c * 0.001::DOUBLE END AS lng, CASE WHEN c % 37 <> 0 THEN 43.7::DOUBLE + c * 0.0005::DOUBLE END AS lat FROM fibers, range(150) r(c)",
    "sections": """SELECT fiber_id, d.d::INT AS direction, o::INT AS ord, a AS channel_start, b AS channel_end, fiber_id || '-' || d.d || '-' || o AS section_id, 'A' AS org, 80.0::DOUBLE + o AS green, 60.0::DOUBLE + o AS yellow, 30.0::DOUBLE + o AS orange
        FROM fibers, range(2) d(d), (VALUES (0, 0, 29), (1, 20, 69), (2, 70, 149)) s(o, a, b)""",
    "wgeo": """SELECT 'f' || (vec_id // 100) AS fiber_id, (vec_id % 100)::INT AS ch, CASE WHEN vec_id % 100 % 37 <> 0 THEN 7.2::DOUBLE + vec_id % 100 * 0.001::DOUBLE + embedding[1]::DOUBLE * 0.0001::DOUBLE END AS lng,
        CASE WHEN vec_id % 100 % 37 <> 0 THEN 43.7::DOUBLE + vec_id % 100 * 0.0005::DOUBLE + embedding[2]::DOUBLE * 0.0001::DOUBLE END AS lat FROM embeddings""",
    "wfibers": "SELECT fiber_id, count(*) AS channels FROM wgeo GROUP BY ALL",
    "wsections": """SELECT fiber_id, d.d::INT AS direction, o::INT AS ord, a AS channel_start, b AS channel_end, fiber_id || '-' || d.d || '-' || o AS section_id, CASE WHEN fiber_id LIKE '%0' THEN 'A' ELSE 'B' END AS org
        FROM wfibers, range(2) d(d), (VALUES (0, 0, 29), (1, 20, 69), (2, 70, 99)) s(o, a, b)""",
    "assignments": "SELECT * FROM (VALUES ('A', 'click'), ('A', 'view'), ('B', 'view'), ('B', 'purchase'), ('B', 'error')) t(org, fiber_id)",
    "rules": """SELECT * FROM (VALUES ('r1', 'A', 'speed_below', true, []::VARCHAR[], NULL, NULL, 20.0::DOUBLE, []::VARCHAR[], []::VARCHAR[], 0), ('r2', 'A', 'speed_below', true, ['click'], 10, 100, 50.0, [], [], 300),
        ('r3', 'B', 'speed_below', false, [], NULL, NULL, 50.0, [], [], 0), ('r4', 'B', 'speed_below', true, ['view', 'error'], NULL, 80, 5.0, [], [], 300),
        ('r5', 'A', 'incident_type', true, [], NULL, NULL, NULL, ['accident', 'congestion'], ['critical', 'high'], 0), ('r6', 'B', 'incident_type', true, ['error'], 20, NULL, NULL, [], ['low'], 300))
        t(rule_id, org, rule_type, is_active, fibers, lo, hi, threshold, types, severities, cooldown_s)""",
    "incident_versions": """SELECT 'inc-' || o_orderkey AS incident_id, ['click', 'error', 'purchase', 'signup', 'view'][(o_orderkey % 5) + 1] AS fiber_id, (o_orderkey % 2)::INT AS direction, o_orderdate AS timestamp,
        ['accident', 'congestion', 'slowdown', 'anomaly'][(o_orderkey % 4) + 1] AS incident_type, CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'critical' WHEN '2' THEN 'high' WHEN '3' THEN 'medium' ELSE 'low' END AS severity,
        CASE o_orderstatus WHEN 'O' THEN 'active' WHEN 'P' THEN 'investigating' ELSE 'resolved' END AS status, (o_custkey % 150)::INT AS channel_start, (o_custkey % 150 + o_orderkey % 10)::INT AS channel_end,
        l_quantity AS duration_seconds, l_discount * 100 AS speed_drop_percent, l_shipdate AS updated_at, l_linenumber, l_partkey, l_suppkey, l_extendedprice FROM orders JOIN lineitem ON o_orderkey = l_orderkey""",
    "incidents": "SELECT * EXCLUDE (l_linenumber, l_partkey, l_suppkey, l_extendedprice) FROM incident_versions QUALIFY row_number() OVER (PARTITION BY incident_id ORDER BY updated_at DESC, l_linenumber DESC, l_partkey DESC, l_suppkey DESC, l_extendedprice DESC) = 1",
    "live_incidents": f"""SELECT 'inc-' || o_orderkey AS incident_id, ['click', 'error', 'purchase', 'signup', 'view'][(o_orderkey % 5) + 1] AS fiber_id, (o_orderkey % 2)::INT AS direction,
        {T0_US} + (o_orderkey % 3600) * 1000000 AS i_us, (o_custkey % 150)::INT AS channel_start, (o_custkey % 150 + o_orderkey % 10)::INT AS channel_end FROM orders""",
    "actions": """SELECT 'inc-' || o_orderkey AS incident_id, CASE n WHEN 0 THEN 'active' WHEN 1 THEN CASE WHEN o_orderkey % 3 = 0 THEN 'active' ELSE 'acknowledged' END ELSE 'investigating' END AS from_status,
        CASE n WHEN 0 THEN 'acknowledged' WHEN 1 THEN 'investigating' ELSE CASE WHEN o_orderkey % 5 = 0 THEN 'acknowledged' ELSE 'resolved' END END AS to_status, epoch_us(o_orderdate) + n * 60000000 AS at_us
        FROM orders, range(3) r(n)""",
    "sig": "SELECT 'f' || (vec_id // 100) AS fiber_id, (vec_id % 100)::INT AS ch, unnest(range(64))::INT AS t_idx, unnest(embedding)::DOUBLE AS v FROM embeddings",
    "chs": "SELECT fiber_id, ch, row_number() OVER (PARTITION BY fiber_id ORDER BY ch) - 1 AS i, count(*) OVER (PARTITION BY fiber_id) AS n FROM (SELECT DISTINCT fiber_id, ch FROM sig)",
    "win": "SELECT s.fiber_id, (w.w)::INT AS \"window\", (i - w.w * 3)::INT AS pos, t_idx AS t, v FROM sig s JOIN chs USING (fiber_id, ch) JOIN range(1000) w(w) ON w.w * 3 <= i AND i < w.w * 3 + 9 AND w.w * 3 + 9 <= n",
    "g": """SELECT fiber_id, "window", pair, t, CASE WHEN t >= 25 AND t < 39 THEN s ELSE 0 END AS g FROM (SELECT *, sum(p) OVER (PARTITION BY fiber_id, "window", pair ORDER BY t ROWS BETWEEN 10 PRECEDING AND 9 FOLLOWING) AS s
        FROM (SELECT fiber_id, "window", pos AS pair, t, v * lead(v) OVER (PARTITION BY fiber_id, "window", t ORDER BY pos) AS p FROM win) WHERE p IS NOT NULL)""",
    "gs": 'SELECT fiber_id, "window", t, sum(g) AS g FROM g GROUP BY ALL',
    "iv": 'SELECT fiber_id, "window", min(t)::INT AS start_idx, (max(t) + 1)::INT AS end_idx FROM (SELECT *, t - row_number() OVER (PARTITION BY fiber_id, "window" ORDER BY t) AS r FROM gs WHERE g >= 0.05) GROUP BY fiber_id, "window", r',
    "si": "SELECT s.fiber_id, i, n, t_idx, v FROM sig s JOIN chs USING (fiber_id, ch)",
    "peak_freqs": "SELECT event_type AS infra_id, ts, us, 1.06::DOUBLE + (value % 10) / 100 AS freq FROM ev",
    "spectra": f"SELECT 'b' || label AS infra_id, vec_id AS t_idx, {T0_US} + vec_id * 1000000 AS ts_us, list_transform(embedding, lambda x: abs(x::DOUBLE)) AS power, list_transform(range(64), lambda i: 0.5::DOUBLE + i * 0.02::DOUBLE) AS freqs FROM embeddings",
    "m1": "SELECT fiber_id, date_trunc('minute', ts) AS ts, ch, direction, max(speed) AS speed_max, sum(speed) AS speed_sum, count(speed) AS speed_n, min(speed) AS speed_min, sum(vehicle_count) AS count_sum, sum(n_cars) AS cars_sum, sum(n_trucks) AS trucks_sum, count(*) AS samples FROM detections GROUP BY ALL",
    "m1d": "SELECT fiber_id, date_trunc('minute', ts) AS ts, ch, direction, max(speed) AS speed_max, sum(speed) AS speed_sum, count(speed) AS speed_n, min(speed) AS speed_min, sum(vehicle_count) AS count_sum, count(*) AS samples FROM detections_dense GROUP BY ALL",
}


def with_views(body: str) -> str:
    """``body`` with the views that it names, and theirs, as common table expressions."""
    import re

    need: set[str] = set()
    todo = [body]
    while todo:
        text = todo.pop()
        for name, sql in SQL.items():
            if name not in need and re.search(rf"\b{name}\b", text):
                need.add(name)
                todo.append(sql)
    ctes = [f"{n} AS ({SQL[n]})" for n in SQL if n in need]
    body = body.strip()
    for start in ("WITH RECURSIVE ", "WITH "):
        if body.upper().startswith(start):
            return start + ",\n".join([*ctes, body[len(start) :]])
    return "WITH " + ",\n".join(ctes) + "\n" + body if ctes else body
