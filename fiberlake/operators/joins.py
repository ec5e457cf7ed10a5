"""Joins: geography, sections, tenants, ranges, nearest channel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rollups import latest


def range_join(left: DataFrame, right: DataFrame, value: str, lo: str, hi: str, on: list[str], bucket: int = 64, how: str = "inner") -> DataFrame:
    """``left`` joined with the rows of ``right`` whose closed range holds its value.

    A BETWEEN join alone is a nested loop. Here ranges are dealt into the cells of
    fixed width that they touch, so the join is an equi-join on (keys, cell) with the
    range as a further condition; each pair meets in exactly one cell, the value's.
    """
    r = right.withColumn("_cell", F.explode(F.sequence(F.floor(F.col(lo) / bucket), F.floor(F.col(hi) / bucket))))
    l = left.withColumn("_cell", F.floor(F.col(value) / bucket))  # noqa: E741
    r = r.select(*[F.col(c).alias(f"_r_{c}") if c in on else F.col(c) for c in r.columns if c != "_cell"], F.col("_cell").alias("_r_cell"))
    cond = (F.col("_cell") == F.col("_r_cell")) & F.col(value).between(F.col(lo), F.col(hi))
    for c in on:
        cond = cond & (F.col(c) == F.col(f"_r_{c}"))
    return l.join(r, cond, how).drop("_cell", "_r_cell", *[f"_r_{c}" for c in on])


def channel_geo(cables: DataFrame) -> DataFrame:
    """(fiber_id, ch, lng, lat) of the latest version of each cable."""
    rows = latest(cables, ["fiber_id"], "updated_at") if "updated_at" in cables.columns else cables
    # outer: for the inner form Spark would test every row for an empty array below a distinct, building the array for each
    points = rows.select("fiber_id", F.posexplode_outer("coordinates").alias("ch", "p")).filter("ch is not null")
    return points.select("fiber_id", "ch", F.col("p.lng").alias("lng"), F.col("p.lat").alias("lat"))


def enrich_geo(det: DataFrame, cables: DataFrame) -> DataFrame:
    """Detections with their channel's coordinates; null where the cable or channel is unknown.

    A cable stays one row with its points as an array, so Spark broadcasts the cables as
    long as they are small and detections need no shuffle.
    """
    rows = latest(cables, ["fiber_id"], "updated_at") if "updated_at" in cables.columns else cables
    out = det.join(rows.select("fiber_id", F.col("coordinates").alias("_points")), "fiber_id", "left")
    point = F.get("_points", F.col("ch"))
    return out.withColumn("lng", point["lng"]).withColumn("lat", point["lat"]).drop("_points")


def in_sections(det: DataFrame, sections: DataFrame) -> DataFrame:
    """One row for each section that holds a detection (closed ranges, sections may overlap)."""
    s = sections.select("section_id", "fiber_id", "direction", "channel_start", "channel_end", *[c for c in ("org", "ord", "green", "yellow", "orange") if c in sections.columns])
    return range_join(det, s, "ch", "channel_start", "channel_end", ["fiber_id", "direction"])


def pipeline_section(sig: DataFrame, cfg: DataFrame) -> DataFrame:
    """The first configured section whose half-open range holds the channel; rows of none go."""
    c = cfg.groupBy("fiber_id").agg(F.sort_array(F.collect_list(F.struct("ord", "section", "start", "stop"))).alias("_c"))
    rows = sig.join(F.broadcast(c), "fiber_id")
    first = F.filter("_c", lambda x: (F.col("ch") >= x["start"]) & (F.col("ch") < x["stop"]))
    return rows.withColumn("section", F.get(first, F.lit(0))["section"]).drop("_c").filter("section is not null")


def scope(df: DataFrame, assign: DataFrame, org: str | None) -> DataFrame:
    """Only rows of the org's fibers; ``None`` is the superuser."""
    return df if org is None else df.join(F.broadcast(assign.filter(F.col("org") == org).select("fiber_id").distinct()), "fiber_id", "leftsemi")


def fan_out(df: DataFrame, assign: DataFrame) -> DataFrame:
    """A copy of each row for every owning org, and one for ``__all__``."""
    orgs = assign.groupBy("fiber_id").agg(F.collect_set("org").alias("_orgs"))
    rows = df.join(orgs, "fiber_id", "left")
    to = F.concat(F.array(F.lit("__all__")), F.coalesce("_orgs", F.array().cast("array<string>")))
    return rows.withColumn("org", F.explode(to)).drop("_orgs")


def lookup_thresholds(det: DataFrame, sections: DataFrame, fiber_thresholds: DataFrame) -> DataFrame:
    """Speed thresholds: of the first section that holds the channel, else the fiber's, else the default.

    The fiber's own thresholds count only where it has sections in that direction.
    """
    per = sections.groupBy("fiber_id", "direction").agg(F.sort_array(F.collect_list(F.struct("ord", "channel_start", "channel_end", "green", "yellow", "orange"))).alias("_s"))
    rows = det.join(F.broadcast(per), ["fiber_id", "direction"], "left").join(F.broadcast(fiber_thresholds.select("fiber_id", *[F.col(c).alias(f"_{c}") for c in ("green", "yellow", "orange")])), "fiber_id", "left")
    hit = F.get(F.filter("_s", lambda s: F.col("ch").between(s["channel_start"], s["channel_end"])), F.lit(0))
    out = rows.withColumn("_h", hit)
    for c, v in (("green", 80.0), ("yellow", 60.0), ("orange", 30.0)):
        out = out.withColumn(c, F.coalesce(F.col("_h")[c], F.when(F.col("_s").isNotNull(), F.col(f"_{c}")), F.lit(v)))
    return out.drop("_h", "_s", "_green", "_yellow", "_orange")


def nearest_channel(points: DataFrame, channels: DataFrame, r: float) -> DataFrame:
    """(point_id, fiber_id, ch, dist): the nearest channel within r degrees, by grid cells of size r.

    Channels are dealt to their cell and the eight around it and gathered there, so a point
    stays one row that finds its nearest in one array; pairs are no rows.
    """
    cells = lambda c: F.explode(F.transform(F.sequence(F.lit(-1), F.lit(1)), lambda i: F.floor(F.col(c) / r) + i))
    c = channels.filter("lng is not null and lat is not null").withColumn("cx", cells("lng")).withColumn("cy", cells("lat"))
    c = c.groupBy("cx", "cy").agg(F.collect_list(F.struct("lng", "lat", "fiber_id", "ch")).alias("near"))
    p = points.select("point_id", F.col("lng").alias("px"), F.col("lat").alias("py"), F.floor(F.col("lng") / r).alias("cx"), F.floor(F.col("lat") / r).alias("cy"))
    off = lambda x: F.sqrt((x["lng"] - F.col("px")) ** 2 + (x["lat"] - F.col("py")) ** 2)
    first = F.array_min(F.filter(F.transform("near", lambda x: F.struct(off(x).alias("dist"), x["fiber_id"].alias("fiber_id"), x["ch"].alias("ch"))), lambda x: x["dist"] <= r))
    rows = p.join(c, ["cx", "cy"]).select("point_id", first.alias("b")).filter("b is not null")
    best = rows.groupBy("point_id").agg(F.min("b").alias("b"))
    return best.select("point_id", "b.fiber_id", "b.ch", "b.dist")


def infra_det(infra: DataFrame, det: DataFrame) -> DataFrame:
    """Detections on each structure; a null direction of a structure holds both."""
    both = infra.withColumn("direction", F.explode(F.when(F.col("direction").isNull(), F.array(F.lit(0), F.lit(1))).otherwise(F.array("direction"))))
    return range_join(det, both.select("infra_id", "fiber_id", "direction", "channel_start", "channel_end"), "ch", "channel_start", "channel_end", ["fiber_id", "direction"])


def fiber_listing(assign: DataFrame, cables: DataFrame, tier_1h: DataFrame, org: str) -> DataFrame:
    """The org's fibers with metadata and the range of stored data, defaults where there is none."""
    avail = tier_1h.groupBy("fiber_id").agg(F.min("ts").alias("first"), F.max("ts").alias("last"))
    rows = assign.filter(F.col("org") == org).select("fiber_id").distinct().join(cables.select("fiber_id", F.size("coordinates").alias("channels")), "fiber_id", "left").join(avail, "fiber_id", "left")
    return rows.select("fiber_id", F.coalesce("channels", F.lit(0)).alias("channels"), F.unix_micros("first").alias("first_us"), F.unix_micros("last").alias("last_us"))


def alert_log_view(log: DataFrame, rules: DataFrame, org: str | None = None) -> DataFrame:
    r = rules.select("rule_id", "org", "rule_type")
    rows = log.join(F.broadcast(r), "rule_id")
    return rows if org is None else rows.filter(F.col("org") == org)


def pairs(win: DataFrame, by: list[str], pos: str = "pos", value: str = "v") -> DataFrame:
    """Each sample with that of the next channel of its window (pair = position of the first)."""
    from pyspark.sql import Window as W

    return win.withColumn("v_next", F.lead(value).over(W.partitionBy(*by).orderBy(pos))).filter("v_next is not null").withColumnRenamed(pos, "pair")


def compare_periods(peaks: DataFrame, ref: Column, mode: str = "day", lo: float = 1.06, hi: float = 1.16) -> DataFrame:
    """Band statistics of the reference's day (or week from Monday) against the one before."""
    start = F.date_trunc("day" if mode == "day" else "week", ref)
    step = F.expr("INTERVAL 1 DAY" if mode == "day" else "INTERVAL 7 DAYS")
    stats = lambda a, b, tag: peaks.filter((F.col("ts") >= a) & (F.col("ts") < b) & F.col("freq").between(lo, hi)).agg(F.avg("freq").alias(f"{tag}_mean"), F.stddev_pop("freq").alias(f"{tag}_std"), F.count("freq").alias(f"{tag}_n"))
    out = stats(start, start + step, "cur").join(stats(start - step, start, "prev"))  # one row each
    diff = F.col("cur_mean") - F.col("prev_mean")
    return out.withColumn("diff", diff).withColumn("percent", diff / F.nullif("prev_mean", F.lit(0.0)) * 100)


