"""Geometry of cables: directions, offsets, landmarks, simplification, dense indices."""

from __future__ import annotations


import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import kernels

METRES_PER_DEG = 111_320.0
OFFSET_M = 12.0


def expand_directions(cables: DataFrame) -> DataFrame:
    """Two rows a cable; a direction's own path counts only if it is as long as the coordinates."""
    rows = cables.withColumn("direction", F.explode(F.array(F.lit(0), F.lit(1))))
    path = F.try_element_at("directional_paths", F.col("direction").cast("string")) if "directional_paths" in cables.columns else F.lit(None)
    own = F.coalesce(F.size(path) == F.size("coordinates"), F.lit(False)) if "directional_paths" in cables.columns else F.lit(False)
    rows = rows.withColumn("precomputed", own)
    return rows.withColumn("coordinates", F.when(own, path).otherwise(F.col("coordinates"))) if "directional_paths" in cables.columns else rows


def offset_polyline(channels: DataFrame, metres: Column | float = OFFSET_M, by: tuple[str, ...] = ("fiber_id", "direction")) -> DataFrame:
    """Valid points moved perpendicular to the line, to the right for positive metres (flat earth).

    At inner points the normals of both segments are averaged.
    """
    rows = channels.filter("lng is not null and lat is not null")
    w = W.partitionBy(*by).orderBy("ch")
    rows = rows.withColumn("dx1", F.col("lng") - F.lag("lng").over(w)).withColumn("dy1", F.col("lat") - F.lag("lat").over(w))
    rows = rows.withColumn("dx2", F.lead("lng").over(w) - F.col("lng")).withColumn("dy2", F.lead("lat").over(w) - F.col("lat"))
    z = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    nx, ny = z("dy1") + z("dy2"), -(z("dx1") + z("dx2"))
    per_lng = METRES_PER_DEG * F.cos(F.radians("lat"))
    length = F.sqrt((nx * per_lng) ** 2 + (ny * METRES_PER_DEG) ** 2)
    metres = metres if isinstance(metres, Column) else F.lit(float(metres))
    s = F.coalesce(metres / F.nullif(length, F.lit(0.0)), F.lit(0.0))
    return rows.withColumn("_x", F.col("lng") + nx * s).withColumn("_y", F.col("lat") + ny * s).drop("dx1", "dy1", "dx2", "dy2", "lng", "lat").withColumnsRenamed({"_x": "lng", "_y": "lat"})


def direction_offset(direction: Column) -> Column:
    return F.when(direction == 0, OFFSET_M).otherwise(-OFFSET_M)


def landmarks(cables: DataFrame) -> DataFrame:
    rows = cables.select("fiber_id", F.posexplode("labels").alias("ch", "label"))
    return rows.filter("label is not null and trim(label) <> ''")


def channel_coords(det: DataFrame, geo: DataFrame) -> DataFrame:
    return det.join(geo, ["fiber_id", "ch"], "left")


def section_coords(sections: DataFrame, geo: DataFrame) -> DataFrame:
    """Each section's valid coordinates in channel order."""
    from .joins import range_join

    rows = range_join(geo.filter("lng is not null"), sections.select("section_id", "fiber_id", "channel_start", "channel_end"), "ch", "channel_start", "channel_end", ["fiber_id"])
    return rows.groupBy("section_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("ch", "lng", "lat"))), lambda p: F.struct(p["lng"].alias("lng"), p["lat"].alias("lat"))).alias("path"))


def simplify(channels: DataFrame, tolerance: float, by: tuple[str, ...] = ("fiber_id",)) -> DataFrame:
    """Channels that the Douglas-Peucker rule keeps, by cable."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in channels.schema.fields)

    def apply(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.dropna(subset=["lng", "lat"]).sort_values("ch", kind="stable")
        return pdf.iloc[kernels.simplify(pdf[["lng", "lat"]].to_numpy(float), tolerance)]

    return channels.groupBy(*by).applyInPandas(apply, schema)


def coverage_segments(geo: DataFrame, coverage: DataFrame) -> DataFrame:
    """Paths of coverage ranges with at least two valid points."""
    from .joins import range_join

    rows = range_join(geo.filter("lng is not null"), coverage.select("fiber_id", F.col("start").alias("lo"), F.col("end").alias("hi")), "ch", "lo", "hi", ["fiber_id"])
    out = rows.groupBy("fiber_id", "lo", "hi").agg(F.sort_array(F.collect_list(F.struct("ch", "lng", "lat"))).alias("path"))
    return out.filter(F.size("path") >= 2)


def dense_index(channels: DataFrame, by: tuple[str, ...] = ("fiber_id",)) -> DataFrame:
    """Index from 0 of each channel with coordinates."""
    return channels.filter("lng is not null and lat is not null").withColumn("idx", F.row_number().over(W.partitionBy(*by).orderBy("ch")) - 1)


