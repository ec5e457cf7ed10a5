"""Dimensions: cables, sections, instrument parameters, spectra, calibration, thresholds."""

from __future__ import annotations

import io
import json

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import schemas
from ..functions import scalars as S
from ..operators.rollups import latest


def read_cables(spark: SparkSession, path: str) -> DataFrame:
    """Cable files (JSON, one a file); those without coordinates are no cables; the id defaults to the file's stem."""
    schema = "id string, name string, coordinates array<array<double>>, labels array<string>, updated_at timestamp"
    raw = spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").json(path).withColumn("file", F.input_file_name())
    stem = F.regexp_extract("file", r"([^/]+)\.[^./]+$", 1)
    coords = F.transform("coordinates", lambda p: F.struct(F.get(p, F.lit(0)).alias("lng"), F.get(p, F.lit(1)).alias("lat")))
    rows = raw.filter("coordinates is not null")
    return rows.select(F.coalesce("id", stem).alias("fiber_id"), coords.alias("coordinates"), "labels", F.size("coordinates").alias("channel_count"), "updated_at")


def config_tables(spark: SparkSession, config: dict | str) -> tuple[DataFrame, DataFrame]:
    """(pipeline sections, coverage) of a configuration (a mapping, or JSON or YAML text).

    ``fibers: {id: {defaults: {...}, sections: [{name, channels: [start, stop], steps, model_hint}], coverage: [{start, end}]}}``
    A section's own values win over its fiber's defaults.
    """
    if isinstance(config, str):
        try:
            config = json.loads(config)
        except ValueError:
            import yaml

            config = yaml.safe_load(config)
    sections, coverage = [], []
    for fiber, f in config.get("fibers", {}).items():
        defaults = f.get("defaults", {})
        for k, s in enumerate(f.get("sections", [])):
            s = {**defaults, **s}
            steps = [(x["step"], {str(a): str(b) for a, b in x.get("params", {}).items()}) for x in s.get("steps", [])]
            sections.append((fiber, s["name"], int(s["channels"][0]), int(s["channels"][1]), k, steps, s.get("model_hint")))
        coverage += [(fiber, int(r["start"]), int(r["end"])) for r in sorted(f.get("coverage", []), key=lambda r: r["start"])]
    return spark.createDataFrame(sections, schemas.PIPELINE_SECTION), spark.createDataFrame(coverage, "fiber_id string, start int, end int")


def latest_params(df: DataFrame, fallback: DataFrame) -> DataFrame:
    """Last valid record (``dt > 0``) of each fiber by offset, rate 1/dt; configured values where there is none."""
    good = df.filter("dt > 0 and n_channels > 0")
    last = good.groupBy("fiber_id").agg(F.max_by(F.struct("n_channels", (1 / F.col("dt")).alias("rate"), "gauge"), "offset").alias("p"))
    f = fallback.select("fiber_id", *[F.col(c).alias(f"_{c}") for c in ("n_channels", "rate", "gauge")])
    rows = last.join(f, "fiber_id", "full")
    return rows.select("fiber_id", *[F.coalesce(F.col(f"p.{c}"), F.col(f"_{c}")).alias(c) for c in ("n_channels", "rate", "gauge")])


def read_spectra(spark: SparkSession, path: str, fmt: str = "npz") -> DataFrame:
    """(infra_id, t_idx, ts_us, power, freqs): one row a time sample.

    ``npz`` files hold spectra (time x frequency), freqs, t0 (seconds, UTC) and the
    samples' offsets t in units of 1e9 seconds; ``hdf5`` needs h5py on the executors.
    """
    schema = "infra_id string, t_idx bigint, ts_us bigint, power array<double>, freqs array<double>"
    if fmt == "parquet":
        return spark.read.parquet(path)

    def load(batches):
        for pdf in batches:
            for p, content in zip(pdf.path, pdf.content):
                if fmt == "hdf5":
                    import h5py

                    with h5py.File(io.BytesIO(content)) as h:
                        z = {k: h[k][()] for k in ("spectra", "freqs", "t0", "t")}
                else:
                    z = dict(np.load(io.BytesIO(content)))
                name = p.rsplit("/", 1)[-1].rsplit(".", 1)[0]
                t = float(z["t0"]) * 1e6 + np.asarray(z["t"], float) * 1e9 * 1e6
                for at in range(0, len(t), 1000):
                    s = z["spectra"][at : at + 1000]
                    yield pd.DataFrame({"infra_id": name, "t_idx": range(at, at + len(s)), "ts_us": t[at : at + len(s)].astype("int64"), "power": list(s.astype(float)), "freqs": [z["freqs"].astype(float)] * len(s)})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(load, schema)


def read_calibration(spark: SparkSession, path: str) -> DataFrame:
    """Newest threshold file of each fiber (needed) and coupling file (optional), one row a section.

    Files are ``<fiber>_threshold*.npz`` and ``<fiber>_coupling*.npz``.
    """
    files = spark.read.format("binaryFile").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    files = files.withColumn("fiber_id", F.regexp_extract(name, r"^(.*)_(threshold|coupling)", 1)).withColumn("kind", F.regexp_extract(name, r"^(.*)_(threshold|coupling)", 2))
    newest = files.filter("kind <> ''").withColumn("rn", F.row_number().over(W.partitionBy("fiber_id", "kind").orderBy(F.desc("modificationTime"), F.desc("path")))).filter("rn = 1")

    def load(batches):
        for pdf in batches:
            for fiber, kind, content in zip(pdf.fiber_id, pdf.kind, pdf.content):
                try:
                    z = dict(np.load(io.BytesIO(content), allow_pickle=False))
                except (ValueError, OSError):
                    continue  # a corrupt file is as good as none
                get = lambda k, n, d: np.asarray(z[k], float) if k in z else np.full(n, d)  # noqa: B023,E731
                if kind == "threshold":
                    t = np.asarray(z["threshold_curve"], float)
                    yield pd.DataFrame({"fiber_id": fiber, "kind": kind, "date": str(z.get("date", "")), "section_idx": range(len(t)), "threshold": t, "baseline": get("baseline", len(t), 0.0), "noise": get("noise_estimate", len(t), 1.0), "correction": 1.0, "method": str(z.get("method", "")), "median_glrt": 0.0})
                else:
                    c = np.asarray(z["correction_factors"], float)
                    yield pd.DataFrame({"fiber_id": fiber, "kind": kind, "date": "", "section_idx": range(len(c)), "threshold": 0.0, "baseline": 0.0, "noise": 0.0, "correction": c, "method": "", "median_glrt": float(z.get("median_glrt", 0.0))})

    rows = newest.select("fiber_id", "kind", "content").mapInPandas(load, "fiber_id string, kind string, date string, section_idx int, threshold double, baseline double, noise double, correction double, method string, median_glrt double")
    t = rows.filter("kind = 'threshold'").drop("kind", "correction", "median_glrt")
    c = rows.filter("kind = 'coupling'").select("fiber_id", "section_idx", "correction", "median_glrt")
    out = t.join(c, ["fiber_id", "section_idx"], "left")
    return out.select("fiber_id", "date", "section_idx", "threshold", "baseline", "noise", F.coalesce("correction", F.lit(1.0)).alias("correction"), "method", "median_glrt")


def read_thresholds(spark: SparkSession, path: str) -> DataFrame:
    """(section_idx, detect, classify) of a two-column file without header, in file order (one file)."""
    rows = spark.read.schema("detect double, classify double").csv(path).coalesce(1)
    return rows.withColumn("section_idx", (F.row_number().over(W.orderBy(F.monotonically_increasing_id())) - 1).cast("int")).select("section_idx", "detect", "classify")


def read_feature_norm(spark: SparkSession, path: str) -> list[tuple[float, float]]:
    """(mean, std) of the five features: a file of two rows."""
    rows = spark.read.schema(", ".join(f"f{i} double" for i in range(5))).csv(path).limit(2).collect()
    return list(zip(rows[0], rows[1]))


def upsert_dim(target: DataFrame, updates: DataFrame, key: list[str], version: str) -> DataFrame:
    """Target and updates with one row a key: the latest version, the update on a tie."""
    both = target.withColumn("_new", F.lit(0)).unionByName(updates.withColumn("_new", F.lit(1)))
    return latest(both, key, version, ["_new"]).drop("_new")


def dim_diff(desired: DataFrame, existing: DataFrame, key: list[str]) -> DataFrame:
    """(change, n): keys added, updated (a value differs) and deleted."""
    values = [c for c in desired.columns if c not in key]
    d = desired.select(*key, F.struct(*values).alias("d"), F.lit(1).alias("in_d"))
    e = existing.select(*key, F.struct(*values).alias("e"), F.lit(1).alias("in_e"))
    change = F.when(F.col("in_e").isNull(), "added").when(F.col("in_d").isNull(), "deleted").when(~F.col("d").eqNullSafe(F.col("e")), "updated")
    return d.join(e, key, "full").select(change.alias("change")).filter("change is not null").groupBy("change").agg(F.count(F.lit(1)).alias("n"))


def default_sections(assign: DataFrame, coverage: DataFrame, existing: DataFrame) -> DataFrame:
    """A section for each coverage range and direction of fibers on which the org has none."""
    missing = assign.join(existing.select("org", "fiber_id").distinct(), ["org", "fiber_id"], "leftanti")
    rows = missing.join(coverage, "fiber_id").withColumn("direction", F.explode(F.array(F.lit(0), F.lit(1))))
    return rows.select("org", S.section_id(F.col("fiber_id"), F.col("direction"), F.col("start"), F.col("end")).alias("section_id"), "fiber_id", "direction", F.col("start").alias("channel_start"), F.col("end").alias("channel_end"))
