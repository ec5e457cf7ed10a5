"""Shared plumbing: reading tables, cutting lineage, ranks inside bounded keys."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: A word: a maximal run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

_own_dir: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach; a temporary one only where none is set and Spark runs in one process."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not _own_dir:
        _own_dir.append(tempfile.mkdtemp(prefix="spark-shared-"))
    return _own_dir[0]


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again.

    This cuts the lineage, survives lost executors and keeps columnar compression.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._settled_at = path
    return out


def drop(*tables: DataFrame) -> None:
    """Deletes tables of ``settle`` that nothing will read again."""
    for df in tables:
        spark, path = df.sparkSession, df._settled_at
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def rank_within(df: DataFrame, key: str, order: list[str], rank: str, per: int = 5_000) -> DataFrame:
    """Number the rows of each key from 0 without a gap, in column ``rank``.

    ``key`` must have few values, whatever the number of rows (a ring arc, a length
    up to a capacity). A key with many rows is dealt over several salts, so no task
    gets all rows of a hot key: the rank is the offset of the salt plus the place
    within the salt. Rows that are equal in all columns are counted before that, take
    part as one row and become several again at the end, without a sort.
    """
    rows = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_copies"))
    salts = rows.groupBy(key).agg((F.floor((F.count(F.lit(1)) - 1) / per) + 1).alias("_salts"))
    salted = rows.join(F.broadcast(salts), key).withColumn("_salt", F.pmod(F.xxhash64(*order), "_salts"))
    before = W.partitionBy(key).orderBy("_salt").rowsBetween(W.unboundedPreceding, -1)
    sizes = salted.groupBy(key, "_salt").agg(F.sum("_copies").alias("_n"))
    offsets = sizes.select(key, "_salt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    within = W.partitionBy(key, "_salt").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    ranked = salted.withColumn("_place", F.coalesce(F.sum("_copies").over(within), F.lit(0))).join(offsets, [key, "_salt"])
    ranked = ranked.withColumn("_first", F.col("_before") + F.col("_place"))
    # in parts, so that no array follows the number of copies
    part = F.explode(F.sequence(F.lit(0), F.col("_copies") - 1, F.lit(_PART)))
    ranked = ranked.select(*df.columns, "_first", "_copies", part.alias("_part"))
    each = F.explode(F.sequence(F.col("_part"), F.least(F.col("_part") + (_PART - 1), F.col("_copies") - 1)))
    return ranked.select(*df.columns, "_first", each.alias("_copy")).select(*df.columns, (F.col("_first") + F.col("_copy")).alias(rank))


#: Copies of a row that are written from one array.
_PART = 4096


_BUCKETS = 2048


def bitmap(rows: DataFrame, key: str) -> DataFrame:
    """Bits of hashed keys: 4 kB in each of at most 2048 buckets (8 MB), whatever the number of rows."""
    h = F.pmod(F.xxhash64(key), F.lit(_BUCKETS * 32768))
    bits = rows.select(F.floor(h / 32768).cast("int").alias("__bucket"), (h % 32768).alias("__bit"))
    return bits.groupBy("__bucket").agg(F.bitmap_construct_agg("__bit").alias("__bits"))


def free(rows: DataFrame, name: str) -> str:
    """``name``, or one like it that ``rows`` has no column of; Spark takes names without regard to case."""
    taken = {c.lower() for c in rows.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def marked(rows: DataFrame, key: str, bits: DataFrame, name: str = "__maybe") -> DataFrame:
    """``rows`` with ``name``, which they must not have: false if the key is surely none of the bitmap's."""
    h = F.pmod(F.xxhash64(key), F.lit(_BUCKETS * 32768))
    bucket, held = free(rows, "__bucket"), free(rows, "__bits")
    bits = bits.select(F.col("__bucket").alias(bucket), F.col("__bits").alias(held))
    out = rows.withColumn(bucket, F.floor(h / 32768).cast("int")).join(F.broadcast(bits), bucket, "left")
    byte = F.conv(F.hex(F.substring(held, F.floor((h % 32768) / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    bit = F.getbit(byte, (h % 8).cast("int"))
    return out.withColumn(name, F.coalesce(bit == 1, F.lit(False))).drop(bucket, held)


def may_be_in(rows: DataFrame, key: str, bits: DataFrame) -> DataFrame:
    """Rows whose key may be one of the bitmap's, so that a join with those keys shuffles few others."""
    name = free(rows, "__maybe")
    return marked(rows, key, bits, name).filter(name).drop(name)
