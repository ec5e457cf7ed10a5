"""Keyset, descending and offset pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def clamp(limit: int | None, default: int, most: int) -> int:
    return max(1, min(most, default if limit is None else limit))


def page(df: DataFrame, keys: list[str], cursor: tuple | None = None, limit: int | None = None) -> DataFrame:
    """The next rows after the cursor in order of the keys, one more than the limit.

    The extra row tells whether there is more; the next cursor is the last key shown.
    Spark plans a top-k of the limit, not a full sort.
    """
    if cursor is not None:
        df = df.filter(F.struct(*keys) > F.struct(*[F.lit(v).alias(k) for k, v in zip(keys, cursor)]))
    return df.orderBy(*keys).limit(clamp(limit, 1000, 5000) + 1)


def page_desc(df: DataFrame, ts: str, tie: str, cursor: tuple | None = None, limit: int | None = None) -> DataFrame:
    """Newest first; the id breaks ties, so none is lost between pages."""
    if cursor is not None:
        df = df.filter((F.col(ts) < F.lit(cursor[0])) | ((F.col(ts) == F.lit(cursor[0])) & (F.col(tie) > F.lit(cursor[1]))))
    return df.orderBy(F.desc(ts), tie).limit(clamp(limit, 100, 1000) + 1)


def offset_page(df: DataFrame, order: list, offset: int = 0, limit: int = 50) -> DataFrame:
    limit = max(1, min(200, limit))
    return df.orderBy(*order).offset(max(0, offset)).limit(limit + 1)


def latest_n(df: DataFrame, n: int, ts: str = "timestamp", tie: str = "incident_id") -> DataFrame:
    return df.orderBy(F.desc(ts), tie).limit(n)
