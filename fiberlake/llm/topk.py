"""Exact top-k search by distributed histogram selection.

Vectors are integers: floor(scale * x). Queries and candidates are dealt in blocks over
a grid, so each task scores one block of queries against one block of candidates by a
matrix product. Nothing is kept of the scores but histograms:

1. Every query starts with the range its scores can lie in. Each task counts its scores
   in ``bins`` equal parts of the range; counts are summed over all tasks, and the part
   that holds the k-th highest becomes the new range. This repeats until a range is a
   single score, the k-th value.
2. Then each task emits what lies above that value, and of the ties the smallest ids
   that can still be needed. Ranks follow by score and id.

A task sends counts only from its own k-th highest score upwards: the global one cannot
be lower.

Nulls: a vector that is null, or holds null or a non-finite component, and a row with a
null id take no part. Shorter vectors count as filled with zeros. Rows that repeat an
id are rows of their own, as queries and as candidates; a query's candidates are all rows
but itself. Components may be of any finite size and scores are exact; those beyond the
range of a long count as its ends. Fewer than k candidates give all of them. Columns of
other names are not looked at. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import settle


#: Ends of the range of scores.
LEAST, MOST = -(1 << 63), (1 << 63) - 1


def _matrix(rows, dim: int, scale: int) -> np.ndarray:
    """floor(scale * x) of the rows' doubles: as doubles, which hold whole numbers exactly, or as Python's integers."""
    m = np.zeros((len(rows), dim))
    for i, v in enumerate(rows):
        m[i, : len(v)] = v
    with np.errstate(over="ignore"):
        out = np.floor(m * scale)
    if np.isfinite(out).all():
        return out
    return np.vectorize(lambda x, y: int(x) if np.isfinite(x) else int(y) * scale, otypes=[object])(out, m)


def _scores(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Inner products, exactly, in the narrowest arithmetic that holds them."""
    most = int(abs(q).max(initial=0)) * int(abs(c).max(initial=0)) * q.shape[1]
    exact = object in (q.dtype, c.dtype)
    if most < 1 << 24 and not exact:
        return (q.astype(np.float32) @ c.T.astype(np.float32)).astype(np.int64)
    if most < 1 << 53 and not exact:
        return (q @ c.T).astype(np.int64)
    whole = lambda m: m if m.dtype == object else np.array([[int(x) for x in r] for r in m], object).reshape(m.shape)
    if most < 1 << 63:
        return whole(q).astype(np.int64) @ whole(c).astype(np.int64).T
    return np.clip(whole(q) @ whole(c).T, LEAST, MOST).astype(np.int64)


def vectors_of(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(row, id, v): the vectors that take part, as floats or doubles; ``row`` tells rows of one id apart."""
    floats = df.schema[vec_col].dataType.simpleString() == "array<float>"  # doubles hold them as they are
    x = F.col(vec_col) if floats else F.transform(vec_col, lambda e: e.cast("double"))
    bad = lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf"))
    rows = df.filter(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull()).filter(~F.exists(x, bad))
    return rows.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"), x.alias("v"))


def top_k(df: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = 64, bins: int = 256, query_block: int = 1024, block: int = 4096) -> DataFrame:
    """(query_id, rank, vec_id, score) of the rows for which ``is_query`` holds of ``id``."""
    vectors = settle(vectors_of(df, id_col, vec_col), "vectors")  # rows keep their numbers from here
    # a component's floor is at most 1 above its size, so the norm bounds every score
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, e: a + F.pow(F.abs(e.cast("double")) * scale + 1, F.lit(2.0))))
    n = vectors.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("d"), F.count(F.when(is_query, 1)).alias("q"), F.max(norm).alias("norm")).first()
    dim, q_blocks, c_blocks = max(1, n["d"] or 1), max(1, -(-n["q"] // query_block)), max(1, -(-n["n"] // block))

    # blocks by hash: about equal, whatever the ids
    cands = vectors.select("row", "id", "v", F.pmod(F.xxhash64("row"), F.lit(c_blocks)).alias("cb"))
    cands = cands.withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1)))).withColumn("qb", F.col("qb").cast("long"))
    far = norm * float(n["norm"] or 0) * (1 + 1e-9) + 1  # no rounding may cut the range
    far = F.when(far < float(1 << 62), F.ceil(F.least(far, F.lit(float(1 << 62)))))
    lo, hi = F.coalesce(-far, F.lit(LEAST)), F.coalesce(far, F.lit(MOST))
    queries = vectors.filter(is_query).select("row", "id", "v", F.pmod(F.xxhash64("row", F.lit(1)), F.lit(q_blocks)).alias("qb"), lo.cast("long").alias("lo"), hi.cast("long").alias("hi"))
    queries = queries.withColumn("above", F.lit(0).cast("long"))

    def grid(q: DataFrame):
        dealt = q.withColumn("cb", F.explode(F.sequence(F.lit(0), F.lit(c_blocks - 1)))).withColumn("cb", F.col("cb").cast("long"))
        return dealt.groupBy("qb", "cb").cogroup(cands.groupBy("qb", "cb"))

    def blocks(q: pd.DataFrame, c: pd.DataFrame):
        """Scores of a few hundred queries at a time, and where a query meets itself."""
        if not len(q) or not len(c):
            return
        c = c.sort_values("id", kind="stable")
        ids, rows, m = c.id.to_numpy(), c.row.to_numpy(), _matrix(c.v.tolist(), dim, scale)
        for at in range(0, len(q), 256):
            part = q.iloc[at : at + 256]
            s = _scores(_matrix(part.v.tolist(), dim, scale), m)
            yield part, ids, s, part.row.to_numpy()[:, None] == rows[None, :]

    def count(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        out = []
        for part, _, s, own in blocks(q, c):
            lo, hi = (np.broadcast_to(part[x].to_numpy()[:, None], s.shape) for x in ("lo", "hi"))
            u = lambda x: x.astype(np.uint64)  # noqa: E731  differences of longs, modulo 2**64
            width = (u(hi) - u(lo)) // np.uint64(bins) + np.uint64(1)
            bin_ = np.where(s > hi, bins, np.where(s < lo, -1, ((u(s) - u(lo)) // width).astype(np.int64)))  # above counts, below does not
            bin_[own] = -1
            flat = (bin_ + 1 + np.arange(len(part))[:, None] * (bins + 2)).ravel()
            h = np.bincount(flat, minlength=len(part) * (bins + 2)).reshape(len(part), bins + 2)[:, 1:]
            from_top = h[:, ::-1].cumsum(1)[:, ::-1]
            i, b = np.nonzero((h > 0) & (from_top - h < k))
            out.append(pd.DataFrame({"row": part.row.to_numpy()[i], "bin": b, "n": h[i, b]}))
        return pd.concat(out) if out else pd.DataFrame({"row": [], "bin": [], "n": []}, dtype="int64")

    open_ = queries
    done: DataFrame | None = None
    while True:
        counts = grid(open_).applyInPandas(count, "row long, bin int, n long").groupBy("row", "bin").agg(F.sum("n").alias("n"))
        down = W.partitionBy("row").orderBy(F.desc("bin"))
        counts = counts.withColumn("upto", F.sum("n").over(down.rowsBetween(W.unboundedPreceding, 0)))
        # the bin of the k-th score, or the lowest that has any
        at = counts.filter(F.col("upto") - F.col("n") < k).groupBy("row").agg(F.min(F.struct("bin", (F.col("upto") - F.col("n")).alias("over"))).alias("x"))
        wide = lambda c: F.col(c).cast("decimal(20,0)")
        width = F.call_function("div", wide("hi") - wide("lo"), F.lit(bins).cast("decimal(20,0)")) + 1
        low = wide("lo") + F.col("x.bin").cast("decimal(20,0)") * width.cast("decimal(20,0)")
        nxt = open_.join(at, "row").select("row", "id", "v", "qb", low.cast("long").alias("lo"), F.least((low + width - 1).cast("decimal(30,0)"), wide("hi").cast("decimal(30,0)")).cast("long").alias("hi"), F.col("x.over").alias("above"))
        nxt = settle(nxt, "thresholds")
        exact = nxt.filter("lo = hi")
        done = exact if done is None else done.unionByName(exact)
        open_ = nxt.filter("lo < hi")
        if open_.isEmpty():
            break

    def emit(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        out = []
        for part, ids, s, own in blocks(q, c):
            lo, need = part.lo.to_numpy()[:, None], k - part.above.to_numpy()[:, None]
            tie = (s == lo) & ~own
            keep = ((s > lo) & ~own) | (tie & (tie.cumsum(1) <= need))
            i, j = np.nonzero(keep)
            out.append(pd.DataFrame({"row": part.row.to_numpy()[i], "query_id": part.id.to_numpy()[i], "vec_id": ids[j], "score": s[i, j]}))
        return pd.concat(out) if out else pd.DataFrame({"row": [], "query_id": [], "vec_id": [], "score": []}, dtype="int64")

    found = grid(done).applyInPandas(emit, "row long, query_id long, vec_id long, score long")
    rank = F.row_number().over(W.partitionBy("row").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
