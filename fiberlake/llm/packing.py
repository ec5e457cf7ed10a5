"""Best-fit packing with large-item matching.

A document's ids and an end id are cut into pieces of at most ``capacity`` tokens;
only longer documents are cut. Pieces above a third of the capacity fit at most two to
a sequence: they are matched greedily, each largest with the largest that still fits.
Smaller pieces then go, in falling order, where the gap that is left is smallest;
a new sequence is opened where none fits.

A piece's place depends on its length alone, so the plan is made over the histogram of
lengths, which has at most ``capacity`` numbers at any scale, and pieces are placed by
their rank among those of their length. Ranks come from Spark (``rank_within``), so
hot lengths are dealt over many tasks.

Nulls: a null text is an empty one, whose only token is the end id. A null id is kept.
Repeated rows are documents of their own; pieces that are equal in id, place, length and
checksum are counted before they are numbered. Columns of other names are not looked at. An empty
table gives no rows.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import default_path, encoder, forget
from .bytescan import pieces as slices
from .bytescan import released
from .common import rank_within, settle


def cut_pieces(docs: DataFrame, id_col: str, text_col: str, capacity: int, path: str, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of all documents, and ids if asked for."""

    def cut(batches):
        enc = encoder(path)
        for batch in batches:
            for part in slices(batch, 1):
                ids, bounds = enc.encode(part.column(1))
                cols = [[] for _ in range(6)]
                for i, doc in enumerate(part.column(0).to_pylist()):
                    x = np.append(ids[bounds[i] : bounds[i + 1]], end_id).astype("<u4")
                    for k, at in enumerate(range(0, len(x), capacity)):
                        y = x[at : at + capacity]
                        for c, v in zip(cols, (doc, k, at, len(y), zlib.crc32(y.tobytes()), y.astype(np.int32) if with_ids else None)):
                            c.append(v)
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()))
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
                n = 6 if with_ids else 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols[:n], kinds)], names=names[:n])
        forget(path)

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(released(cut), schema)


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """How to place ``counts[length]`` pieces: (length, first rank, rows, run, sequence, offset).

    Rank ``first + j`` goes to sequence ``sequence + j // run`` at ``offset + (j % run) * length``.
    """
    left = {n: c for n, c in counts.items() if c}
    large = sorted(n for n in left if 3 * n > capacity)
    gaps: list[int] = []  # sorted gaps that some group of sequences has
    groups: dict[int, list[tuple[int, tuple]]] = {}  # gap: (sequences, ((length, run), ...))
    done: list[tuple[int, tuple]] = []

    def keep(gap: int, n: int, held: tuple):
        if n and gap == 0:
            done.append((n, held))
        elif n:
            if gap not in groups:
                groups[gap] = []
                insort(gaps, gap)
            groups[gap].append((n, held))

    while large:
        a = large[-1]
        k = bisect_left(large, capacity - a + 1) - 1
        b = large[k] if k >= 0 else None
        if b == a and left[a] < 2:
            b = large[k - 1] if k >= 1 else None
        if b is None:
            keep(capacity - a, left.pop(a), ((a, 1),))
            large.pop()
            continue
        n = left[a] // 2 if a == b else min(left[a], left[b])
        keep(capacity - a - b, n, ((a, 2),) if a == b else ((a, 1), (b, 1)))
        for x in (a, b):
            left[x] -= n
        for x in {a, b}:
            if not left[x]:
                left.pop(x)
                large.pop(bisect_left(large, x))
    for x in sorted(left, reverse=True):
        n = left[x]
        while n:
            k = bisect_left(gaps, x)
            if k == len(gaps):
                run = capacity // x
                keep(capacity - run * x, n // run, ((x, run),))
                keep(capacity - n % run * x, bool(n % run), ((x, n % run),))
                break
            gap = gaps[k]
            m, held = groups[gap].pop()
            if not groups[gap]:
                del groups[gap]
                gaps.pop(k)
            run = gap // x
            full = min(m, n // run)
            part = n - full * run if full < m and n - full * run < run else 0
            keep(gap - run * x, full, (*held, (x, run)))
            keep(gap - part * x, bool(part), (*held, (x, part)))
            keep(gap, m - full - bool(part), held)
            n -= full * run + part
    done += [x for xs in groups.values() for x in xs]
    out, ranks, sequence = [], {}, 0
    for n, held in done:
        offset = 0
        for x, run in held:
            out.append((x, ranks.get(x, 0), n * run, run, sequence, offset))
            ranks[x] = ranks.get(x, 0) + n * run
            offset += run * x
        sequence += n
    return out


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, path: str | None = None) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of every piece."""
    cut = settle(cut_pieces(docs, id_col, text_col, capacity, path or default_path()), "pieces")
    counts = dict(cut.groupBy("length").count().collect())  # at most `capacity` rows
    by_length: dict[int, list] = {}
    for x, *rest in plan(counts, capacity):
        by_length.setdefault(x, []).append(tuple(rest))
    spans = docs.sparkSession.createDataFrame(list(by_length.items()), "length long, spans array<struct<first:long,rows:long,run:long,sequence:long,offset:long>>")
    ranked = rank_within(cut, "length", ["doc_id", "piece", "start", "ids_crc32"], "rank")
    # spans of a length follow each other by rank; their number follows the capacity, not the data
    flat = spans.select("length", F.inline("spans"))
    hit = (ranked["length"] == flat["length"]) & (ranked["rank"] >= flat["first"]) & (ranked["rank"] < flat["first"] + flat["rows"])
    j = F.col("rank") - F.col("first")
    return ranked.join(F.broadcast(flat), hit).select("doc_id", "piece", "start", ranked["length"], "ids_crc32", (F.col("sequence") + F.floor(j / F.col("run"))).alias("sequence_id"), (F.col("offset") + j % F.col("run") * ranked["length"]).alias("offset"))


def assemble(docs: DataFrame, placed: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, path: str | None = None) -> DataFrame:
    """(sequence_id, ids) of the packed sequences; ids of documents must be unique."""
    ids = cut_pieces(docs, id_col, text_col, capacity, path or default_path(), with_ids=True).select("doc_id", "piece", "ids")
    rows = placed.join(ids, ["doc_id", "piece"])
    held = F.sort_array(F.collect_list(F.struct("offset", "ids")))  # at most `capacity` ids a sequence
    return rows.groupBy("sequence_id").agg(F.flatten(F.transform(held, lambda x: x["ids"])).alias("ids"))
