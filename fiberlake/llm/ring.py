"""Sharding on a consistent-hash ring with bounded loads.

Every shard has ``vnodes`` points on the ring; a key belongs to the first point at or
after its hash. A shard takes at most its capacity. Keys beyond it continue clockwise
to the next shard with room (Mirrokni, Thorup and Zadimoghaddam, 2018). With
``slack=0`` the capacities are the numbers of rows that differ by at most one and sum
to all rows, so counts are at most one apart; a larger slack moves fewer keys.

What depends on the data's size is distributed: counts by arc and ranks within arcs.
The driver walks the ring over counts of ``shards * vnodes`` arcs, whatever the
number of rows, and gives each arc's ranks as ranges to shards.

Nulls: a null id is a key like any other; a null text has no bytes. Equal texts are keys
of their own, so a group of copies is spread over the ring by its ids. Repeated rows are
keys of their own too, ordered by id, size and checksum; rows that are equal in all three
are counted before they are numbered. Columns of other names are not looked at. An empty
table gives no rows.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import rank_within, settle

SPAN = 1 << 32


def ring(shards: int, vnodes: int) -> list[tuple[int, int]]:
    """(point, shard), in order of the points."""
    point = lambda s, v: int.from_bytes(hashlib.blake2b(f"{s}/{v}".encode(), digest_size=8).digest(), "big") % SPAN
    return sorted((point(s, v), s) for s in range(shards) for v in range(vnodes))


def walk(owners: list[int], counts: list[int], capacity: list[int]) -> list[tuple[int, int, int, int, int]]:
    """(arc, first rank, rows, shard, first slot): each shard takes its own keys, then what comes clockwise."""
    room, filled = list(capacity), [0] * len(capacity)
    out, left = [], []

    def take(arc: int, first: int, n: int, shard: int) -> int:
        got = min(n, room[shard])
        if got:
            out.append((arc, first, got, shard, filled[shard]))
            room[shard] -= got
            filled[shard] += got
        return got

    for arc, (shard, n) in enumerate(zip(owners, counts)):
        got = take(arc, 0, n, shard)
        left.append((got, n - got))
    moving: list[tuple[int, int, int]] = []  # (arc, first rank, rows), the longest on the way first
    for lap in range(2):
        for arc, shard in enumerate(owners):
            still = []
            for origin, first, n in moving:
                got = take(origin, first, n, shard)
                if n > got:
                    still.append((origin, first + got, n - got))
            moving = still
            if lap == 0 and left[arc][1]:
                moving.append((arc, *left[arc]))
    assert not moving, "capacities sum to less than the keys"
    return out


def assign(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = 24, vnodes: int = 64, slack: float = 0.0) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) of every row."""
    spark = docs.sparkSession
    points = ring(shards, vnodes)
    arcs = [p for p, _ in points]
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(F.encode(text, "utf-8")).alias("text_crc32"))
    # the arc is found by cutting the span into equal cells, each with the arcs that begin in it
    cells = 4 * len(arcs)
    cell_of = lambda p: p * cells // SPAN
    table = [(c, [p for p in arcs if cell_of(p) == c], bisect_left(arcs, -(-c * SPAN // cells))) for c in range(cells)]
    cell_df = spark.createDataFrame(table, "cell int, points array<long>, base int")
    key = F.shiftrightunsigned(F.xxhash64("doc_id"), 32)
    rows = rows.withColumn("key", key).withColumn("cell", F.floor(F.col("key") * cells / SPAN).cast("int")).join(F.broadcast(cell_df), "cell")
    passed = F.size(F.filter("points", lambda p: p < F.col("key")))
    rows = rows.withColumn("arc", F.pmod(F.col("base") + passed, F.lit(len(arcs))).cast("int")).select("doc_id", "size", "text_crc32", "key", "arc")
    rows = settle(rows, "ring-keys")

    counts = dict(rows.groupBy("arc").count().collect())  # at most shards * vnodes rows
    counts = [counts.get(a, 0) for a in range(len(arcs))]
    total = sum(counts)
    share = [total // shards + (s < total % shards) for s in range(shards)]
    ranges = walk([s for _, s in points], counts, [x + int(x * slack) for x in share])
    by_arc: dict[int, list] = {}
    for arc, *x in ranges:
        by_arc.setdefault(arc, []).append(tuple(x))
    spans = spark.createDataFrame(list(by_arc.items()), "arc int, spans array<struct<first:long,rows:long,shard:int,slot:long>>")
    ranked = rank_within(rows, "arc", ["key", "doc_id", "size", "text_crc32"], "rank").join(F.broadcast(spans), "arc")
    span = F.filter("spans", lambda s: (s["first"] <= F.col("rank")) & (F.col("rank") < s["first"] + s["rows"]))[0]
    return ranked.withColumn("span", span).select("doc_id", "size", "text_crc32", F.col("span.shard").alias("shard"), (F.col("span.slot") + F.col("rank") - F.col("span.first")).alias("slot"))
