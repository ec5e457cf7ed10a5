"""Connected components of an edge table.

Each task first reduces its own edges to a forest by union-find; alternating large and
small stars, which deal every step over all tasks, then join the forests.

Edges with a null end and loops are left out; repeated edges count once. An empty table
gives no rows.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import drop, settle


def _forest(frames):
    """Union-find over all edges of a partition: (u, v) from each node to its smallest."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while parent.setdefault(top, top) != top:
            top = parent[top]
        while parent[x] != top:
            parent[x], x = top, parent[x]
        return top

    for pdf in frames:
        for a, b in zip(pdf["u"].tolist(), pdf["v"].tolist()):
            a, b = root(a), root(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
    nodes = list(parent)
    for at in range(0, len(nodes), 100_000):
        part = [(x, root(x)) for x in nodes[at : at + 100_000]]
        yield pd.DataFrame([p for p in part if p[0] != p[1]], columns=["u", "v"], dtype="int64")


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for all nodes of ``edges(a, b)``; the component is its smallest node.

    Every round joins each node with the smallest of its neighbours, so the table
    shrinks towards stars; the number of rounds grows with the logarithm of the
    longest path. Nothing but two figures a round reaches the driver.
    """
    e = edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    e = settle(e.mapInPandas(_forest, "u long, v long").distinct(), "edges")
    seen = None
    while True:
        now = e.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        if now == seen or now["n"] == 0:
            return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
        seen = now
        # windows keep the rows of a node on disk if need be; nothing is gathered in memory
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = F.min("v").over(W.partitionBy("u"))
        large = both.withColumn("m", F.least("u", least)).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = large.withColumn("m", least)
        small = small.select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"), F.when(F.col("v") != F.col("m"), F.col("u")).alias("w"))
        small = small.select(F.explode(F.array_compact(F.array("u", "w"))).alias("u"), "v")
        done, e = e, settle(small.distinct(), "edges")
        drop(done)
