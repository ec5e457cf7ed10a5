"""Near-duplicate vectors: cross-polytope hashes after fast Hadamard rotations.

1. Equal vectors of one label are one node; only nodes are compared.
2. A vector is rotated (three times random signs and a fast Hadamard transform); the axis
   it then lies closest to, with its sign, is a hash. ``functions`` of them and the label
   make a bucket of one of ``tables`` tables. Multiprobe: a vector also lies in the ``probes``
   buckets that change the fewest, nearest axes, so few tables suffice.
3. Buckets hold ids and 64 sign bits. Vectors that have another one within the angle's
   number of differing bits (six deviations) in a bucket stay; most go here.
4. What stays meets in its buckets with its numbers: cosines are computed in double
   precision by matrix products, block against block. A pair that shares several buckets
   counts in the first table's smallest only. A task emits for each of its vectors the number of links and
   the smallest vector it is joined with there, so no table of pairs arises.
5. Components by stars.

A bucket of more vectors than ``block`` is dealt over tasks as pairs of blocks, none of
which is left out. The work in such a bucket grows with the square of its vectors, as the number
of links asks for.

Recall: measured on pairs at the bound itself (64 dimensions, cosine 0.98), one table with two
functions and two probes has 0.953 of them, so four miss one in 200 000. With three functions
and three probes, which very many vectors of a label ask for, a table has 0.918 and six
miss as few.

Nulls: a vector that is null, all zero or holds null or non-finite components, and one
with a null label, links with nothing. Rows with a null id take part; a component's id is
the smallest that is not null. Rows that repeat an id are vectors of their own. Shorter
vectors count as filled with zeros. Columns of other names are not looked at. An empty
table gives no rows.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytescan import U, mix, released
from .common import drop, settle
from .components import components


def _matrix(column, dim: int) -> np.ndarray:
    """Rows of unit length; scaled first, so that no square leaves the range of doubles."""
    offs, flat = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False).astype(np.float64)
    n = np.diff(offs)
    x = np.zeros((len(n), dim))
    x[np.repeat(np.arange(len(n)), n), np.arange(offs[0], offs[-1]) - np.repeat(offs[:-1], n)] = flat[offs[0] : offs[-1]]
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def hadamard(x: np.ndarray) -> np.ndarray:
    """The fast Hadamard transform of each row; rows have a power of two of components."""
    n, d = x.shape
    h = 1
    while h < d:
        y = x.reshape(n, -1, 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(n, d)
        h *= 2
    return x


class CrossPolytope:
    """The hash functions of all tables, the same wherever they are made."""

    def __init__(self, dim: int, tables: int, functions: int, probes: int, seed: int = 1):
        self.width = max(8, 1 << (max(1, dim) - 1).bit_length())
        self.tables, self.functions, self.probes = tables, functions, probes
        rng = np.random.default_rng(seed)
        self.signs = rng.choice([-1.0, 1.0], (tables * functions, 3, self.width))
        self.sketch_signs = rng.choice([-1.0, 1.0], (-(-64 // self.width), 3, self.width))
        self.choices = np.array(list(itertools.product(range(3), repeat=functions)))

    def _rotate(self, x: np.ndarray, signs: np.ndarray) -> np.ndarray:
        for s in signs:
            x = hadamard(x * s) / math.sqrt(self.width)
        return x

    def _padded(self, x: np.ndarray) -> np.ndarray:
        return np.pad(x, ((0, 0), (0, self.width - x.shape[1])))

    def keys(self, x: np.ndarray, label: np.ndarray) -> np.ndarray:
        """(vector, table, own bucket and probes) of unit rows; ``label`` are hashes."""
        x, out = self._padded(x), np.empty((len(x), self.tables, 1 + self.probes), U)
        for t in range(self.tables):
            axes, costs = [], []
            for signs in self.signs[t * self.functions : (t + 1) * self.functions]:
                y = self._rotate(x, signs)
                size = np.abs(y)
                best = np.argsort(-size, axis=1, kind="stable")[:, :3]
                top = np.take_along_axis(size, best, 1)
                axes.append(best * 2 + (np.take_along_axis(y, best, 1) < 0))
                costs.append((top[:, :1] - top) ** 2)
            cost = sum(c[:, self.choices[:, k]] for k, c in enumerate(costs))
            cost[:, 0] = -1  # the nearest axes of all functions come first
            pick = self.choices[np.argsort(cost, axis=1, kind="stable")[:, : 1 + self.probes]]
            h = np.broadcast_to(mix(label.astype(U) + np.array([t + 1], U) * U(0x9E3779B97F4A7C15))[:, None], pick.shape[:2])
            for k, a in enumerate(axes):
                h = mix(h * U(0x9E3779B97F4A7C15) + np.take_along_axis(a, pick[:, :, k], 1).astype(U) + U(1))
            out[:, t] = h
        return out

    def sketches(self, x: np.ndarray) -> np.ndarray:
        """64 bits: on which side of as many planes a vector lies."""
        x = self._padded(x)
        y = np.concatenate([self._rotate(x, s) for s in self.sketch_signs], axis=1)[:, :64]
        return ((y > 0).astype(U) << np.arange(64, dtype=U)).sum(axis=1, dtype=U)


def _bits_within(cosine: float) -> int:
    """Most differing bits of two vectors at that cosine, six and a half deviations up."""
    p = math.acos(max(-1.0, min(1.0, cosine))) / math.pi
    return min(64, math.ceil(64 * p + 6.5 * math.sqrt(64 * p * (1 - p))))


def _in_units(rows: DataFrame, block: int) -> DataFrame:
    """``rows(bucket, node, ..)`` dealt by what is compared in one go, in that order: (unit, blk, i, j).

    A bucket is one unit; one of more than ``block`` rows has a unit for each pair of its blocks.
    """
    crowded = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).filter(F.col("size") > block)
    crowded = settle(crowded.select("bucket", F.ceil(F.col("size") / block).cast("int").alias("blocks")), "vector-crowded")
    dealt = rows.join(crowded, "bucket", "left") if not crowded.isEmpty() else rows.withColumn("blocks", F.lit(None).cast("int"))
    dealt = dealt.withColumn("blk", F.when(F.col("blocks").isNull(), 0).otherwise(F.pmod(F.xxhash64("node"), "blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.when(F.col("blocks").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("blocks") - 1))))
    dealt = dealt.withColumn("i", F.least("blk", "other")).withColumn("j", F.greatest("blk", "other")).drop("other", "blocks")
    return dealt.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j", "blk", "node")


def _units(batches, least: int = 0, names=("bucket", "i", "j")):
    """Whole units as record batches, each of one unit or, with ``least``, of as many as have that many rows.

    Rows of a unit follow each other.
    """
    held: list[pa.RecordBatch] = []
    last, size = None, 0

    def whole():
        return held[0] if len(held) == 1 else pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    for batch in batches:
        if not len(batch):
            continue
        key = np.stack([batch.column(n).to_numpy() for n in names])
        cuts = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(0)) + 1
        alone = np.zeros(len(batch), bool)
        alone[cuts[:-1][np.diff(cuts) == 1]] = True  # the first and the last unit may go on in other batches
        begins = np.concatenate([[0], cuts])
        at = 0
        if tuple(key[:, 0].tolist()) == last:  # goes on
            begins = begins[1:]
        ends = [x for x in begins.tolist() if not least or not alone[x]]
        for x in ends:
            if x > at:
                held.append(batch.slice(at, x - at))
                size += x - at
            if size > least:
                yield whole()
                held, size = [], 0
            at = x
        held.append(batch.slice(at))
        size += len(batch) - at
        last = tuple(key[:, -1].tolist())
    if held:
        yield whole()


def _sides(unit: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """The rows of both blocks of a unit; the same rows if it is one block."""
    i, j, blk = unit.column("i")[0].as_py(), unit.column("j")[0].as_py(), unit.column("blk").to_numpy()
    return np.flatnonzero(blk == i), np.flatnonzero(blk == j)


def _close(units: pa.RecordBatch, most: int, step: int = 256) -> np.ndarray:
    """Which rows of some whole units have another one of their unit, of the other block if it has two, within ``most`` differing bits."""
    i, j, blk, bits = (units.column(c).to_numpy() for c in ("i", "j", "blk", "sketch"))
    key = np.stack([units.column("bucket").to_numpy(), i, j])
    unit = np.concatenate([[0], np.cumsum((key[:, 1:] != key[:, :-1]).any(0))])
    hit, bits = np.zeros(len(units), bool), bits.view(U)
    for at in range(0, len(units), step):
        a = np.arange(at, min(at + step, len(units)))
        b = np.arange(at, np.searchsorted(unit, unit[a[-1]], "right"))  # pairs with rows before are seen from there
        near = np.bitwise_count(bits[a][:, None] ^ bits[b][None, :]) <= most
        near &= (unit[a][:, None] == unit[b][None, :]) & (a[:, None] < b[None, :])
        near &= (i == j)[a][:, None] | (blk[a][:, None] != blk[b][None, :])
        hit[a] |= near.any(1)
        hit[b] |= near.any(0)
    return hit


def _joined(near: np.ndarray, node: np.ndarray) -> np.ndarray:
    """The smallest node that each row of a symmetric table of links is joined with."""
    root, left = node.copy(), np.ones(len(node), bool)
    for at in range(len(node)):
        if not left[at]:
            continue
        reached = np.zeros(len(node), bool)
        reached[at] = True
        edge = reached
        while edge.any():
            edge = near[edge].any(0) & ~reached
            reached = reached | edge
        root[reached] = node[reached].min()
        left &= ~reached
    return root


def _linked(unit: pa.RecordBatch, dim: int, cosine: float, shape: tuple[int, int], step: int = 1 << 16):
    """For the rows of a unit: links that count in this bucket, and the smallest node joined with."""
    a, b = _sides(unit)
    x, node, w = _matrix(unit.column("v"), dim), unit.column("node").to_numpy(), unit.column("w").to_numpy()
    near = x[a] @ x[b].T >= cosine
    near &= (a[:, None] < b[None, :]) if len(a) == len(b) and (a == b).all() else True
    ia, ib = np.nonzero(near)
    ia, ib = a[ia], b[ib]
    keys = np.frombuffer(b"".join(unit.column("keys").to_pylist()), U).reshape(len(unit), *shape)
    here, links = U(unit.column("bucket").to_numpy().view(U)[0]), np.zeros(len(unit), np.int64)
    own = int(np.nonzero((keys[0] == here).any(1))[0][0])  # the table that the bucket is of
    for at in range(0, len(ia), step):
        p, q = ia[at : at + step], ib[at : at + step]
        for t in range(own + 1):
            shared = (keys[p, t][:, :, None] == keys[q, t][:, None, :]).any(2)
            if t < own:
                p, q = p[~shared.any(1)], q[~shared.any(1)]
        first = np.where(shared, keys[p, own], ~U(0)).min(1) == here
        np.add.at(links, p[first], w[q[first]])
        np.add.at(links, q[first], w[p[first]])
    whole = np.zeros((len(unit), len(unit)), bool)
    whole[ia, ib] = whole[ib, ia] = True
    return node, _joined(whole, node), links


def near_vectors(
    df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", cosine: float = 0.98, tables: int = 4, functions: int = 2, probes: int = 2, block: int = 1024
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of ``df``."""
    floats = df.schema[vec_col].dataType.simpleString() == "array<float>"  # doubles hold them as they are
    x = F.col(vec_col) if floats else F.transform(vec_col, lambda e: e.cast("double"))
    bad = lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf"))
    usable = F.col(label_col).isNotNull() & F.col(vec_col).isNotNull() & ~F.exists(x, bad) & F.exists(x, lambda e: e != 0)
    rows = df.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"), F.when(usable, F.col(label_col).cast("string")).alias("label"), F.when(usable, x).alias("v"))
    rows = settle(rows, "near-vectors")  # rows keep their numbers from here
    used = rows.filter("v is not null")
    name = [F.xxhash64("label", "v").alias("h"), F.xxhash64(F.lit(1), "label", "v").alias("h2")]
    named = used.select("row", "id", *name)
    copies = named.groupBy("h", "h2").agg(F.min("row").alias("node"), F.count(F.lit(1)).alias("w"))
    copies = settle(copies.filter("w > 1"), "vector-copies")
    repeated = settle(used.select("row", *name).join(copies, ["h", "h2"]).select("row", "node", "w"), "vector-repeated")
    nodes = used.join(repeated, "row", "left").filter("node is null or node = row")
    nodes = nodes.select(F.col("row").alias("node"), F.xxhash64("label").alias("label"), "v", F.coalesce("w", F.lit(1)).cast("long").alias("w"))
    dim = used.agg(F.max(F.size("v"))).first()[0] or 1
    shape = (tables, 1 + probes)

    def put(batches):
        hashes = CrossPolytope(dim, *(tables, functions, probes))
        for batch in batches:
            for at in range(0, len(batch), 2048):
                part = batch.slice(at, 2048)
                m = _matrix(part.column("v"), dim)
                keys = hashes.keys(m, part.column("label").to_numpy().view(U)).reshape(len(part), -1)
                each = lambda a: pa.array(np.repeat(a, keys.shape[1]).view(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), each(part.column("node").to_numpy()), each(hashes.sketches(m))], names=["bucket", "node", "sketch"])

    buckets = settle(nodes.mapInArrow(released(put), "bucket long, node long, sketch long"), "vector-buckets")
    most = _bits_within(cosine)

    def candidates(batches):
        for unit in _units(batches, 512):
            hit = _close(unit, most)
            if hit.any():
                yield pa.RecordBatch.from_arrays([unit.column("bucket").filter(pa.array(hit)), unit.column("node").filter(pa.array(hit))], names=["bucket", "node"])

    met = _in_units(buckets, block).mapInArrow(released(candidates), "bucket long, node long").distinct()
    met = settle(met, "vector-candidates")
    drop(buckets)

    def again(batches):
        hashes = CrossPolytope(dim, *(tables, functions, probes))
        for batch in batches:
            for at in range(0, len(batch), 2048):
                part = batch.slice(at, 2048)
                keys = hashes.keys(_matrix(part.column("v"), dim), part.column("label").to_numpy().view(U))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("node", "w", "v")), pa.array([k.tobytes() for k in keys], pa.binary())], names=["node", "w", "v", "keys"])

    kind = "float" if floats else "double"
    hashed = nodes.join(met.select("node").distinct(), "node", "leftsemi").mapInArrow(released(again), f"node long, w long, v array<{kind}>, keys binary")
    hashed = settle(hashed, "vector-hashed")

    def verify(batches):
        for unit in _units(batches):
            if len(unit) < 2:
                continue
            node, root, links = _linked(unit, dim, cosine, shape)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (node, root, links)], names=["a", "b", "links"])

    found = _in_units(met.join(hashed, "node"), block).mapInArrow(released(verify), "a long, b long, links long").filter("links > 0 or a <> b")
    found = settle(found, "vector-links")
    drop(met, hashed)

    links = found.groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    comps = components(found).withColumnRenamed("component", "comp")
    linked = links.join(comps, "node", "full").select("node", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("comp", "node").alias("comp"))
    linked = settle(linked.join(repeated.select("node", "w").distinct(), "node", "full").select("node", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("comp", "node").alias("comp"), F.coalesce("w", F.lit(1)).alias("w")), "vector-linked")
    own = rows.select("row", "id").join(repeated.select("row", "node"), "row", "left").select("row", "id", F.coalesce("node", "row").alias("node"))
    own = settle(own.join(linked, "node", "left"), "vector-rows")
    least = own.filter("comp is not null").groupBy("comp").agg(F.min("id").alias("least"))
    out = own.join(least, "comp", "left")
    component = F.when(F.col("comp").isNull(), F.col("id")).otherwise(F.col("least"))
    n = F.coalesce(F.col("links") + F.col("w") - 1, F.lit(0)).cast("long")
    return out.select(F.col("id").alias("vec_id"), n.alias("n_links"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))
