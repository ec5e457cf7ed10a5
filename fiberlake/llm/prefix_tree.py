"""Conversation prefix trie: what conversations share from their first turn on.

A turn's id is 16 bytes of a digest of role and text; a conversation is the bytes of its
turns' ids, one after the other. Tasks put these into adaptive radix trees (``Tree``):
inner nodes of 4, 16, 48 or 256 places that grow as children come, paths without a branch
kept as one run of bytes. Only depths that are whole turns are nodes of the trie, each
named by a digest of the turns up to it.

How it is dealt:

1. Conversations are read as streams in order and cut into segments of ``span`` turns.
   A segment's key is the digest of all turns before it and the ids of its own, so
   the memory in use follows the segment, whatever a conversation's length.
2. Segments go to tasks by ranges of (key, conversation), so even equal conversations are
   dealt over tasks. A task's trees are bounded by keys and bytes; a full one is written
   out. What several trees found of one node is summed by its digest.
3. A node belongs to its smallest member. Sums over subtrees need no walk: what a
   conversation's own nodes hold is a running sum along them, and its whole counts once in each
   node above, which a second pass of trees adds up over the segments that lie above.
4. The members that end in a node are listed in order in chunks by range, and the digest goes
   over the chunks; a digest is sequential, so the last step of a node is one task, which reads
   a row for each 4 096 members and holds one at a time.

Nulls: null roles and texts are empty; null turn numbers come first; rows with a null
conversation take no part. Turns of equal number follow by their ids. Repeated rows
are turns of their own. Texts may be of any length and are hashed before anything is
shuffled. Columns of other names are not looked at. Without conversations there are no
nodes, not even the root.
"""

from __future__ import annotations

import hashlib
from array import array
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .bytescan import released
from .common import drop, settle

#: Bytes of a turn's id and of a node's digest.
WIDTH = 16
ROOT = bytes(WIDTH)
SEGMENTS = "conv long, start long, key binary, sizes binary, final binary"
NODES = "node binary, parent binary, depth long, conv long, n long, size long, leaves long, saved long"


def below(digest: bytes, turn: bytes) -> bytes:
    """The digest of a node whose parent has ``digest``."""
    return hashlib.blake2b(digest + turn, digest_size=WIDTH).digest()


# the tree ---------------------------------------------------------------------------
class Listed:
    """Children of up to 4 or 16 bytes: the bytes and the nodes side by side."""

    __slots__ = ("bytes", "kids", "most")

    def __init__(self, most: int = 4):
        self.bytes, self.kids, self.most = bytearray(), [], most

    def get(self, b: int):
        at = self.bytes.find(b)
        return self.kids[at] if at >= 0 else None

    def put(self, b: int, kid):
        """Sets a child; gives the layout that holds it, this one or a larger."""
        at = self.bytes.find(b)
        if at >= 0:
            self.kids[at] = kid
            return self
        if len(self.kids) == self.most:
            larger = Listed(16) if self.most == 4 else Indexed()
            for x, k in self.items():
                larger.put(x, k)
            return larger.put(b, kid)
        self.bytes.append(b)
        self.kids.append(kid)
        return self

    def items(self):
        return zip(self.bytes, self.kids)


class Indexed:
    """Up to 48 children: a place in the list for each byte."""

    __slots__ = ("place", "kids")

    def __init__(self):
        self.place, self.kids = bytearray(256), []

    def get(self, b: int):
        at = self.place[b]
        return self.kids[at - 1] if at else None

    def put(self, b: int, kid):
        if self.place[b]:
            self.kids[self.place[b] - 1] = kid
            return self
        if len(self.kids) == 48:
            larger = Direct()
            for x, k in self.items():
                larger.put(x, k)
            return larger.put(b, kid)
        self.kids.append(kid)
        self.place[b] = len(self.kids)
        return self

    def items(self):
        return ((b, self.kids[at - 1]) for b, at in enumerate(self.place) if at)


class Direct:
    """A place for each byte."""

    __slots__ = ("kids",)

    def __init__(self):
        self.kids = [None] * 256

    def get(self, b: int):
        return self.kids[b]

    def put(self, b: int, kid):
        self.kids[b] = kid
        return self

    def items(self):
        return ((b, k) for b, k in enumerate(self.kids) if k is not None)


class Node:
    """A run of bytes after the parent's branch, and what all keys through it add up to."""

    __slots__ = ("path", "kids", "row", "conv", "n", "leaves", "saved")

    def __init__(self, path: bytes, row: tuple, conv: int, n: int, leaves: int, saved: int):
        self.path, self.kids, self.row = path, None, row
        self.conv, self.n, self.leaves, self.saved = conv, n, leaves, saved


def _common(a: bytes, b: bytes) -> int:
    """Length of the longest common start."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    x = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n - (x.bit_length() + 7) // 8


class Tree:
    """An adaptive radix tree over keys of whole turns."""

    def __init__(self):
        self.root, self.keys, self.held = None, 0, 0

    def add(self, key: bytes, start: int, sizes: bytes, conv: int, n: int = 1, leaves: int = 0, saved: int = 0) -> None:
        """Counts a key in every node on its way. ``sizes`` are the bytes of its turns' texts."""
        self.keys += 1
        self.held += len(key) + len(sizes)
        row = (key, start, sizes)
        if self.root is None:
            self.root = Node(key, row, conv, n, leaves, saved)
            return
        node, above, at = self.root, None, 0
        while True:
            same = _common(node.path, key[at:])
            if same < len(node.path):  # the path branches or ends here
                inner = Node(node.path[:same], node.row, node.conv, node.n, node.leaves, node.saved)
                inner.kids = Listed().put(node.path[same], node)
                node.path = node.path[same + 1 :]
                if above is None:
                    self.root = inner
                else:
                    above.kids = above.kids.put(key[at - 1], inner)
                node = inner
            node.conv = min(node.conv, conv)
            node.n += n
            node.leaves += leaves
            node.saved += saved
            at += same
            if at == len(key):
                return
            kid = node.kids.get(key[at]) if node.kids is not None else None
            if kid is None:
                node.kids = (node.kids or Listed()).put(key[at], Node(key[at + 1 :], row, conv, n, leaves, saved))
                return
            above, node, at = node, kid, at + 1

    def nodes(self):
        """A row as ``NODES`` for each depth of whole turns."""
        left = [(self.root, 0, b"", b"")] if self.root else []
        while left:
            node, at, digest, parent = left.pop()
            key, start, sizes = node.row
            end = at + len(node.path)
            for t in range((max(at - 1, 0)) // WIDTH + 1, end // WIDTH + 1):
                if t == 1:
                    parent, digest = b"", key[:WIDTH]
                    if start:  # the last node of the segment before
                        continue
                    size = 0
                else:
                    parent, digest = digest, below(digest, key[(t - 1) * WIDTH : t * WIDTH])
                    size = int.from_bytes(sizes[8 * (t - 2) : 8 * (t - 1)], "little")
                yield digest, parent or None, start + t - 1, node.conv, node.n, size, node.leaves, node.saved
            if node.kids is not None:
                left.extend((kid, end + 1, digest, parent) for _, kid in node.kids.items())


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)] if rows else [pa.array([], f.type) for f in schema], schema=schema)


_ARROW = {"long": pa.int64(), "binary": pa.binary(), "string": pa.string()}


def _schema(ddl: str) -> pa.Schema:
    return pa.schema([(n, _ARROW[t]) for n, t in (c.split() for c in ddl.split(", "))])


def _written(rows, ddl: str, size: int = 4096):
    schema, held = _schema(ddl), []
    for r in rows:
        held.append(r)
        if len(held) == size:
            yield _batch(held, schema)
            held = []
    if held:
        yield _batch(held, schema)


# streams of turns --------------------------------------------------------------------
def turn_ids(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, turn, id, size) of the turns: what is shuffled instead of their texts."""
    r, t = F.coalesce(F.col(role), F.lit("")), F.coalesce(F.col(text), F.lit(""))
    name = F.unhex(F.md5(F.concat(F.octet_length(r).cast("string").cast("binary"), F.lit(b":"), r.cast("binary"), t.cast("binary"))))
    return turns.filter(F.col(conv).isNotNull()).select(F.col(conv).cast("long").alias("conv"), F.col(turn).alias("turn"), name.alias("id"), F.octet_length(t).cast("long").alias("size"))


def ordered(turns: DataFrame, *by) -> DataFrame:
    """(conv, id, size) of ``turn_ids``, each conversation's turns in order in one partition; so are those of equal ``by``."""
    rows = turns.withColumn("_by", F.struct(*by) if by else F.col("conv"))
    return rows.repartition("_by").sortWithinPartitions("_by", "conv", F.asc_nulls_first("turn"), "id").select("conv", "id", "size")


def regrafted(turns: DataFrame, every: int = 5, most: int = 9) -> DataFrame:
    """Conversations that begin as another one does: (conv, id, size) in order.

    Conversation ``c`` has the first ``h`` turns of ``c - c % every`` and then its own after its
    first ``h``; ``h`` is the CRC-32 of its decimal id modulo ``most``. One without turns has a row of nulls.
    """

    def graft(batches):
        base, first, conv, left = None, [], None, 0
        empty = False
        for batch in batches:
            for c, i, size in zip(*(x.to_pylist() for x in batch.columns)):
                if c != conv:
                    if empty:
                        yield conv, None, None
                    conv = c
                    if base != c - c % every:
                        base, first = c - c % every, []
                    left = h = crc32(str(c).encode()) % most
                    empty = True
                    if c != base:
                        for x in first[:h]:
                            empty = False
                            yield c, *x
                if c == base and len(first) < most:
                    first.append((i, size))
                left -= 1
                if c == base or left < 0:  # the base begins as itself
                    empty = False
                    yield c, i, size
        if empty:
            yield conv, None, None

    group = F.col("conv") - F.pmod("conv", F.lit(every))
    ddl = "conv long, id binary, size long"
    return ordered(turns, group).mapInArrow(lambda b: _written(graft(b), ddl), ddl)


def segments(rows: DataFrame, span: int = 64) -> DataFrame:
    """``SEGMENTS`` of ``rows(conv, id, size)``, where a conversation's turns follow each other in one partition.

    ``final`` is the digest of the last node of a conversation, in its last segment.
    A row with a null id is no turn, but its conversation is a member of the root.
    """

    def cut(batches):
        conv, digest, start, key, sizes = None, ROOT, 0, [ROOT], array("q")
        for batch in batches:
            for c, i, size in zip(*(x.to_pylist() for x in batch.columns)):
                if c != conv:
                    if conv is not None:
                        yield conv, start, b"".join(key), sizes.tobytes(), digest
                    conv, digest, start, key, sizes = c, ROOT, 0, [ROOT], array("q")
                if i is None:
                    continue
                if len(sizes) == span:
                    yield conv, start, b"".join(key), sizes.tobytes(), None
                    start, key, sizes = start + span, [digest], array("q")
                key.append(i)
                sizes.append(size)
                digest = below(digest, i)
        if conv is not None:
            yield conv, start, b"".join(key), sizes.tobytes(), digest

    return rows.mapInArrow(released(lambda b: _written(cut(b), SEGMENTS, 512)), SEGMENTS)


def _trees(rows: DataFrame, keys: int, held: int) -> DataFrame:
    """``NODES`` that trees over ``rows(key, start, sizes, conv, leaves, saved)`` find, each in parts."""

    def grow(batches):
        tree = Tree()
        for batch in batches:
            for key, start, sizes, conv, leaves, saved in zip(*(x.to_pylist() for x in batch.columns)):
                tree.add(key, start, sizes, conv, 1, leaves, saved)
                if tree.keys >= keys or tree.held >= held:
                    yield from tree.nodes()
                    tree = Tree()
        yield from tree.nodes()

    dealt = rows.select("key", "start", "sizes", "conv", "leaves", "saved").repartitionByRange("key", "conv").sortWithinPartitions("key", "conv")
    return dealt.mapInArrow(released(lambda b: _written(grow(b), NODES)), NODES)


def _ends(segs: DataFrame, per: int = 4096) -> DataFrame:
    """(node, ends): the digest of the members that end in a node."""
    last = segs.filter("final is not null").select(F.col("final").alias("node"), "conv")
    counted = settle(last.groupBy("node").agg(F.count(F.lit(1)).alias("c"), F.min("conv").alias("conv")), "tree-ends")
    one = counted.filter("c = 1").select("node", F.sha2(F.col("conv").cast("string"), 256).alias("ends"))

    def chunks(batches):
        now, ids = None, []
        for batch in batches:
            for node, conv in zip(*(x.to_pylist() for x in batch.columns)):
                if ids and (node != now or len(ids) == per):
                    yield now, ids[0], ",".join(map(str, ids))
                    ids = []
                now = node
                ids.append(conv)
        if ids:
            yield now, ids[0], ",".join(map(str, ids))

    def digests(batches):
        now, sha = None, None
        for batch in batches:
            for node, _, ids in zip(*(x.to_pylist() for x in batch.columns)):
                if node != now:
                    if sha is not None:
                        yield now, sha.hexdigest()
                    now, sha = node, hashlib.sha256(ids.encode())
                else:
                    sha.update(b"," + ids.encode())
        if sha is not None:
            yield now, sha.hexdigest()

    several = settle(last.join(counted.filter("c > 1").select("node"), "node"), "tree-several")
    listed = several.repartitionByRange("node", "conv").sortWithinPartitions("node", "conv").mapInArrow(lambda b: _written(chunks(b), "node binary, first long, ids string", 64), "node binary, first long, ids string")
    many = listed.repartition("node").sortWithinPartitions("node", "first").mapInArrow(lambda b: _written(digests(b), "node binary, ends string"), "node binary, ends string")
    return one.unionByName(many)


def trie(rows: DataFrame, span: int = 64, keys: int = 50_000, held: int = 32 << 20) -> DataFrame:
    """All nodes of the trie over ``rows(conv, id, size)`` (see ``segments``).

    Gives conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and ends_sha256.
    ``keys`` and ``held`` (bytes) bound a task's tree.
    """
    segs = settle(segments(rows, span), "tree-segments")
    zero = F.lit(0).cast("long")
    found = _trees(segs.withColumns({"leaves": zero, "saved": zero}), keys, held)
    nodes = found.groupBy("node").agg(F.first("parent").alias("parent"), F.first("depth").alias("depth"), F.min("conv").alias("conv"), F.sum("n").alias("n"), F.first("size").alias("size"))
    nodes = settle(nodes, "tree-nodes")
    kids = nodes.filter("parent is not null").groupBy(F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("kids"))
    nodes_ = nodes.join(kids, "node", "left").withColumn("kids", F.coalesce("kids", F.lit(0)))
    nodes_ = nodes_.withColumns({"leaf": (F.col("kids") == 0).cast("long"), "spared": (F.col("n") - 1) * F.col("size")})
    # the nodes of a conversation follow each other; from each down to its last
    down = W.partitionBy("conv").orderBy(F.desc("depth")).rowsBetween(W.unboundedPreceding, W.currentRow)
    own = settle(nodes_.withColumns({"leaves": F.sum("leaf").over(down), "saved": F.sum("spared").over(down)}).drop("leaf", "spared"), "tree-own")
    drop(nodes)

    # what all nodes of a conversation hold counts in each node above them
    top = own.groupBy("conv").agg(F.min("depth").alias("top"), F.max("leaves").alias("leaves"), F.max("saved").alias("saved")).filter("top > 0")
    above = segs.drop("final").join(top, "conv").filter("start < top - 1 or start = 0")
    turns = F.least(F.col("top") - 1 - F.col("start"), F.length("sizes") / 8).cast("int")
    above = above.withColumn("key", F.substring("key", F.lit(1), (turns + 1) * WIDTH)).drop("top")
    above = settle(above, "tree-above")
    more = _trees(above, keys, held).groupBy("node").agg(F.sum("leaves").alias("leaves_below"), F.sum("saved").alias("saved_below"))

    # a node's parent has the same smallest member but for the first of a member's own
    first = own.join(top.select("conv", F.col("top").alias("depth")), ["conv", "depth"]).select("node", "parent")
    parents = first.join(own.select(F.col("node").alias("parent"), F.col("conv").alias("parent_conv")), "parent").select("node", "parent_conv")
    out = own.join(more, "node", "left").join(parents, "node", "left").join(_ends(segs), "node", "left")
    zero_if_none = lambda c: F.coalesce(F.col(c), F.lit(0))
    return out.select(
        F.col("conv").alias("conv_id"),
        "depth",
        F.when(F.col("depth") > 0, F.coalesce("parent_conv", "conv")).alias("parent_conv_id"),
        F.col("n").alias("n_convs"),
        F.col("kids").alias("n_children"),
        (F.col("leaves") + zero_if_none("leaves_below")).alias("n_leaves"),
        (F.col("saved") + zero_if_none("saved_below")).alias("saved_tokens"),
        F.coalesce("ends", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )
