"""N-gram Jaccard join by PartEnum signatures (Arasu, Ganti and Kaushik, 2006).

Documents are sets of word shingles; two link when their Jaccard similarity is at
least ``num / den``. The result is exact.

* Sizes fall into bands so that linked sets lie in one band or in two that adjoin. A
  set takes part in its own band's instance and in the next one's.
* In a band whose largest size is r, linked sets differ in at most
  k = 2 r (den - num) / (den + num) elements. The domain is cut into n1 parts by hash,
  so some part differs in at most k2 elements; each part is cut into n2 smaller ones,
  so some n2 - k2 of these do not differ at all. Every choice of part and of n2 - k2
  smaller ones gives a signature, the hash of the set's elements there. Linked sets
  share one.
* A signature of no element would be shared by strangers. A set emits it only if the
  parts that may give one are as many as the parts that must agree with any partner;
  otherwise some agreeing part of the pair has elements, so nothing is lost.

Before that, sets that cannot have a partner are left out: a linked set has at most m
elements that its partner lacks, so of any m + e elements of it, others hold at least
e. The first pass counts this over the smallest hashes of every set, the second over
all elements of those that remain. Both ship packed arrays by bucket: four bytes of hash
for an element (two that agree there count as met, so a set may only be kept too much)
and two for its row; an element that many sets hold leaves each task once. Only texts of
sets that the first pass keeps are shuffled, and whole hashes only of those that the
second keeps.

Within a signature no pairs are emitted: sets are compared with the signature's hub (the
set that shares most signatures), verified links are merged, and only sets of different
components that still share a signature are compared further. Linked sets share at least
as many signatures as parts must agree, so sets that share too few with all of other
components together go first. The rest are compared block against block inside a task:
first the numbers of signatures that pairs share, then the elements of sets with enough,
which gives the links alone.

Equal sets (a 128-bit digest of their sorted hashes) are one node. Elements are 64-bit
hashes.

Nulls: a null text, an empty text or one without words has an empty set, size 0, and
is its own component; a row with a null id takes no part, has a row of its own in the
result and a null component. Rows of one id are one document with one row in the
result; if their texts differ, each text links on its own, the document is linked with all
that any of them is, and ``n_shingles`` is the size of its largest set. Texts may have any length. An empty table gives an empty result. Columns other
than id and text are not looked at.
"""

from __future__ import annotations

from itertools import combinations
from math import ceil

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytescan import NOT_SPACE, U, mix, pieces, released, row_bounds, utf8, words
from .common import bitmap, drop, may_be_in, settle
from .components import components

#: Packed elements (``elems``, ``ids``) and, without them, the rows themselves; ``base`` names the pack.
MARKS = "bucket int, base long, elems binary, ids binary, id int, doc long, n long, digest binary, need long, cnt long"


def shingle_sets(batch: pa.RecordBatch, column: int, width: int):
    """For each row the sorted distinct hashes of its shingles of ``width`` words."""
    for part in pieces(batch, column):
        buf, offs = utf8(part.column(column))
        starts, _, h = words(buf, offs, NOT_SPACE)
        bounds = row_bounds(offs, starts)
        for i in range(len(part)):
            w = h[bounds[i] : bounds[i + 1]]
            if not len(w):
                yield part, i, w
                continue
            k = min(width, len(w))
            acc = np.zeros(len(w) - k + 1, U)
            for j in range(k):
                acc = mix(acc + w[j : len(w) - k + 1 + j] + U(j + 1))
            yield part, i, np.unique(acc)


def lacking(n, num: int, den: int):
    """How many of n elements a linked set may not share with its partner."""
    return n - -(-n * num // den)


class Packer:
    """Collects (element, row) and gives packed elements by bucket, and counts of what meets here.

    A pack has at most 65 536 rows, numbered from 0, and about ``most`` elements.
    """

    def __init__(self, buckets: int, most: int = 800_000):
        self.buckets, self.most, self.packs = buckets, most, TaskContext.get().partitionId() << 32
        self.rows, self.elems, self.size = [], [], 0
        self.seen: set[bytes] = set()

    def add(self, doc, n, digest, need, elems):
        fresh = doc is not None and digest is not None and digest not in self.seen
        if fresh:
            self.seen.add(digest)
        self.rows.append((doc, n, digest, need if fresh else None))
        self.elems.append(elems if fresh else elems[:0])
        self.size += len(self.elems[-1])
        return self.size >= self.most or len(self.rows) >= 1 << 16

    def flush(self):
        if not self.rows:
            return
        counts = np.zeros(len(self.rows), np.int64)
        e = np.concatenate(self.elems)
        owner = np.repeat(np.arange(len(self.rows), dtype=np.uint16), [len(x) for x in self.elems])
        out = {k: [] for k in ("bucket", "elems", "ids")}
        if len(e):
            e = (e >> U(32)) | (e << U(32))  # the low bits lead: elements were chosen by their high ones
            order = np.argsort(e)
            e, owner = e[order], owner[order]
            new = np.append(True, e[1:] != e[:-1])
            at = np.flatnonzero(new)
            run = np.diff(np.append(at, len(e)))
            counts += np.bincount(owner[np.repeat(run > 1, run)], minlength=len(counts))
            one, bits = e[at], (e[at] >> U(32)) * U(self.buckets)
            # an element's owner, or the mark of many: those rows have counted it themselves
            ids, key, bucket = np.where(run > 1, 0, owner[at].astype(np.uint32) + 1), bits & U(0xFFFFFFFF), bits >> U(32)
            key = (key ^ (one & U(0xFFFFFFFF)) * U(0x9E3779B1)).astype(np.uint32)
            ids = ids.astype(np.uint16 if len(self.rows) < 1 << 16 else np.uint32)
            for b, lo, hi in zip(*(lambda u, i: (u, i, np.append(i[1:], len(bucket))))(*np.unique(bucket, return_index=True))):
                for k, v in zip(out, (int(b), key[lo:hi].tobytes(), ids[lo:hi].tobytes())):
                    out[k].append(v)
        packed, n = len(out["bucket"]), len(self.rows)
        doc, size, digest, need = zip(*self.rows)
        cols = {
            "bucket": out["bucket"] + [i % self.buckets for i in range(n)], "base": [self.packs] * (packed + n), "elems": out["elems"] + [None] * n, "ids": out["ids"] + [None] * n, "id": [None] * packed + [*range(n)],
            "doc": [None] * packed + [*doc], "n": [None] * packed + [*size], "digest": [None] * packed + [*digest], "need": [None] * packed + [*need], "cnt": [None] * packed + counts.tolist(),
        }
        self.rows, self.elems, self.size, self.packs = [], [], 0, self.packs + 1
        kinds = (pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64())
        table = pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(cols.values(), kinds)], names=list(cols))
        for i in range(0, len(table), 5_000):
            yield table.slice(i, 5_000)


def _meet(table: pa.Table) -> pa.Table:
    """Within a bucket, how many of each row's elements others hold too: packed by pack."""
    rows, packed = (table.filter(pc.is_valid(table[c])).drop_columns("bucket") for c in ("id", "elems"))
    if not len(packed):
        return rows
    keys = [np.frombuffer(x.as_buffer(), np.uint32) for x in packed["elems"]]
    ids = [np.frombuffer(y.as_buffer(), np.uint16 if len(y.as_buffer()) == 2 * len(x) else np.uint32).astype(np.uint32) for x, y in zip(keys, packed["ids"])]
    pack = np.repeat(np.arange(len(keys), dtype=np.int64), [len(x) for x in keys])
    keys, ids = np.concatenate(keys), np.concatenate(ids)
    order = np.argsort(keys)
    keys = keys[order]
    run = np.diff(np.append(np.flatnonzero(np.append(True, keys[1:] != keys[:-1])), len(keys)))
    met = order[np.repeat(run > 1, run)]
    met = met[ids[met] > 0]
    who, n = np.unique((pack[met] << 32) | (ids[met].astype(np.int64) - 1), return_counts=True)
    cut = np.flatnonzero(np.append(True, who[1:] >> 32 != who[:-1] >> 32)) if len(who) else np.zeros(0, int)
    ends, bases = np.append(cut[1:], len(who)), packed["base"].to_numpy()
    sums = {"base": bases[who[cut] >> 32], "elems": [n[i:j].astype("<u4").tobytes() for i, j in zip(cut, ends)], "ids": [(who[i:j] & 0xFFFFFFFF).astype("<u4").tobytes() for i, j in zip(cut, ends)]}
    return pa.concat_tables([rows, pa.table([pa.array(sums[f.name], f.type) if f.name in sums else pa.nulls(len(cut), f.type) for f in rows.schema], schema=rows.schema)])


def _enough(table: pa.Table) -> pa.Table:
    """The rows of a pack, and whether enough of their elements were met."""
    rows = table.filter(pc.is_valid(table["id"])).sort_by("id")
    count = rows["cnt"].to_numpy().copy()
    packed = table.filter(pc.is_valid(table["elems"]))
    for n, ids in zip(packed["elems"], packed["ids"]):
        count[np.frombuffer(ids.as_buffer(), "<u4")] += np.frombuffer(n.as_buffer(), "<u4")
    enough = pc.fill_null(pc.less_equal(rows["need"], pa.array(count)), False)
    return rows.select(["doc", "n", "digest"]).append_column("enough", enough)


def _marks(df: DataFrame, mapper, buckets: int, name: str) -> DataFrame:
    """(doc, n, digest, enough) of every row that ``mapper`` packs."""
    met = df.mapInArrow(mapper, MARKS).groupBy("bucket").applyInArrow(_meet, MARKS.removeprefix("bucket int, "))
    return settle(met.groupBy("base").applyInArrow(_enough, "doc long, n long, digest binary, enough boolean"), name)


def band_tops(most: int, num: int, den: int) -> list[int]:
    tops, lo = [], 1
    while not tops or tops[-1] < most:
        tops.append(lo * den // num)
        lo = tops[-1] + 1
    return tops


def plan(top: int, num: int, den: int) -> tuple[int, int, int]:
    """(n1, n2, k2) for the band whose largest size is ``top``."""
    k = 2 * top * (den - num) // (den + num)
    if k <= 3:
        return 1, k + 2 if k else 1, k
    half = k // 2
    return half + 1 + ceil(0.15 * half), 3, 1


def signatures(ids, sets, num: int, den: int):
    """(signature, id) of all sets, as two arrays, and how many each set shares with a linked one at least."""
    tops = band_tops(max(len(s) for s in sets), num, den)
    sigs, owners, least = [], [], []
    of = np.searchsorted(tops, [len(s) for s in sets])
    tops = [*tops, (tops[-1] + 1) * den // num]
    for doc, s, own in zip(ids, sets, of):
        scattered, value = mix(s ^ U(0x5BD1E995)), mix(s + U(77))
        shared = []
        for b in (int(own), int(own) + 1):
            n1, n2, k2 = plan(tops[b], num, den)
            cell = ((scattered >> U(32)) * U(n1) >> U(32)).astype(np.int64) * n2 + ((scattered & U(0xFFFFFFFF)) * U(n2) >> U(32)).astype(np.int64)
            order = np.argsort(cell, kind="stable")
            c = cell[order]
            at = np.flatnonzero(np.append(True, c[1:] != c[:-1]))
            sums = np.zeros(n1 * n2, U)
            sums[c[at]] = np.add.reduceat(value[order], at)
            full = np.zeros(n1 * n2, bool)
            full[c[at]] = True
            sums, full = sums.reshape(n1, n2), full.reshape(n1, n2)
            # of n1 parts, any partner in this band leaves at least `agree` with at most k2 differences
            other = min(tops[b], len(s) * den // num)
            agree = n1 - ((den - num) * (len(s) + other) // (den + num)) // (k2 + 1)
            risky = int(((~full).sum(1) >= n2 - k2).sum())
            shared.append(agree - risky if risky < agree else agree)
            for j, pick in enumerate(combinations(range(n2), n2 - k2)):
                sig = np.zeros(n1, U)
                for x in pick:
                    sig = mix(sig + sums[:, x] + U(x + 1))
                some = full[:, pick].any(1)
                sig = mix(sig + mix(np.arange(n1, dtype=U) + U(b * 1_000_003 + j * 7_919_000_000_000)))
                sig = sig[some] if risky < agree else sig
                sigs.append(sig)
                owners.append(np.full(len(sig), doc, np.int64))
        least.append(max(1, min(shared)))
    return np.concatenate(sigs), np.concatenate(owners), np.array(least, np.int64)


def _verified(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Those of ``pairs(a, b)`` whose similarity is enough."""

    def similar(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y")):
                x, y = np.frombuffer(x.as_buffer(), U), np.frombuffer(y.as_buffer(), U)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(den * both >= num * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    x = sets.select(F.col("rep").alias("a"), F.col("elems").alias("x"), F.col("n").alias("nx"))
    y = sets.select(F.col("rep").alias("b"), F.col("elems").alias("y"), F.col("n").alias("ny"))
    sizes = pairs.join(x.drop("x"), "a").join(y.drop("y"), "b").filter(den * F.least("nx", "ny") >= num * F.greatest("nx", "ny")).select("a", "b")
    sizes = settle(sizes, "sized-pairs")
    x, y = may_be_in(x.drop("nx"), "a", bitmap(sizes, "a")), may_be_in(y.drop("ny"), "b", bitmap(sizes, "b"))
    return sizes.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(similar, "a long, b long")


def _shared(x: tuple, y: tuple) -> np.ndarray:
    """How much the rows of two blocks have in common: each block as (elements, row of each, weight of each, rows).

    Products of matrices, a few thousand elements at a time.
    """
    common = np.intersect1d(np.unique(x[0]), np.unique(y[0]), assume_unique=True)
    cut = []
    for e, owner, weight, _ in (x, y):
        at = np.searchsorted(common, e)
        ok = at < len(common)
        ok[ok] = common[at[ok]] == e[ok]
        order = np.argsort(at[ok], kind="stable")
        cut.append((at[ok][order], owner[ok][order], weight[ok][order]))
    out = np.zeros((x[3], y[3]), np.float32)
    for lo in range(0, len(common), 4096):
        m = []
        for (at, owner, weight), n in zip(cut, (x[3], y[3])):
            i, k = np.searchsorted(at, [lo, lo + 4096])
            one = np.zeros((n, 4096), np.float32)
            one[owner[i:k], at[i:k] - lo] = weight[i:k]
            m.append(one)
        out += m[0] @ m[1].T
    return out.astype(np.int64)


def _sides(pdf: pd.DataFrame):
    """For each two blocks of a task their names and rows; a block by itself is both."""
    for (i, j), one in pdf.groupby(["i", "j"]):
        x = one[one.blk == i]
        y = x if i == j else one[one.blk == j]
        if len(x) and len(y):
            yield i, j, x, y


def _may_link(pdf: pd.DataFrame) -> pd.DataFrame:
    """Rows that share enough signatures with one of another component in the other block."""
    out = []
    for i, j, x, y in _sides(pdf):
        sides = []
        for d, one in ((x, False), (y, True)):
            size = d.sigs.map(len).to_numpy()
            weight = np.concatenate(d.many.to_numpy())
            sides.append((np.concatenate(d.sigs.to_numpy()), np.repeat(np.arange(len(d)), size), np.ones(len(weight)) if one else weight, len(d)))
        least = np.maximum(x["least"].to_numpy()[:, None], y["least"].to_numpy()[None, :])
        ok = (_shared(*sides) >= least) & (x.comp.to_numpy()[:, None] != y.comp.to_numpy()[None, :])
        out += [d.loc[ok.any(k), ["i", "j", "blk", "rep", "comp"]] for d, k in ((x, 1), *(((y, 0),) if i != j else ()))]
    return pd.concat(out) if out else pd.DataFrame(columns=["i", "j", "blk", "rep", "comp"], dtype="int64")


def _links(pdf: pd.DataFrame, num: int, den: int) -> pd.DataFrame:
    """Links that join different components, among two blocks of sets or within one: a forest of them."""
    out = []
    for _, _, x, y in _sides(pdf):
        sides = []
        for d in (x, y):
            e = np.concatenate([np.frombuffer(b, U) for b in d.elems])
            sides.append((e, np.repeat(np.arange(len(d)), d.n.to_numpy()), np.ones(len(e)), len(d)))
        inter = _shared(*sides)
        near = den * inter >= num * (x.n.to_numpy()[:, None] + y.n.to_numpy()[None, :] - inter)
        cx, cy, rx, ry = x.comp.to_numpy(), y.comp.to_numpy(), x.rep.to_numpy(), y.rep.to_numpy()
        near &= cx[:, None] != cy[None, :]
        parent: dict[int, int] = {}

        def root(c: int) -> int:
            while parent.get(c, c) != c:
                c = parent[c]
            return c

        for i, j in zip(*np.nonzero(near)):
            a, b = root(int(cx[i])), root(int(cy[j]))
            if a != b:
                parent[max(a, b)] = min(a, b)
                out.append((int(rx[i]), int(ry[j])))
    return pd.DataFrame(out, columns=["a", "b"]).astype("int64")


def _open(members: DataFrame) -> DataFrame:
    """The rows of ``members(sig, rep, comp, ..)`` whose signature has members of several components."""
    split = members.groupBy("sig").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi").select("sig")
    return members.join(split, "sig")


def _blocks(open_: DataFrame, sets: DataFrame, least: DataFrame, num: int, den: int, block: int = 512) -> DataFrame:
    """Links across components among the members of open signatures, block against block.

    Sets lie in blocks of about ``block`` by the heaviest hub whose signature they share,
    so families stay together. Two blocks are compared, in one task that holds these
    two, only if some signature has members in both; that gives a forest of links.
    """
    for _ in range(2):  # who goes may leave others with too few
        enough = open_.groupBy("rep").agg(F.sum("many").alias("c")).join(least, "rep").filter("c >= least").select("rep")
        open_ = settle(_open(open_.join(enough, "rep")), "open-members")
    own = open_.groupBy("rep", "comp").agg(F.max(F.struct("bw", "b")).alias("h"), F.collect_list("sig").alias("sigs"), F.collect_list("many").alias("many")).select("rep", "comp", F.col("h.b").alias("hub"), "sigs", "many")
    own = own.join(least, "rep")
    size = open_.groupBy("rep").agg(F.max(F.struct("bw", "b")).alias("h")).groupBy(F.col("h.b").alias("hub")).agg(F.count(F.lit(1)).alias("k"))
    nb = F.floor((F.col("k") - 1) / block) + 1
    own = settle(own.join(size, "hub").select("rep", "comp", "sigs", "many", "least", F.xxhash64("hub", F.pmod(F.xxhash64("rep"), nb)).alias("blk")), "blocks")
    # a signature's blocks are few; signatures with the same blocks count once
    held = own.select(F.explode("sigs").alias("sig"), "blk").distinct()
    held = held.groupBy("sig").agg(F.sort_array(F.collect_set("blk")).alias("blks")).select("blks").distinct()
    i = held.select("blks", F.posexplode("blks").alias("at", "i"))
    pairs = settle(i.select("i", F.explode(F.slice("blks", F.col("at") + 1, F.size("blks") - F.col("at"))).alias("j")).distinct(), "block-pairs")
    sides = pairs.select("i", "j", F.col("i").alias("blk")).unionByName(pairs.filter("i <> j").select("i", "j", F.col("j").alias("blk")))
    per = 1024  # small pairs share tasks
    tasks = 1 + sides.join(own.groupBy("blk").agg(F.count(F.lit(1)).alias("k")), "blk").agg(F.sum("k")).first()[0] // per if not pairs.isEmpty() else 1
    task = F.pmod(F.xxhash64("i", "j"), F.lit(tasks)).alias("task")
    some = sides.join(own, "blk").select(task, "i", "j", "blk", "rep", "comp", "sigs", "many", "least").groupBy("task").applyInPandas(_may_link, "i long, j long, blk long, rep long, comp long")
    some = settle(some, "block-members")
    rows = some.join(may_be_in(sets, "rep", bitmap(some, "rep")), "rep")
    return rows.select(task, "i", "j", "blk", "rep", "comp", "n", "elems").groupBy("task").applyInPandas(lambda pdf: _links(pdf, num, den), "a long, b long")


def _by_texts(docs: DataFrame, width: int, num: int, den: int, pivots: int) -> DataFrame:
    """``near_duplicates`` of ``docs(doc, text)`` where an id has several texts: texts are compared, and those of an id joined."""
    texts = docs.filter("doc is not null").withColumn("key", F.xxhash64("doc", "text"))
    near = near_duplicates(texts, "key", "text", width, num, den, pivots).withColumnRenamed("doc_id", "key")
    near = settle(texts.select("doc", "key").distinct().join(near, "key"), "shingle-texts-near")
    first = near.groupBy("doc").agg(F.min("component_id").alias("a"))
    joined = components(near.join(first, "doc").select("a", F.col("component_id").alias("b"))).withColumnRenamed("node", "component_id")
    near = near.join(joined, "component_id", "left").select("doc", "n_shingles", F.coalesce("component", "component_id").alias("comp"))
    near = settle(near, "shingle-texts-joined")
    least = near.groupBy("comp").agg(F.min("doc").alias("component_id"))
    out = near.join(least, "comp").groupBy(F.col("doc").alias("doc_id")).agg(F.max("n_shingles").alias("n_shingles"), F.first("component_id").alias("component_id"))
    return out.unionByName(near_duplicates(docs.filter("doc is null"), "doc", "text", width, num, den, pivots))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, num: int = 75, den: int = 100, pivots: int = 2) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of ``docs``."""
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    # as many buckets as keep each at a few million elements, whatever the number of partitions read
    buckets = max(128, int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * docs.rdd.getNumPartitions())

    def first_pass(batches):
        packer = Packer(buckets)
        for batch in batches:
            for part, i, s in shingle_sets(batch, 1, width):
                n = len(s)
                m = lacking(n, num, den)
                e = min(n, m + 1 + n // 20)
                if packer.add(part.column(0)[i].as_py(), n, xxhash.xxh3_128_digest(s.tobytes()) if n else None, e - m if n else None, s[:e]):
                    yield from packer.flush()
        yield from packer.flush()

    marks = _marks(docs, released(first_pass), buckets, "shingle-marks")
    info = marks.filter("doc is not null").groupBy("doc").agg(F.max(F.struct("n", "digest")).alias("s"), F.count(F.lit(1)).alias("rows"), (F.min("digest") != F.max("digest")).alias("several")).select("doc", "s.n", "s.digest", "rows", "several")
    info = settle(info, "shingle-info")
    if not info.filter("several").isEmpty():
        return _by_texts(docs, width, num, den, pivots)
    info = info.drop("several")
    canon = info.filter("digest is not null").groupBy("digest").agg(F.min(F.struct("doc", "rows")).alias("r")).select("digest", F.col("r.doc").alias("rep"), "r.rows")
    held = marks.filter("enough").groupBy("digest").agg(F.lit(True).alias("held")).select("digest")
    held = settle(canon.join(held, "digest"), "shingle-candidates")

    def sets_of(batches):
        def batch_of(held):
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*held), (pa.int64(), pa.int64(), pa.binary()))], names=["rep", "n", "elems"])

        for batch in batches:
            held: list[tuple] = []
            for part, i, s in shingle_sets(batch, 1, width):
                b = s.tobytes()
                if xxhash.xxh3_128_digest(b) == part.column(2)[i].as_py():
                    held.append((part.column(0)[i].as_py(), len(s), b))
                if len(held) == 200:
                    yield batch_of(held)
                    held = []
            if held:
                yield batch_of(held)

    texts = may_be_in(docs, "doc", bitmap(held, "rep")).join(held.withColumnRenamed("rep", "doc"), "doc")
    one, many = (texts.filter(f"rows {x} 1").select("doc", "text", "digest") for x in ("=", ">"))
    texts = settle(one if held.filter("rows > 1").isEmpty() else one.unionByName(many.dropDuplicates(["doc", "text"])), "shingle-texts")

    def second_pass(batches):
        packer = Packer(buckets)
        for batch in batches:
            for part, i, s in shingle_sets(batch, 1, width):
                digest = xxhash.xxh3_128_digest(s.tobytes())
                if digest == part.column(2)[i].as_py() and packer.add(part.column(0)[i].as_py(), len(s), digest, len(s) - lacking(len(s), num, den), s):
                    yield from packer.flush()
        yield from packer.flush()

    left = _marks(texts, released(second_pass), buckets, "set-marks").filter("enough")
    sets = may_be_in(texts, "doc", bitmap(left, "doc")).mapInArrow(released(sets_of), "rep long, n long, elems binary")
    sets = settle(sets, "sets")
    drop(texts, held)

    def sign(batches):
        for batch in batches:
            for at in range(0, len(batch), 200):
                part = batch.slice(at, 200)
                sig, owner, least = signatures(part.column(0).to_pylist(), [np.frombuffer(x.as_buffer(), U) for x in part.column(1)], num, den)
                yield pa.RecordBatch.from_arrays([pa.array(sig.view(np.int64)), pa.array(owner), pa.nulls(len(sig), pa.int64())], names=["sig", "rep", "least"])
                yield pa.RecordBatch.from_arrays([pa.nulls(len(part), pa.int64()), part.column(0), pa.array(least)], names=["sig", "rep", "least"])

    signed = settle(sets.select("rep", "elems").mapInArrow(released(sign), "sig long, rep long, least long"), "signatures")
    sigs, least = signed.filter("sig is not null").select("sig", "rep"), settle(signed.filter("sig is null").select("rep", "least"), "signatures-least")
    # of signatures with the same members one will do; smallest, number and a 64-bit sum name the members
    multi = sigs.groupBy("sig").agg(F.min("rep").alias("p"), F.bit_xor(F.xxhash64("rep")).alias("x"), F.count(F.lit(1)).alias("size")).filter("size > 1")
    kept = settle(multi.groupBy("p", "size", "x").agg(F.min("sig").alias("sig"), F.count(F.lit(1)).alias("many")).select("sig", "size", "many"), "signatures-kept")
    members = settle(may_be_in(sigs, "sig", bitmap(kept, "sig")).join(kept, "sig"), "signature-members")
    drop(signed, kept)

    # the heaviest set of a signature, by the candidates it shares all its signatures with, is its hub
    weight = members.groupBy("rep").agg(F.sum("size").alias("w"))
    light, members = members, settle(members.select("sig", "rep", "many").join(weight, "rep"), "signature-weights")
    drop(light)
    heaviest = F.max(F.struct("w", (-F.col("rep")).alias("r")))
    hubs = members.groupBy("sig").agg(heaviest.alias("z")).select("sig", (-F.col("z.r")).alias("b"), F.col("z.w").alias("bw"))
    hub = members.join(hubs, "sig").filter("rep <> b").groupBy(F.col("rep").alias("a")).agg(F.max(F.struct("bw", (-F.col("b")).alias("r"))).alias("z"))
    tried = settle(hub.select("a", (-F.col("z.r")).alias("b")), "pairs")
    links = settle(_verified(tried, sets, num, den), "links")
    comps = settle(components(links), "components")
    for turn in range(pivots + 1):
        named = members.join(comps.withColumnRenamed("node", "rep"), "rep", "left").select("sig", "rep", "many", "w", F.coalesce("component", "rep").alias("comp"))
        split = named.groupBy("sig").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.max(F.struct("w", F.xxhash64("rep", F.lit(turn)).alias("h"), "rep", "comp")).alias("z")).filter("lo <> hi")
        open_ = settle(named.join(split.select("sig", F.col("z.rep").alias("b"), F.col("z.w").alias("bw"), F.col("z.comp").alias("b_comp")), "sig"), "open-members")
        if open_.isEmpty():
            break
        if turn < pivots:  # each signature's hub with the members of other components
            new = open_.filter("comp <> b_comp").select(F.col("rep").alias("a"), "b").distinct().join(tried, ["a", "b"], "leftanti")
            new = settle(new, "pairs")
            tried = tried.unionByName(new)
            more = settle(_verified(new, sets, num, den), "links")
        else:  # what hubs leave: all sets that still share signatures, in blocks
            more = settle(_blocks(open_, sets, least, num, den), "links")
        drop(open_)
        if not more.isEmpty():
            links = links.unionByName(more)
            comps = settle(components(links), "components")
    named = canon.join(comps.withColumnRenamed("node", "rep"), "rep", "left").select("digest", F.coalesce("component", "rep").alias("component"))
    named = settle(named, "shingle-components")  # so Spark can split a digest that many rows have
    out = info.filter("digest is not null").join(named, "digest").select(F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))
    alone = info.filter("digest is null").union(marks.filter("doc is null").select(*info.columns[:3], F.lit(1).alias("rows"))).select(F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("doc").alias("component_id"))
    return out.unionByName(alone)
