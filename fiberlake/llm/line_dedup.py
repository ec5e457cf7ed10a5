"""Line dedup: a deletion-neighbourhood join over the words of lines.

A line is what stands between line feeds, without white space at its ends; its words
are what stands between single spaces. Of equal lines with at least ``min_chars``
characters, and of lines with at least ``near_words`` words that one word inserted,
deleted or replaced makes equal, only the earliest by (doc_id, line number) stays: a
line goes if any earlier line is equal or within that bound, whether or not that one
stays itself.

How near lines meet:

1. One edit leaves the first or the last ``c`` words of both lines as they are, where
   ``c`` is near half the longer line's length (``_half``). Lines that share no such end
   with another line have no neighbour and go no further. This loses nothing.
2. The others emit, for each shared end, every variant with one word of the other part
   deleted, as hashed keys. Replaced words meet at equal variants of the same place;
   an inserted word's variant meets the whole shorter line.
3. Keys are aggregated (earliest line of each), so no pairs within a key arise. Each
   line is compared with the earliest of its keys and the edit distance verified on
   the words themselves.

Aggregates combine before they shuffle, and joins stand between two exchanges, so Spark
can split a key that many rows have. Of the texts only lines that have a shared end are
shuffled, and in the end the texts of documents that lose lines. Bitmaps of fixed size
(8 MB) of hashed keys leave out most rows that a join would drop. Tables go as soon as
nothing reads them any more.

Only DataFrame functions are used. Nulls: a null text has no lines and stays null;
rows with a null id stay as they are and take no part. A document is an id with a text
(its 64-bit hash): rows of one id with different texts are documents of their own, which
follow each other by that hash; rows equal in both are one document, so they lose the
same lines. Empty texts and tables stay empty.
Blank lines always stay, as do lines below ``min_chars``; with 1, which the query and the
pipeline take, every other line is compared. A line of very many words is one window
over them. Columns of the input are kept, whatever their names, but for two that have
the names of the columns added.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import bitmap, drop, free, marked, may_be_in, settle

#: White space of ASCII, as it is cut from the ends of lines.
BLANK = " \t\n\x0b\x0c\r"


def _trimmed(line: Column) -> Column:
    return F.btrim(line, F.lit(BLANK))


def _half(n: str) -> Column:
    """Words of an end: at most half of ``n``, the same for some lengths that follow each other."""
    step = f"shiftleft(1, greatest(length(bin({n})) - 4, 0))"
    return F.expr(f"cast(({n}) div (2 * {step}) * {step} as int)")


def _lines(docs: DataFrame, id_col: str, text_col: str, min_chars: int, near_words: int) -> DataFrame:
    """(doc, no, k, k2, n, ends): each line's hashes, words and, if it has enough, hashed ends."""
    rows = docs.select(F.col(id_col).alias("doc"), F.posexplode(F.split(text_col, "\n")).alias("no", "line"))
    rows = rows.select("doc", "no", _trimmed(F.col("line")).alias("line")).filter(F.length("line") >= min_chars)
    n = (F.octet_length("line") - F.octet_length(F.replace("line", F.lit(" "), F.lit(""))) + 1).cast("int")
    rows = rows.select("doc", "no", "line", n.alias("n"), F.xxhash64("line").alias("k"), F.xxhash64(F.lit(1), "line").alias("k2"))
    rows = rows.withColumn("c", _half("n")).withColumn("c1", _half("n + 1"))
    first = lambda c: F.xxhash64(F.lit("p"), F.col(c), F.expr(f"substring_index(line, ' ', {c})"))
    last = lambda c: F.xxhash64(F.lit("s"), F.col(c), F.expr(f"substring_index(line, ' ', -{c})"))
    ends = F.when(F.col("n") >= near_words, F.when(F.col("c") == F.col("c1"), F.array(first("c"), last("c"))).otherwise(F.array(first("c"), last("c"), first("c1"), last("c1"))))
    return rows.select("doc", "no", "k", "k2", "n", ends.alias("ends"))


#: Kinds of keys: a word replaced, the longer of two lines, the shorter one.
SAME, LONGER, SHORTER = 0, 1, 2


def _variants(near: DataFrame) -> DataFrame:
    """(key, kind, k): hashed keys of ``near(k, words, n, end, side, c, least, most)``.

    A sequence's hash is the sum, over its words, of a hash of word and place, as two
    sums of 31-bit halves. A variant's hash follows from running sums over the words.
    """
    rows = near.select("k", "n", "end", "side", "c", "least", "most", F.posexplode("words").alias("i", "word"))
    for name, place in (("here", F.col("i")), ("back", F.col("i") - 1)):
        h = F.xxhash64("word", place)
        rows = rows.withColumn(f"{name}0", h.bitwiseAND(F.lit(0x7FFFFFFF))).withColumn(f"{name}1", F.shiftrightunsigned(h, 33))
    one = W.partitionBy("k", "end", "n")
    upto = one.orderBy("i").rowsBetween(W.unboundedPreceding, W.currentRow)
    for p in (0, 1):  # the words before a place as they stand, those after it one place back
        here, back = F.sum(f"here{p}").over(upto), F.sum(f"back{p}").over(one) - F.sum(f"back{p}").over(upto)
        rows = rows.withColumn(f"upto{p}", here).withColumn(f"after{p}", back)
    cut = F.xxhash64("end", *[F.col(f"upto{p}") - F.col(f"here{p}") + F.col(f"after{p}") for p in (0, 1)])
    whole = F.xxhash64("end", "upto0", "upto1")
    rows = rows.select("k", "n", "i", "least", "most", cut.alias("cut"), whole.alias("whole"), F.when(F.col("side") == "p", F.col("i") >= F.col("c")).otherwise(F.col("i") < F.col("n") - F.col("c")).alias("open"))
    kind = lambda name, on, *parts: F.when(on, F.struct(F.xxhash64(*parts).alias("key"), F.lit(name).alias("kind")))
    keys = F.array(
        kind(SAME, F.col("open"), "cut", "n", "i"),
        kind(LONGER, F.col("open") & (F.col("n") > F.col("least")), "cut", F.lit(-1)),
        kind(SHORTER, (F.col("i") == F.col("n") - 1) & (F.col("n") < F.col("most")), "whole", F.lit(-1)),
    )
    return rows.select("k", F.inline(F.filter(keys, lambda x: x.isNotNull()))).select("key", "kind", "k")


def _one_edit(a: Column, b: Column) -> Column:
    """Whether one word inserted, deleted or replaced makes the word arrays equal."""
    na, nb = F.size(a), F.size(b)
    n = F.least(na, nb)
    same = F.transform(F.sequence(F.lit(1), n), lambda i: F.element_at(a, i) == F.element_at(b, i))
    p = F.array_position(same, False)
    p = F.when(p == 0, n + 1).otherwise(p).cast("int")
    rest = lambda x, size, start: F.when(start > size, F.array().cast("array<string>")).otherwise(F.slice(x, start, F.greatest(size - start + 1, F.lit(0))))
    return (
        F.when(na == nb, rest(a, na, p + 1) == rest(b, nb, p + 1))
        .when(na == nb + 1, rest(a, na, p + 1) == rest(b, nb, p))
        .when(nb == na + 1, rest(a, na, p) == rest(b, nb, p + 1))
        .otherwise(False)
    )


def dropped_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20, near_words: int = 8) -> DataFrame:
    """The lines to drop, as (doc, no); ``no`` counts from 0. ``id_col`` may be a struct; it must tell texts apart."""
    docs = docs.filter(F.col(id_col).isNotNull()).select(id_col, text_col)
    near_words = max(4, near_words)
    lines = settle(_lines(docs, id_col, text_col, min_chars, near_words), "lines")
    firsts = settle(lines.groupBy("k", "k2").agg(F.min(F.struct("doc", "no")).alias("at"), F.count(F.lit(1)).alias("copies")), "line-firsts")

    ends = lines.filter("ends is not null").select("k", "n", F.posexplode("ends").alias("e", "end"))
    shared = ends.groupBy("end").agg(F.min("k").alias("lo"), F.max("k").alias("hi"), F.min("n").alias("least"), F.max("n").alias("most")).filter("lo <> hi")
    shared = settle(shared.select("end", "least", "most"), "line-shared-ends")
    # copies of a line count once before the join
    some = may_be_in(ends, "end", bitmap(shared, "end")).groupBy("k", "end", "e").agg(F.first("n").alias("n"))
    side, c = F.when(F.col("e") % 2 == 0, "p").otherwise("s"), F.when(F.col("e") < 2, _half("n")).otherwise(_half("n + 1"))
    open_ends = settle(some.join(shared, "end").select("k", "end", side.alias("side"), c.alias("c"), "least", "most"), "line-open-ends")
    drop(shared)

    met = open_ends.select("k").distinct()
    held = settle(may_be_in(firsts, "k", bitmap(open_ends, "k")).join(met, "k").select("k", "k2", "at"), "line-held")
    # the lines themselves, found by their place in the texts
    spot = lambda doc, no: F.xxhash64(doc, no).alias("spot")
    places = bitmap(held.select(spot("at.doc", "at.no")), "spot")
    text = marked(docs, id_col, bitmap(held, "at.doc")).filter("__maybe").select(F.col(id_col).alias("doc"), F.posexplode(F.split(text_col, "\n")).alias("no", "line"))
    text = may_be_in(text.select(spot("doc", "no"), _trimmed(F.col("line")).alias("line")), "spot", places)
    text = text.select(F.xxhash64("line").alias("k"), F.xxhash64(F.lit(1), "line").alias("k2"), F.split("line", " ").alias("words"))
    words = settle(text.join(held, ["k", "k2"]).dropDuplicates(["k", "k2"]), "line-words")
    drop(held)

    keys = _variants(words.select("k", "words", F.size("words").alias("n")).join(open_ends, "k"))
    keys = settle(keys, "line-variants")
    drop(open_ends)
    shared = keys.groupBy("key").agg(F.min("k").alias("lo"), F.max("k").alias("hi")).filter("lo <> hi").select("key")
    shared = settle(shared, "line-shared-variants")
    met = may_be_in(keys, "key", bitmap(shared, "key")).join(shared, "key").select("k", "key", "kind").join(words.select("k", "k2", "at"), "k")
    met = settle(met, "line-met")
    drop(keys, shared)
    of = lambda kind: F.min(F.when(F.col("kind") == kind, F.struct("at", "k", "k2"))).alias(f"e{kind}")
    first = met.groupBy("key").agg(of(SAME), of(LONGER), of(SHORTER))
    other = F.when(F.col("kind") == SAME, F.col(f"e{SAME}")).when(F.col("kind") == LONGER, F.col(f"e{SHORTER}")).otherwise(F.col(f"e{LONGER}"))
    pairs = met.join(first, "key").select("k", "k2", "at", other.alias("o")).filter(F.col("o.at") < F.col("at"))
    pairs = settle(pairs.select("k", "k2", F.col("o.k").alias("ok"), F.col("o.k2").alias("ok2")).distinct(), "line-pairs")
    drop(met)
    a, b = words.select("k", "k2", "words"), words.select(F.col("k").alias("ok"), F.col("k2").alias("ok2"), F.col("words").alias("other"))
    a, b = may_be_in(a, "k", bitmap(pairs, "k")), may_be_in(b, "ok", bitmap(pairs, "ok"))
    near = pairs.join(a, ["k", "k2"]).join(b, ["ok", "ok2"]).filter(_one_edit(F.col("words"), F.col("other"))).select("k", "k2").distinct().withColumn("near", F.lit(True))

    near = settle(near, "line-near")
    drop(pairs, words)
    groups = settle(firsts.join(near, ["k", "k2"], "left").filter("copies > 1 or near").select("k", "k2", "at", "near"), "line-groups")
    drop(firsts, near)
    hit = may_be_in(lines.select("doc", "no", "k", "k2"), "k", bitmap(groups, "k")).join(groups, ["k", "k2"])
    gone = settle(hit.filter(F.col("near") | (F.col("at") < F.struct("doc", "no"))).select("doc", "no"), "line-places")
    drop(lines, groups)
    return gone


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20, near_words: int = 8, lines: str = "_lines", dropped: str = "_dropped") -> DataFrame:
    """All rows with their texts without the dropped lines.

    Adds the columns ``lines`` (lines before, 0 for null) and ``dropped`` (lines that went).
    """
    columns = [c for c in docs.columns if c.lower() not in (lines.lower(), dropped.lower())]
    doc, maybe = free(docs, "__ld_doc"), free(docs, "__ld_maybe")
    num, mask_ = free(docs, "__ld_n"), free(docs, "__ld_mask")
    kept = docs.select(*[F.col(f"`{c}`") for c in columns])
    # the id alone names a document, in fewer bytes, where no id has several texts
    texts = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text")).filter("id is not null").groupBy("id").agg((F.min("text") != F.max("text")).alias("several"))
    both = F.when(F.col(id_col).isNotNull(), F.struct(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text")))
    named = kept.withColumn(doc, F.col(id_col) if texts.filter("several").isEmpty() else both)
    places = dropped_lines(named, doc, text_col, min_chars, near_words)
    gone = places.groupBy("doc").agg(F.sort_array(F.collect_set("no")).alias("gone"))
    gone = settle(gone, "lines-gone")
    drop(places)
    # a byte for each line up to the last that goes: 1 if it goes
    run = lambda x, i: F.concat(F.repeat(F.lit("0"), x - F.when(i > 0, F.get("gone", i - 1)).otherwise(F.lit(-1)) - 1), F.lit("1"))
    mask = F.array_join(F.transform("gone", run), "").cast("binary")
    gone = gone.select(F.col("doc").alias(doc), F.size("gone").alias(num), mask.alias(mask_))
    told = marked(named, doc, bitmap(gone, doc), maybe)
    text = F.col(text_col)
    count = F.when(text.isNull(), F.lit(0)).otherwise(F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit(""))) + 1)
    own = [F.col(f"`{c}`") for c in columns]
    clean = told.filter(~F.col(maybe)).select(*own, count.alias(lines), F.lit(0).alias(dropped))
    rows = told.filter(maybe).join(gone, doc, "left")
    stays = lambda line, i: F.substring(mask_, i + 1, F.lit(1)) != F.lit(b"1")
    new = F.when(F.col(mask_).isNull() | text.isNull(), text).otherwise(F.array_join(F.filter(F.split(text, "\n"), stays), "\n"))
    rows = rows.select(*[new.alias(c) if c == text_col else x for c, x in zip(columns, own)], count.alias(lines), F.coalesce(num, F.lit(0)).alias(dropped))
    return clean.unionByName(rows)
