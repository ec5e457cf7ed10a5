"""Mixing sources to target weights by Pareto order sampling.

Each source is to supply a target number of words. Within it a document's expected
copies follow its weight, up to ``most``: the level at which the expected words meet the
target is found over the words of each weight. The whole part of the expected copies is
allocated for certain; the fraction is the inclusion probability of one more copy, so
documents of other weights have other probabilities. They are ranked by their random odds
u / (1 - u) divided by their inclusion odds p / (1 - p), and the first ones are taken
until their words meet what is left of the target (Rosen's order sampling, with the fixed
size counted in words). The document at the limit is replaced by the one whose words fit
the rest best.

The order within a source is never sorted as a whole: ranks fall into ``buckets``
ranges, whose words are summed first, and only the range in which the target is met is
ordered. So a source with a third of all rows is dealt over all tasks.

Only DataFrame functions are used. Random numbers come from a hash of the id, the size
and the seed, so reruns agree. Nulls: a null text has size 0; a null source is a source
of its own, last in order; a null id has a number by its size. Texts without words are
never taken. Repeated rows are documents of their own with the same number; all are
taken alike but where the target is met among them. An empty table gives no rows. Columns
of other names are not looked at. The table of sources is ordered in one task: it has one
row a source, not a document.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, bitmap, may_be_in, settle


def words(text: Column | str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def uniform(key: Column | str, seed: int) -> Column:
    """In (0, 1), from 52 bits of a digest; any SQL engine can compute it."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col(key).cast("string") if isinstance(key, str) else key.cast("string"), F.lit("null"))))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def targets(sizes: DataFrame, weights: tuple[int, ...] = (3, 1, 2), budget: tuple[int, int] = (3, 2), most: int = 2) -> DataFrame:
    """Targets of ``sizes(source, source_size)``: (source, source_size, target).

    The budget (as a fraction of all sizes) is shared by weight; what goes beyond
    ``most`` times a source's size is shared among the others by weight until no
    target is above. That is one sweep in order of size over weight: a source is at
    its limit if the limit is below its share of what those before it have left.
    """
    turn = W.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), (F.pmod(F.row_number().over(turn) - 1, F.lit(len(weights))) + 1).cast("int"))
    s = sizes.select("source", "source_size", w.cast("long").alias("w"), (F.col("source_size") * most).alias("limit"))
    ratio = W.orderBy((F.col("limit") / F.col("w")).asc(), F.col("source").asc_nulls_last())
    before, rest, all_rows = ratio.rowsBetween(W.unboundedPreceding, -1), ratio.rowsBetween(0, W.unboundedFollowing), ratio.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    up, down = budget
    s = s.select("*", F.coalesce(F.sum("limit").over(before), F.lit(0)).alias("taken"), F.sum("w").over(rest).alias("w_left"), (F.sum("source_size").over(all_rows) * up).alias("total"), F.row_number().over(ratio).alias("k"))
    # the share per unit of weight, times `down`, if this source and all after it are below their limits
    share = (F.col("total") - F.col("taken") * down).cast("double") / (F.col("w_left") * down).cast("double")
    full = F.col("limit").cast("double") <= share * F.col("w")
    level = F.max(F.when(~full, F.struct((-F.col("k")).alias("k"), share.alias("level")))).over(W.partitionBy())
    target = F.when(level.isNull() | full, F.col("limit").cast("double")).otherwise(F.col("w") * level["level"])
    return s.select("source", "source_size", target.alias("target"))


#: Weights are whole numbers from 1 to this.
HEAVIEST = 64


def bits(size: Column) -> Column:
    """How many binary digits the size has: twice as long a document weighs one more."""
    return F.length(F.bin(size)).cast("long")


def levels(words_of: DataFrame, most: int) -> DataFrame:
    """Expected copies of ``words_of(source, weight, words, target)``: (source, weight, expected).

    They are ``most`` for the heaviest and proportional to the weight below, so that the
    words expected of a source sum to its target. One sweep from the heaviest weight: a
    weight is at the limit if its share of what those before it have left is not below.
    """
    down = W.partitionBy("source").orderBy(F.desc("weight"))
    before, rest, every = down.rowsBetween(W.unboundedPreceding, -1), down.rowsBetween(0, W.unboundedFollowing), down.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    s = words_of.select("*", (F.coalesce(F.sum("words").over(before), F.lit(0)) * most).alias("used"), F.sum(F.col("words") * F.col("weight")).over(rest).alias("heavy"))
    share = (F.col("target") - F.col("used").cast("double")) / F.col("heavy").cast("double")
    full = F.lit(float(most)) <= share * F.col("weight")
    level = F.max(F.when(~full, F.struct("weight", share.alias("level")))).over(every)
    expected = F.when(level.isNull() | full, F.lit(float(most))).otherwise(level["level"] * F.col("weight"))
    return s.select("source", "weight", F.greatest(expected, F.lit(0.0)).alias("expected"))


def _rows(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: int, weight: Callable[[Column], Column], keep: bool = False) -> DataFrame:
    """(id, source, size, weight, u) of every row, and with ``keep`` the row itself."""
    row = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if keep else []
    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), words(F.col(text_col)).alias("size"), *row)
    own = F.least(F.greatest(weight(F.col("size")), F.lit(1)), F.lit(HEAVIEST)).cast("long")
    name = F.concat_ws(":", F.coalesce(F.col("id").cast("string"), F.lit("null")), F.col("size").cast("string"))
    return rows.select("*", own.alias("weight"), uniform(name, seed).alias("u"))


def _same(column: str, other: str) -> Column:
    return F.col(column).eqNullSafe(F.col(other))


class Mix:
    """What a mix takes: tables of a few rows a source, and the rows at the edges of the ranking."""

    def __init__(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (3, 1, 2), budget: tuple[int, int] = (3, 2), most: int = 2, seed: int = 1, buckets: int = 4096, weight: Callable[[Column], Column] = bits):
        self.docs, self.columns, self.own, self.buckets = docs, (id_col, text_col, source_col), (seed, weight), buckets
        self.rows = settle(_rows(docs, *self.columns, *self.own), "mix-sizes")
        self.goal = settle(targets(self.rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, budget, most), "mix-targets")
        self.plan = self._copies(most)
        d = self._ranked(self.rows)
        # buckets follow the ranking, so all of those before the one where the target is met are taken
        sums = d.filter("open").groupBy("source", "bucket").agg(F.sum("size").alias("n"), F.first("left").alias("left"))
        so_far = W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
        sums = settle(sums.withColumn("before", F.coalesce(F.sum("n").over(so_far), F.lit(0))), "mix-buckets")
        self.edge = sums.filter((F.col("before") <= F.col("left")) & (F.col("before") + F.col("n") > F.col("left"))).select(F.col("source").alias("es"), F.col("bucket").alias("edge"), "before")
        self.edge = settle(self.edge, "mix-edges")
        order = W.partitionBy("source").orderBy("odds", "id", "size").rowsBetween(W.unboundedPreceding, W.currentRow)
        at_edge = self._placed(self.rows).filter("open and bucket = edge").withColumn("upto", F.col("before") + F.sum("size").over(order))
        at_edge = settle(at_edge.withColumn("taken", F.col("upto") <= F.col("left")).drop("upto"), "mix-at-edges")
        # of those not taken, the one whose words come nearest to what is missing
        got = sums.join(self.edge, _same("source", "es"), "left").filter(F.col("edge").isNull() | (F.col("bucket") < F.col("edge"))).select("source", F.col("n").alias("got"))
        got = got.unionByName(at_edge.filter("taken").select("source", F.col("size").alias("got"))).groupBy(F.col("source").alias("s")).agg(F.sum("got").alias("got"))
        rest = self._placed(self.rows).filter("open and bucket > edge").withColumn("taken", F.lit(False)).unionByName(at_edge.filter("not taken"))
        rest = rest.join(got, _same("source", "s"), "left").withColumn("gap", F.col("left") - F.coalesce("got", F.lit(0)))
        miss = F.abs(F.col("gap") - F.col("size"))
        rest = rest.filter(miss < F.col("gap")).groupBy("source", "odds", "id", "size").agg(F.min(miss).alias("miss"), F.count(F.lit(1)).alias("n")).filter("n = 1")
        x = rest.groupBy("source").agg(F.min(F.struct("miss", "odds", "id", "size")).alias("x"))
        self.extra = settle(x.select(F.col("source").alias("xs"), F.col("x.odds").alias("x_odds"), F.col("x.id").alias("x_id"), F.col("x.size").alias("x_size")), "mix-extra")
        self.at_edge = settle(self._with_extra(at_edge), "mix-at-edges")

    def _copies(self, most: int) -> DataFrame:
        """(s, w, whole, p, left): copies for certain and the chance of one more, by source and weight, and the words left to those."""
        sums = self.rows.filter("size > 0").groupBy("source", "weight").agg(F.sum("size").alias("words"))
        sums = sums.join(self.goal.select(F.col("source").alias("s"), "target"), _same("source", "s")).select("source", "weight", "words", "target")
        copies = levels(sums, most).select(F.col("source").alias("s"), F.col("weight").alias("w"), F.floor("expected").alias("whole"), (F.col("expected") - F.floor("expected")).alias("p"))
        sums = sums.join(copies, _same("source", "s") & (F.col("weight") == F.col("w")))
        left = sums.groupBy("source").agg((F.first("target") - F.sum(F.col("whole") * F.col("words"))).alias("left")).select(F.col("source").alias("ls"), "left")
        return settle(sums.join(left, _same("source", "ls")).select("s", "w", "whole", "p", "left"), "mix-plan")

    def _ranked(self, rows: DataFrame) -> DataFrame:
        """``rows`` with their copies for certain and, if one more is open to chance, their odds and bucket."""
        d = rows.join(self.plan, _same("source", "s") & (F.col("weight") == F.col("w")) & (F.col("size") > 0), "left").drop("s", "w", "weight")
        d = d.withColumn("open", F.coalesce((F.col("p") > 0) & (F.col("left") >= 0.5), F.lit(False)))
        odds = (F.col("u") / (1 - F.col("u"))) / (F.col("p") / (1 - F.col("p")))
        return d.withColumn("odds", F.when(F.col("open"), odds)).withColumn("bucket", F.floor((1 - 1 / (1 + F.col("odds"))) * self.buckets))

    def _placed(self, rows: DataFrame) -> DataFrame:
        return self._ranked(rows).join(self.edge, _same("source", "es"), "left").drop("es")

    def _with_extra(self, d: DataFrame) -> DataFrame:
        """``d`` with ``copies``, of rows for which ``taken`` is known."""
        d = d.join(self.extra, _same("source", "xs"), "left")
        added = F.coalesce(F.col("open") & ~F.col("taken") & (F.col("odds") == F.col("x_odds")) & _same("id", "x_id") & (F.col("size") == F.col("x_size")), F.lit(False))
        more = F.when(F.col("taken") | added, F.lit(1)).otherwise(F.lit(0))
        return d.withColumn("copies", F.when(F.col("size") > 0, F.coalesce("whole", F.lit(0)) + more).otherwise(F.lit(0)).cast("long")).drop("xs", "x_odds", "x_id", "x_size")

    def _settled(self, rows: DataFrame) -> DataFrame:
        """Rows that are not at an edge, with ``copies``."""
        d = self._placed(rows).filter(F.coalesce(~F.col("open") | (F.col("bucket") != F.col("edge")), F.lit(True)))
        return self._with_extra(d.withColumn("taken", F.col("open") & F.coalesce(F.col("bucket") < F.col("edge"), F.lit(True))))

    def copies(self) -> DataFrame:
        """(id, source, size, source_size, target, copies) of every row; copies >= 0."""
        names = ["id", "source", "size", "copies"]
        d = self._settled(self.rows).select(*names).unionByName(self.at_edge.select(*names))
        goal = self.goal.withColumnRenamed("source", "gs")
        return d.join(goal, _same("source", "gs")).select("id", "source", "size", "source_size", "target", "copies")

    def taken(self) -> DataFrame:
        """Every row as often as the mix takes it; only rows at the edges are shuffled.

        ``id`` must tell rows apart that are not equal. Where the mix takes some of equal
        rows, one of them is repeated instead.
        """
        wide = _rows(self.docs, *self.columns, *self.own, keep=True)
        key = ["id", "source", "size"]
        edge = self.at_edge.groupBy(*[F.col(c).alias(f"e_{c}") for c in key]).agg(F.min("copies").alias("each"), (F.sum("copies") - F.count(F.lit(1)) * F.min("copies")).alias("more"))
        near = _rows(may_be_in(self.docs, self.columns[0], bitmap(self.at_edge, "id")), *self.columns, *self.own, keep=True)
        at = self._placed(near).filter("open and bucket = edge").join(edge, _same("id", "e_id") & _same("source", "e_source") & (F.col("size") == F.col("e_size")))
        out = self._settled(wide).select("row", "copies").unionByName(at.select("row", F.col("each").alias("copies")))
        out = out.unionByName(at.filter("more > 0").dropDuplicates(key).select("row", F.col("more").alias("copies")))
        return out.filter("copies > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """(id, source, size, source_size, target, copies) of every row; copies >= 0.

    ``weights`` are those of the sources in order; ``weight`` gives a document's own from
    its size, held within 1 to ``HEAVIEST``; see ``Mix`` for the other options.
    """
    return Mix(docs, id_col, text_col, source_col, **options).copies()
