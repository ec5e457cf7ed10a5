"""Sharding, packing, mixing, token counts, top-k: laws and brute force."""

import collections
import hashlib
import math
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fiberlake.llm import bpe, mixing, packing, ring, token_counts, topk
from fiberlake.llm.common import rank_within, settle

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_rank_within(spark):
    df = spark.range(3000).select(F.when(F.col("id") < 2500, 1).otherwise(F.col("id") % 5).alias("k"), "id")
    got = collections.defaultdict(list)
    for r in rank_within(df, "k", ["id"], "r", per=100).collect():
        got[r.k].append(r.r)
    assert all(sorted(v) == list(range(len(v))) for v in got.values()) and sum(map(len, got.values())) == 3000


def test_rank_within_of_equal_rows(spark):
    """Copies beyond a part, nulls too; ranks of a key have no gap and copies stand together."""
    rows = [("a", 1), ("a", None), ("b", 2)]
    df = spark.createDataFrame(rows, "k string, id bigint").withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(9000)))).drop("n")
    df = df.unionByName(spark.range(100, 700).select(F.lit("a").alias("k"), "id"))
    got = collections.defaultdict(list)
    for r in rank_within(df, "k", ["id"], "r", per=100).collect():
        got[r.k].append((r.r, r.id))
    assert {k: sorted(r for r, _ in v) for k, v in got.items()} == {"a": list(range(18_600)), "b": list(range(9000))}
    for id_ in (1, None):
        at = sorted(r for r, i in got["a"] if i == id_)
        assert at == list(range(at[0], at[0] + 9000))
    assert rank_within(df.limit(0), "k", ["id"], "r").count() == 0


def test_ring_law_rows(spark, odd_docs, no_docs):
    df = spark.range(1001).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), "id").alias("text"))
    rows = ring.assign(df, shards=24).collect()
    c = collections.Counter(r.shard for r in rows)
    assert len(rows) == 1001 and max(c.values()) - min(c.values()) <= 1 and len(c) == 24
    for s in c:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(c[s]))
    assert all(r.size == len(f"t{r.doc_id}") + 8 and r.text_crc32 == zlib.crc32(f"t{r.doc_id}".encode()) for r in rows)
    odd = ring.assign(odd_docs, shards=3).collect()
    assert len(odd) == odd_docs.count() and {r.size for r in odd if r.doc_id in (4, 5)} == {8}
    assert ring.assign(no_docs).count() == 0


def test_ring_walk_is_bounded_and_sends_overflow_on():
    owners, counts, cap = [0, 1, 0, 2], [10, 1, 0, 1], [4, 4, 4]
    out = ring.walk(owners, counts, cap)
    got = collections.Counter()
    for _, _, n, shard, _ in out:
        got[shard] += n
    assert dict(got) == {0: 4, 1: 4, 2: 4}
    # keys within capacity stay at their own shard
    assert (1, 0, 1, 1, 0) in out and (3, 0, 1, 2, 0) in out


def test_more_slack_moves_fewer_keys(spark):
    df = spark.range(2000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    own = {r.doc_id: r.shard for r in ring.assign(df, shards=8, slack=5.0).collect()}
    moved = [sum(own[r.doc_id] != r.shard for r in ring.assign(df, shards=8, slack=s).collect()) for s in (0.0, 0.25)]
    assert moved[1] <= moved[0]


# packing ---------------------------------------------------------------------------
def check_plan(counts, capacity):
    seqs = collections.defaultdict(list)
    ranks = collections.defaultdict(list)
    for x, first, n, run, seq, off in packing.plan(dict(counts), capacity):
        for j in range(n):
            seqs[seq + j // run].append((off + (j % run) * x, x))
            ranks[x].append(first + j)
    for x, c in counts.items():
        assert sorted(ranks[x]) == list(range(c))
    for v in seqs.values():
        at = 0
        for o, x in sorted(v):
            assert o == at
            at += x
        assert at <= capacity
    return seqs


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.integers(1, 60), st.integers(0, 40), max_size=25))
def test_plan_places_all(counts):
    seqs = check_plan(counts, 60)
    total = sum(x * c for x, c in counts.items())
    assert len(seqs) >= -(-total // 60)
    large = [(x, n) for v in seqs.values() for x, n in [(sum(3 * y > 60 for _, y in v), len(v))]]
    assert all(x <= 2 for x, _ in large)


def test_plan_is_near_the_bound():
    rng = np.random.default_rng(0)
    counts = collections.Counter(np.minimum(2048, rng.lognormal(6, 1, 20_000).astype(int) + 1).tolist())
    n = len(check_plan(counts, 2048))
    assert n <= 1.01 * sum(x * c for x, c in counts.items()) / 2048 + 1


TEXT = st.text(alphabet=st.sampled_from(list("abcXYZ 'éÉß.,;:!?()\"-1²Σσ́İ\n\t<|>日ー😀_")), max_size=60)


@settings(max_examples=300, deadline=None)
@given(st.lists(TEXT, min_size=1, max_size=8))
def test_word_encoder_equals_tokenizer(texts):
    import pyarrow as pa
    from tokenizers import Tokenizer

    path = bpe.default_path()
    if not hasattr(test_word_encoder_equals_tokenizer, "tok"):
        test_word_encoder_equals_tokenizer.tok = Tokenizer.from_file(path)
    texts = [*texts, "it's We'LL don't <|endoftext|>x <|STARTOFTEXT|> İi ΑΣ ok", "naïve, café; (ÜBER) \"été\""]
    ids, b = bpe.encoder(path).encode(pa.array(texts, pa.string()))
    for i, t in enumerate(texts):
        assert ids[b[i] : b[i + 1]].tolist() == test_word_encoder_equals_tokenizer.tok.encode(t, add_special_tokens=False).ids, t


def test_encoder_forgets_when_full():
    import pyarrow as pa

    e = bpe.WordEncoder(bpe.default_path(), most=5)
    for t in ("a b c d", "e f g", "a b c d e f g h i"):
        ids, _ = e.encode(pa.array([t]))
        assert ids.tolist() == e.tokenizer.encode(t, add_special_tokens=False).ids


def test_pack_and_assemble(spark, odd_docs, no_docs):
    docs = odd_docs.filter("doc_id is not null").dropDuplicates(["doc_id"]).select("doc_id", "text")
    placed = packing.pack(docs, capacity=64)
    tok = bpe.encoder(bpe.default_path()).tokenizer
    want = {r.doc_id: tok.encode(r.text or "", add_special_tokens=False).ids + [0] for r in docs.collect()}
    seq = {r.sequence_id: r.ids for r in packing.assemble(docs, placed, capacity=64).collect()}
    got = collections.defaultdict(int)
    for r in placed.collect():
        ids = want[r.doc_id][r.start : r.start + r.length]
        assert seq[r.sequence_id][r.offset : r.offset + r.length] == ids and r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        got[r.doc_id] += r.length
    assert got == {k: len(v) for k, v in want.items()} and max(map(len, seq.values())) <= 64
    assert packing.pack(odd_docs).count() >= odd_docs.count() and packing.pack(no_docs).count() == 0


# mixing ----------------------------------------------------------------------------
def brute_targets(sizes, weights=(3, 1, 2)):
    order = sorted(sizes, key=lambda s: (s is None, s))
    w = {s: weights[i % 3] for i, s in enumerate(order)}
    total = Fraction(3, 2) * sum(sizes.values())
    full, target = set(), {}
    while True:
        rest = total - sum(2 * sizes[s] for s in full)
        left = sum(w[s] for s in order if s not in full)
        target = {s: Fraction(2 * sizes[s]) if s in full else rest * w[s] / left for s in order}
        over = {s for s in order if s not in full and target[s] > 2 * sizes[s]}
        if not over:
            return target
        full |= over


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 1000, None: 50}, {"a": 5}, {"a": 7, "b": 7, "c": 7, "d": 7, "é": 1, "Z": 90}])
def test_targets(spark, sizes):
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size bigint")
    got = {r.source: r.target for r in mixing.targets(df).collect()}
    assert got == pytest.approx({k: float(v) for k, v in brute_targets(sizes).items()})


def brute_mix(rows, most=2):
    """Copies of (id, size, source) rows, in their order: levels, Pareto ranks and the document that fits best."""
    out = [0] * len(rows)
    goal = brute_targets({s: sum(r[1] for r in rows if r[2] == s) for s in {r[2] for r in rows}})
    for source, target in goal.items():
        mine = [i for i, r in enumerate(rows) if r[2] == source and r[1]]
        heavy, words = {i: min(64, rows[i][1].bit_length()) for i in mine}, {}
        for i in mine:
            words[heavy[i]] = words.get(heavy[i], 0) + rows[i][1]
        full: set = set()
        while len(full) < len(words):
            level = (target - sum(most * words[w] for w in full)) / sum(w * n for w, n in words.items() if w not in full)
            over = {w for w in words if w not in full and level * w >= most}
            if not over:
                break
            full |= over
        expected = {w: Fraction(most) if w in full else level * w for w in words}
        left, ranks = float(target - sum(math.floor(expected[w]) * n for w, n in words.items())), []
        for i in mine:
            out[i], p = math.floor(expected[heavy[i]]), float(expected[heavy[i]] % 1)
            u = (int(hashlib.md5(f"1:{rows[i][0] if rows[i][0] is not None else 'null'}:{rows[i][1]}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
            if p and left >= 0.5:
                ranks.append((u / (1 - u) / (p / (1 - p)), rows[i][0], rows[i][1], i))
        got, upto = 0, 0
        rest = []
        for r in sorted(ranks):
            upto += r[2]
            if upto <= left:
                out[r[3]] += 1
                got = upto
            else:
                rest.append((abs(left - got - r[2]), *r))
        fit = min(((m, *r) for m, *r in rest if m < left - got), default=None)
        if fit:
            out[fit[-1]] += 1
    return out


def test_mix(spark, odd_docs, no_docs):
    rng = np.random.default_rng(1)
    rows = [(i, " ".join(["w"] * int(n)), "abc"[int(s)]) for i, (n, s) in enumerate(zip(rng.lognormal(3, 1.5, 600), rng.integers(0, 3, 600)))]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    got = mixing.mix(df).collect()
    assert sorted(got) == sorted(mixing.mix(df).collect())
    want = brute_mix([(i, len(t.split()), s) for i, t, s in rows])
    assert {r.id: r.copies for r in got} == dict(enumerate(want))
    assert len({r.copies for r in got if r.source == "b" and r["size"]}) > 1
    for s in "abc":
        mine = [r for r in got if r.source == s]
        assert abs(sum(r.size * r.copies for r in mine) - mine[0].target) <= max(3, 0.01 * mine[0].target)
        assert max(r.copies for r in mine) <= 2
    odd = mixing.mix(odd_docs).collect()
    assert len(odd) == odd_docs.count() and all(r.copies == 0 for r in odd if r["size"] == 0)
    assert all(len(WORD.findall(t)) == next(r["size"] for r in odd if r.id == i) for i, t in ((7, odd_docs.filter("doc_id = 7").first().text), (11, odd_docs.filter("doc_id = 11").first().text)))
    assert mixing.mix(no_docs).count() == 0


def test_mix_equal_weights_and_repeated_rows(spark):
    rows = [(7, "a b c", "x")] * 90 + [(None, "a b", None)] * 30 + [(8, "d", "x")] * 50
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    got = mixing.mix(df, weight=lambda size: F.lit(1)).collect()
    assert len(got) == len(rows)
    for s in ("x", None):
        mine = [r for r in got if r.source == s]
        assert abs(sum(r.size * r.copies for r in mine) - mine[0].target) <= 3 and max(r.copies for r in mine) <= 2


def test_mix_plans_have_no_python(spark, odd_docs, monkeypatch):
    plans = []
    monkeypatch.setattr(mixing, "settle", lambda df, name: plans.append(df._jdf.queryExecution().toString()) or settle(df, name))
    plans.append(mixing.mix(odd_docs)._jdf.queryExecution().toString())
    assert len(plans) > 4 and not any(re.search("Python|Pandas|InArrow", p) for p in plans)


# token counts ------------------------------------------------------------------------
def test_rollups(spark, odd_docs, no_docs, tmp_path):
    rows = token_counts.count_tokens(odd_docs, ["doc_id", "source", "lang"]).withColumn("old_tokens", F.lit(7).cast("bigint")).cache()
    tok = bpe.encoder(bpe.default_path()).tokenizer
    want = collections.Counter()
    for r in odd_docs.collect():
        want[r.source, r.lang] += len(tok.encode(r.text or "", add_special_tokens=False).ids)
    store, v = str(tmp_path / "s"), F.lit("v1")
    ins = token_counts.changes(rows.withColumn("tokens", F.col("old_tokens")).drop("old_tokens"), F.lit("insert"), v)
    for _ in range(2):
        token_counts.commit(ins, store, "a")
    token_counts.commit(token_counts.changes(rows, F.lit("revise"), v), store, "b")
    assert {(r.source, r.lang): r.tokens for r in token_counts.totals(spark, store).collect()} == dict(want)
    token_counts.compact(spark, store, str(tmp_path / "c"))
    assert sorted(map(str, token_counts.totals(spark, str(tmp_path / "c")).collect())) == sorted(map(str, token_counts.totals(spark, store).collect()))
    token_counts.commit(token_counts.changes(rows.drop("old_tokens"), F.lit("delete"), v), store, "d")
    assert token_counts.totals(spark, store).count() == 0
    assert token_counts.count_tokens(no_docs, ["doc_id"]).count() == 0


# top-k -------------------------------------------------------------------------------
def brute_top(vecs, k):
    """For (id, integers) rows, each a candidate of all but itself; scores end where longs do."""
    out = []
    for i, (q, x) in enumerate(vecs):
        if q % 20 == 0:
            score = lambda y: max(-(1 << 63), min((1 << 63) - 1, sum(a * b for a, b in zip(x, y))))
            s = sorted((-score(y), c) for j, (c, y) in enumerate(vecs) if i != j)[:k]
            out += [(q, n + 1, c, -v) for n, (v, c) in enumerate(s)]
    return sorted(out)


@pytest.mark.parametrize("scale,n,k", [(0.3, 300, 20), (1000.0, 90, 7), (0.3, 10, 20), (5e6, 60, 4), (1e8, 45, 5), (1e307, 25, 3)])
def test_top_k(spark, scale, n, k):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(n, 8)) * scale
    x[n // 3 : n // 2] = x[n // 3]  # many equal vectors: ties
    ids = [0 if i == 3 else 7 if i == 4 else i for i in range(n)]  # repeated ids
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in zip(ids, x)], "vec_id bigint, embedding array<double>")
    got = topk.top_k(df, F.col("id") % 20 == 0, k=k, query_block=4, block=64)
    ints = [[math.floor(64 * Fraction(float(v))) for v in r] for r in x]
    assert sorted(map(tuple, got.collect())) == brute_top(list(zip(ids, ints)), k)


def test_top_k_of_large_components(spark):
    df = spark.createDataFrame([(0, [5e6, 0.0], "x", 1), (1, [1.0, 0.0], "y", 2)], "vec_id bigint, embedding array<float>, row string, id int")
    assert [tuple(r) for r in topk.top_k(df, F.col("id") % 20 == 0).collect()] == [(0, 1, 1, 20_480_000_000)]


def test_top_k_odd_rows(spark):
    rows = [(0, [1.0, 2.0]), (20, [0.5]), (None, [1.0]), (3, None), (4, [None, 1.0]), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]), (7, []), (8, [1.0, 1.0, 1.0]), (8, [1.0, 1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = sorted(map(tuple, topk.top_k(df, F.col("id") % 20 == 0, k=2).collect()))
    assert got == [(0, 1, 8, 64 * 64 * 3), (0, 2, 8, 64 * 64 * 3), (20, 1, 0, 32 * 64), (20, 2, 8, 32 * 64)]
    assert topk.top_k(df.limit(0), F.col("id") % 20 == 0).count() == 0
