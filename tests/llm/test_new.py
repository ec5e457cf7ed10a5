"""Prefix trie, fill-in-middle, near vectors: plain definitions, laws and odd input; what rows of one id, clashing names and dying jobs do."""

import hashlib
import re
from zlib import crc32

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from fiberlake.llm import chat, crosspoly, fim, line_dedup, partenum, prefix_tree, queries, token_counts
from fiberlake.llm.common import table

TURNS = "conv_id bigint, turn bigint, role string, text string"


# prefix trie -------------------------------------------------------------------------
def plain_trie(convs: dict) -> set:
    """The nodes of conversations (lists of (role, text)), by looking at every start of each."""
    members: dict = {}
    for c, xs in convs.items():
        for d in range(len(xs) + 1):
            members.setdefault(tuple(xs[:d]), []).append(c)
    out = set()
    for p, ms in members.items():
        sub = [q for q in members if q[: len(p)] == p]
        kids = [q for q in sub if len(q) == len(p) + 1]
        leaves = [q for q in sub if not any(z[: len(q)] == q and len(z) > len(q) for z in sub)]
        saved = sum((len(members[q]) - 1) * (len(q[-1][1].encode()) if q else 0) for q in sub)
        ends = ",".join(str(c) for c in sorted(ms) if len(convs[c]) == len(p))
        out.add((min(ms), len(p), min(members[p[:-1]]) if p else None, len(ms), len(kids), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return out


def rebuilt(convs: dict) -> dict:
    out = {}
    for c, xs in convs.items():
        h = crc32(str(c).encode()) % 9
        out[c] = convs.get(c - c % 5, [])[:h] + xs[h:]
    return out


@pytest.mark.parametrize("span, keys", [(64, 50_000), (1, 3), (3, 7)])
def test_trie_of_any_segments_and_trees(spark, span, keys):
    rng = np.random.default_rng(3)
    convs = {c: [(("user", "assistant")[i % 2], "t" * int(rng.integers(1, 3)) + "é" * (c == 7)) for i in range(int(rng.integers(0, 12)))] for c in range(60)}
    convs |= {100: list(convs[20]), 101: list(convs[20]), 102: convs[20] + [("user", "more")] * 9, 103: [("user", "t")] * 40, 104: [("user", "t")] * 40}
    rows = [(c, i, r, t) for c, xs in convs.items() for i, (r, t) in enumerate(xs)]
    got = prefix_tree.trie(prefix_tree.ordered(prefix_tree.turn_ids(spark.createDataFrame(rows, TURNS))), span=span, keys=keys).collect()
    assert len(got) == len(plain_trie({c: x for c, x in convs.items() if x}))
    assert {tuple(r) for r in got} == plain_trie({c: x for c, x in convs.items() if x})


def test_grafted_conversations_of_odd_rows(spark):
    rows = [(c, t, "user" if t % 2 else None, None if t == 3 else f"x{t % 2}") for c in (0, 1, 2, 3, 4, 6, 11, 13, 15, 16, 18) for t in range(c % 4 + 2)]
    rows += [(16, None, "user", "no number"), (16, 1, "user", "x1"), (None, 0, "user", "no conversation"), (21, 0, "", "")]
    df = spark.createDataFrame(rows, TURNS).withColumns({c: F.lit("1") for c in ("conv", "id", "size", "_by", "key", "start", "node", "depth", "n", "final")})
    convs: dict = {}
    key = lambda r: (r[0], r[1] is not None, r[1] or 0, hashlib.md5(f"{len((r[2] or '').encode())}:{r[2] or ''}{r[3] or ''}".encode()).digest())
    for r in sorted((r for r in rows if r[0] is not None), key=key):
        convs.setdefault(r[0], []).append((r[2] or "", r[3] or ""))
    want = rebuilt(convs)
    assert any(not x for x in want.values())  # some have no turns
    got = prefix_tree.trie(prefix_tree.regrafted(prefix_tree.turn_ids(df))).collect()
    assert {tuple(r) for r in got} == plain_trie(want) and len(got) == len(plain_trie(want))
    assert prefix_tree.trie(prefix_tree.regrafted(prefix_tree.turn_ids(df.limit(0)))).count() == 0


def test_members_of_one_node_come_in_chunks(spark):
    df = spark.range(900).select(F.col("id").alias("conv"), F.lit(b"f" * 16).alias("final"))
    got = prefix_tree._ends(df, per=7).collect()
    assert [r.ends for r in got] == [hashlib.sha256(",".join(map(str, range(900))).encode()).hexdigest()]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 255), max_size=3), min_size=1, max_size=300), st.integers(0, 2))
def test_tree_layouts(convs, same):
    turn = lambda x: bytes(15 - same) + bytes([x]) + bytes(same)  # noqa: E731  one byte branches, after or before bytes that never do
    tree, want = prefix_tree.Tree(), {}
    for c, xs in enumerate(convs):
        tree.add(prefix_tree.ROOT + b"".join(map(turn, xs)), 0, b"".join((x + 1).to_bytes(8, "little") for x in xs), c, 1, c, 2)
        digest = prefix_tree.ROOT
        for d in range(len(xs) + 1):
            digest = prefix_tree.below(digest, turn(xs[d - 1])) if d else digest
            w = want.setdefault(digest, [d, c, 0, xs[d - 1] + 1 if d else 0, 0, 0])
            w[2], w[4], w[5] = w[2] + 1, w[4] + c, w[5] + 2
    got = {r[0]: [r[2], r[3], r[4], r[5], r[6], r[7]] for r in tree.nodes()}
    assert got == want


def test_a_tree_has_all_layouts():
    tree = prefix_tree.Tree()
    seen = set()
    for x in range(256):
        tree.add(prefix_tree.ROOT + bytes([x]) * 16, 0, bytes(8), x)
        seen.add((type(tree.root.kids).__name__, getattr(tree.root.kids, "most", 0)))
    assert seen == {("NoneType", 0), ("Listed", 4), ("Listed", 16), ("Indexed", 0), ("Direct", 0)}
    assert len(tree.root.path) == 16 and sum(1 for _ in tree.nodes()) == 257


# fill-in-middle -----------------------------------------------------------------------
def plain_fim(doc_id, text, seed=1):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    s = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(s[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    pre, mid, suf = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    if h[3] % 100 < 20:
        return n, "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}"
    return n, "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}"


def test_fim_of_odd_rows(spark, odd_docs, no_docs):
    more = spark.createDataFrame([(i, t) for i, t in enumerate(["a <P> b", "<", "<S", "né <M", "日本語abcé<" * 50, "\U0001f600" * 9, "abc"] * 12, 100)], "doc_id bigint, text string")
    df = odd_docs.select("doc_id", "text").unionByName(more)
    rows = [(r.doc_id, r.text) for r in df.collect()]
    out = fim.restore(fim.transform(df.withColumns({c: F.lit("1") for c in ("n", "form", "output", "restored", "h1", "prefix_chars")})))
    got = [(r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, bytes(r.output), bytes(r.restored)) for r in out.collect()]
    want = [(i, *(w := plain_fim(i, t))[:4], w[4].encode(), (t or "").encode()) for i, t in rows]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}
    assert fim.restore(fim.transform(no_docs)).count() == 0


def test_fim_of_whole_documents(spark, sf):
    rows = {r.doc_id: r for r in queries.op12_fim(spark, sf).collect()}
    docs = table(spark, sf, "documents").select("doc_id", "text").collect()
    assert len(rows) == len(docs)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    for d in docs:
        n, form, pre, mid, output = plain_fim(d.doc_id, d.text)
        r = rows[d.doc_id]
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output_sha256, r.restored_sha256) == (n, form, pre, mid, sha(output), sha(d.text or ""))


def test_bytes_that_are_no_text_come_back(spark):
    raw = [bytes([b]) * k + b"ab\xe2\x82" for b in (0x80, 0xC3, 0xF0, 0xFF) for k in (1, 5)]
    df = spark.createDataFrame([(i, bytearray(r)) for i, r in enumerate(raw)], "doc_id bigint, raw binary").select("doc_id", F.col("raw").cast("string").alias("text"))
    got = {r.doc_id: bytes(r.restored) for r in fim.restore(fim.transform(df, rate=100)).collect()}
    assert got == dict(enumerate(raw))


@settings(max_examples=100, deadline=None)
@given(st.text(max_size=200), st.integers(1, 20))
def test_exceptions_turn_cuts_into_each_other(text, block):
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    index = fim.Exceptions(raw, block)
    bytes_ = np.array([len(text[:k].encode("utf-8", "surrogatepass")) for k in range(len(text) + 1)])
    assert (index.chars(bytes_) == np.arange(len(text) + 1)).all() and (index.bytes(np.arange(len(text) + 1)) == bytes_).all()
    assert len(index.at) == sum(ord(c) > 127 for c in text)
    assert fim.count_units(raw, np.array([0, len(raw)]), block)[1] == len(re.findall(r"[A-Za-z]+|[^A-Za-z]", text))


# near vectors -------------------------------------------------------------------------
VECS = "vec_id bigint, embedding array<float>, label string"


def plain_near(rows, cosine=0.98):
    """(vec_id, n_links, component_id) of rows (id, vector, label) by comparing all."""
    ok = [x is not None and lab is not None and all(e is not None and np.isfinite(e) for e in x) and any(x) for _, x, lab in rows]
    dim = max((len(x) for (_, x, _), o in zip(rows, ok) if o), default=1)
    m = np.zeros((len(rows), dim))
    for i, (_, x, _) in enumerate(rows):
        if ok[i]:
            m[i, : len(x)] = np.array(x, np.float64) / max(abs(e) for e in x)
    size = np.sqrt((m * m).sum(1))
    m /= np.where(size > 0, size, 1)[:, None]
    label = np.array([lab if o else f"none{i}" for i, ((_, _, lab), o) in enumerate(zip(rows, ok))], object)
    near = (m @ m.T >= cosine) & (label[:, None] == label[None, :])
    np.fill_diagonal(near, False)
    comp, out = list(range(len(rows))), []
    changed = True
    while changed:
        changed = False
        for a, b in zip(*np.nonzero(near)):
            if comp[b] < comp[a]:
                comp[a], changed = comp[b], True
    for i, (vec, _, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if comp[j] == comp[i] and rows[j][0] is not None]
        out.append((vec, int(near[i].sum()), min(ids) if ids else None))
    return sorted(out, key=repr)


def clustered(n=600, dim=64, seed=0):
    """A large family, chains at about the bound, pairs, copies, and vectors of their own, of two labels."""
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(40, dim))
    rows = []
    for i in range(n):
        family = 0 if i % 3 == 0 else int(rng.integers(1, 40))
        v = base[family] / np.linalg.norm(base[family]) + rng.normal(size=dim) * (0.012 if family == 0 else 0.024) if i % 5 else rng.normal(size=dim)
        rows.append((i, [float(np.float32(e)) for e in v], "a" if i % 7 else "b"))
    return rows


def found(spark, rows, schema=VECS, **how):
    df = spark.createDataFrame(rows, schema).repartition(5)
    got = crosspoly.near_vectors(df, **how).collect()
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)
    return sorted(((r.vec_id, r.n_links, r.component_id) for r in got), key=repr)


@pytest.mark.parametrize("block", [1024, 16])
def test_near_vectors_are_those_of_all_pairs(spark, block):
    rows = clustered()
    rows += [(1000 + i, rows[3][1], "a") for i in range(40)] + [(2000, rows[3][1], "b")]
    got, want = found(spark, rows, block=block), plain_near(rows)
    assert sum(w[1] for w in want) > 5000
    assert sum(g[1] for g in got) >= 0.999 * sum(w[1] for w in want)  # a hash may miss
    assert all(g[1] <= w[1] for g, w in zip(got, want))
    assert sum(g == w for g, w in zip(got, want)) >= 0.99 * len(want)


def test_near_vectors_of_odd_rows(spark):
    x = [1.0, 2.0, 3.0]
    odd = [None, [], [0.0, 0.0], [1.0, None], [float("nan"), 1.0], [float("inf"), 1.0]]
    rows = [(i, v, "a") for i, v in enumerate(odd)] + [(10, x, "a"), (10, x, "a"), (11, [2.0, 4.0, 6.0], "a"), (None, x, "a"), (12, x, None), (13, x, "b"), (14, [-1.0, -2.0, -3.0], "a")]
    rows += [(20, [5.0], "c"), (21, [7.0], "c"), (22, [-5.0], "c"), (None, None, None), (30, [1e-30, 2e-30], "d"), (31, [1e30, 2e30], "d")]
    assert found(spark, rows) == plain_near(rows)
    assert found(spark, [], VECS) == []
    clash = spark.createDataFrame(rows, VECS).withColumns({c: F.lit("1") for c in ("row", "id", "node", "w", "bucket", "h", "v", "comp", "sketch", "keys")})
    assert sorted(((r.vec_id, r.n_links, r.component_id) for r in crosspoly.near_vectors(clash).collect()), key=repr) == plain_near(rows)


def test_recall_at_the_bound(spark):
    rng, rows = np.random.default_rng(5), []
    for i in range(400):
        a, r = rng.normal(size=64), rng.normal(size=64)
        a /= np.linalg.norm(a)
        r -= (r @ a) * a
        r /= np.linalg.norm(r)
        rows += [(2 * i, a.tolist(), "a"), (2 * i + 1, (0.981 * a + np.sqrt(1 - 0.981**2) * r).tolist(), "a")]
    got = found(spark, rows, "vec_id bigint, embedding array<double>, label string")
    assert sum(g[1] for g in got) >= 0.99 * 800


def test_hadamard_keeps_lengths_and_angles():
    x = np.random.default_rng(1).normal(size=(20, 32))
    y = crosspoly.hadamard(x) / np.sqrt(32)
    assert np.allclose(x @ x.T, y @ y.T) and np.allclose(crosspoly.hadamard(y) / np.sqrt(32), x)


# repeated ids, clashing names, histories, commits -----------------------------------------
NAMES = ("__bucket", "__bits", "__maybe", "__ld_doc", "__ld_n", "__ld_mask", "__ld_maybe", "_lines", "_dropped", "__near_key", "__near_maybe", "__mix_key", "row", "key", "copies", "es", "ids")


def test_lines_of_rows_that_share_an_id(spark):
    rows = [(1, "first line here\nshared boilerplate line"), (3, "alpha own line\nshared boilerplate line"), (3, "beta own line\nunique precious line"), (3, "beta own line\nunique precious line"), (None, "shared boilerplate line")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({c: F.lit(c) for c in NAMES})
    out = line_dedup.dedup_lines(df, min_chars=1, lines="a", dropped="b")
    assert set(out.columns) == {*df.columns, "a", "b"} and all(r[c] == c for r in out.collect() for c in NAMES)
    got = sorted(((r.doc_id, r.text) for r in out.collect()), key=repr)
    assert got == sorted([(1, rows[0][1]), (3, "alpha own line"), (3, rows[2][1]), (3, rows[2][1]), (None, "shared boilerplate line")], key=repr)


def test_stages_keep_columns_of_any_name(spark, sf, odd_docs):
    df = odd_docs.withColumns({c: F.lit(c) for c in NAMES})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, df, sf)
        assert out.columns == df.columns and all(r[c] == c for r in out.collect() for c in NAMES), name
    assert corpus_pipeline.STAGES[-1][1](spark, df, sf).count() > 0


def test_every_text_of_an_id_links(spark):
    text = lambda k: " ".join(f"w{k}x{i}" for i in range(40))
    rows = [(1, text(1)), (1, text(2) + " and some more words"), (2, text(1)), (3, text(2) + " and some more words"), (4, text(4)), (5, ""), (5, None), (None, text(1)), (5, text(5))]
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in partenum.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert {(d, c) for d, _, c in got} == {(1, 1), (2, 1), (3, 1), (4, 4), (5, 5), (None, None)}
    assert {n for d, n, _ in got if d == 1} == {40} and {n for d, n, _ in got if d == 5} == {36}


def test_history_repeats_all_turns_it_has_tokens_for(spark):
    turns = spark.createDataFrame([(1, i, "user" if i % 2 else "assistant", f"a b c d {i}") for i in range(800)], TURNS)
    out = {r.window: r for r in chat.format_windows(turns, budget=4096, history=2048).collect()}
    one = chat.count_tokens([chat.written("user", "a b c d 500")])[0]
    assert out[1].repeated >= 2048 // (one + 2) > 64
    first = chat.count_tokens([chat.written(r, t) for r, t in chat.read_turns(out[0].text)])
    assert sum(first[-out[1].repeated :]) <= 2048 < sum(first[-out[1].repeated - 1 :])


def test_a_commit_that_dies_changes_nothing(spark, tmp_path, monkeypatch):
    rows = spark.createDataFrame([("a", "en", 5, 9)], "source string, lang string, tokens bigint, chars bigint")
    store, ins = str(tmp_path / "s"), token_counts.changes(rows, F.lit("insert"), F.lit("v"))
    total = lambda: [(r.docs, r.tokens) for r in token_counts.totals(spark, store).collect()]
    assert total() == []
    token_counts.commit(ins, store, "one")
    assert total() == [(1, 5)]
    twice = ins.unionByName(ins)
    with monkeypatch.context() as m:
        m.setattr(token_counts, "_committed", lambda *a: 1 / 0)  # between the try and its row of the log
        with pytest.raises(ZeroDivisionError):
            token_counts.commit(twice, store, "one")
    assert total() == [(1, 5)]
    token_counts.commit(twice, store, "one")
    token_counts.commit(twice, store, "one")
    assert total() == [(2, 10)]
    assert len(list((tmp_path / "s" / "tries" / "batch=one").iterdir())) <= 3  # the one that counts and the dead one


@pytest.mark.parametrize("batch, least", [(1, 0), (3, 0), (7, 5), (100, 0), (100, 12)])
def test_units_are_whole(batch, least):
    rng = np.random.default_rng(batch)
    key = np.repeat(np.arange(40), rng.integers(1, 5, 40))
    rows = pa.RecordBatch.from_arrays([pa.array(key), pa.array(key * 0), pa.array(key * 0), pa.array(np.arange(len(key)))], names=["bucket", "i", "j", "n"])
    out = [x.to_pydict() for x in crosspoly._units((rows.slice(a, batch) for a in range(0, len(rows), batch)), least)]
    seen = [n for x in out for n in x["n"]]
    assert seen == list(range(len(key)))
    homes = [set(x["bucket"]) for x in out]
    assert sum(map(len, homes)) == len(set().union(*homes))  # no unit is in two
    if not least:
        assert all(len(h) == 1 for h in homes)
    elif batch == 100:
        assert len(out) < 20
