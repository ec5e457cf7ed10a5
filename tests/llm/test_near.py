"""N-gram Jaccard join and line dedup against brute force."""

import re
from itertools import combinations

import numpy as np
import pytest

from fiberlake.llm import line_dedup, partenum
from fiberlake.llm.common import settle
from fiberlake.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t)


def brute(docs, num=75, den=100):
    sets = {}
    for d, t in docs:
        w = WORD.findall(lower(t or ""))
        sets[d] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    par = {d: d for d in sets}

    def find(x):
        while par[x] != x:
            x = par[x]
        return x

    for a, b in combinations(sorted(sets), 2):
        i, u = len(sets[a] & sets[b]), len(sets[a] | sets[b])
        if u and den * i >= num * u and i:
            a, b = sorted((find(a), find(b)))
            par[b] = a
    return {d: (len(sets[d]), find(d)) for d in sets}


def variants(rng, n, size, edits):
    base = [f"w{rng.integers(10_000)}" for _ in range(size)]
    for _ in range(n):
        t = list(base)
        for _ in range(rng.integers(0, edits + 1)):
            k = rng.integers(len(t))
            t[k] = f"w{rng.integers(10_000)}"
        yield " ".join(t)


@pytest.mark.parametrize("seed,size,edits", [(0, 200, 8), (1, 30, 2), (2, 9, 1), (3, 70, 5)])
def test_components(spark, seed, size, edits):
    rng = np.random.default_rng(seed)
    texts = [t for _ in range(6) for t in variants(rng, 10, size, edits)]
    docs = list(enumerate(rng.permutation(texts).tolist()))
    got = partenum.near_duplicates(spark.createDataFrame(docs, "doc_id bigint, text string"))
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got.collect()} == brute(docs)


def test_odd_documents(spark, odd_docs, no_docs):
    got = partenum.near_duplicates(odd_docs).collect()
    ids = [r.doc_id for r in odd_docs.collect()]
    assert sorted(r.doc_id for r in got if r.doc_id is not None) == sorted({d for d in ids if d is not None})
    assert len(got) == len({d for d in ids if d is not None}) + ids.count(None)
    want = brute([(r.doc_id, r.text) for r in odd_docs.collect() if r.doc_id is not None])
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got if r.doc_id is not None} == want
    assert [r.component_id for r in got if r.doc_id is None] == [None]
    assert partenum.near_duplicates(no_docs).count() == 0


def test_signatures_of_linked_sets_meet():
    """For random pairs at the threshold, whatever their sizes."""
    rng = np.random.default_rng(4)
    for _ in range(400):
        n = int(rng.integers(1, 150))
        u = rng.choice(1 << 60, size=2 * n + 10, replace=False).astype(np.uint64)
        lack = partenum.lacking(n, 75, 100)
        a = u[:n]
        gone = int(rng.integers(0, lack + 1))
        keep = a[: n - gone]
        more = max(0, len(keep) * 100 // 75 - n)
        b = np.concatenate([keep, u[n : n + int(rng.integers(0, more + 1))]])
        i, un = len(keep), len(a) + len(b) - len(keep)
        assert 100 * i >= 75 * un
        sig, own, least = partenum.signatures([1, 2], [np.sort(a), np.sort(b)], 75, 100)
        assert len(set(sig[own == 1]) & set(sig[own == 2])) >= max(least)


def test_blocks_find_links(spark):
    """Sets that hubs leave are compared block against block."""
    rng = np.random.default_rng(5)
    docs = list(enumerate(t for t in variants(rng, 120, 100, 9)))
    got = partenum.near_duplicates(spark.createDataFrame(docs, "doc_id bigint, text string"), pivots=0)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got.collect()} == brute(docs)


def test_graph_components(spark):
    e = [(i, i + 1) for i in range(0, 40)] + [(100, 102), (102, 101), (7, 7)]
    for parts in (1, 7):
        got = {r.node: r.component for r in components(spark.createDataFrame(e, "a bigint, b bigint").repartition(parts)).collect()}
        assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in (100, 101, 102)}}


# lines ---------------------------------------------------------------------------
def one_edit(a, b):
    if a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_lines(docs, min_chars=20, near=8):
    lines = []
    for d, t in docs:
        for n, x in enumerate(t.split("\n")):
            lines.append(((d, n), x.strip(" \t\n\x0b\x0c\r")))
    lines.sort()
    gone = set()
    for k, (at, x) in enumerate(lines):
        if len(x) < min_chars:
            continue
        w = x.split(" ")
        for _, y in lines[:k]:
            if x == y or (len(w) >= near and len(y.split(" ")) >= near and len(y) >= min_chars and one_edit(w, y.split(" "))):
                gone.add(at)
                break
    return {d: "\n".join(x for n, x in enumerate(t.split("\n")) if (d, n) not in gone) for d, t in docs}


def test_lines(spark):
    rng = np.random.default_rng(6)
    pool = [[f"w{rng.integers(500)}" for _ in range(rng.integers(3, 30))] for _ in range(25)]
    docs = []
    for d in range(40):
        out = []
        for _ in range(rng.integers(1, 8)):
            w = list(pool[rng.integers(len(pool))])
            for _ in range(rng.integers(0, 3)):
                k = int(rng.integers(len(w) + 1))
                kind = rng.integers(3)
                w = w[:k] + ([f"e{rng.integers(50)}"] if kind else []) + w[k + (kind != 1) :]
            out.append("  " * int(rng.integers(2)) + " ".join(w))
        docs.append((d, "\n".join(out)))
    got = line_dedup.dedup_lines(spark.createDataFrame(docs, "doc_id bigint, text string"))
    assert {r.doc_id: r.text for r in got.collect()} == brute_lines(docs)


def test_odd_lines(spark, odd_docs, no_docs):
    out = line_dedup.dedup_lines(odd_docs)
    got = out.collect()
    assert len(got) == odd_docs.count() and set(odd_docs.columns) < set(out.columns)
    by = {r.doc_id: r.text for r in got}
    assert by[4] is None and by[5] == "" and by[8] == "x" * 50_000 and by[2] == "" and by[3] == ""
    assert by[7] == "One two.\nEnd of the text." and by[None] == "a text without an id, and some words more"
    assert [r.text for r in got if r.doc_id == 10] == ["repeated row with a few words in it"] * 2
    assert by[9].split("\n") == ["Line number 0 of a long text with some words."]
    assert line_dedup.dedup_lines(no_docs).count() == 0


def test_plans_have_no_python(spark, odd_docs, monkeypatch):
    plans = []
    monkeypatch.setattr(line_dedup, "settle", lambda df, name: plans.append(df._jdf.queryExecution().toString()) or settle(df, name))
    plans.append(line_dedup.dedup_lines(odd_docs)._jdf.queryExecution().toString())
    assert len(plans) > 10 and not any(re.search("Python|Pandas|InArrow", p) for p in plans)
