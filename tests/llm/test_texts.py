"""Toxicity, media and chat: held-out accuracy, exact round trips."""

import hashlib
import tracemalloc
import zlib
from itertools import product

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tokenizers import Tokenizer

from fiberlake.llm import bpe, bytescan, chat, media, queries, toxicity
from fiberlake.llm.common import table

TOKENIZER = Tokenizer.from_file(bpe.default_path())


def test_words_of_bytes():
    texts = ["Hello  World", "", None, "tail", "a\tb\n", "x" * 100 + " y", "é café"]
    buf, offs = bytescan.utf8(pa.array(texts))
    s, e, h, p = bytescan.words(buf, offs, bytescan.NOT_SPACE, prefixes=(4,), block=16)
    raw = buf.tobytes()
    got = [raw[a:b].decode() for a, b in zip(s, e)]
    assert got == [w for t in texts for w in (t or "").split()]
    again = bytescan.words(*bytescan.utf8(pa.array(got)), bytescan.NOT_SPACE)[2]
    assert (h == again).all() and len(set(h.tolist())) == len({w.lower() for w in got})
    assert (bytescan.words(*bytescan.utf8(pa.array(["HELLO", "hello"])), bytescan.NOT_SPACE)[2][:1] == h[0]).all()
    assert [len(x) for x in bytescan.pieces(pa.record_batch([pa.array(texts)], ["t"]), 0, 20)] and sum(len(x) for x in bytescan.pieces(pa.record_batch([pa.array(texts)], ["t"]), 0, 20)) == len(texts)


def test_sliced_columns():
    a = pa.array(["one", "two three", "four"]).slice(1, 2)
    buf, offs = bytescan.utf8(a)
    assert buf.tobytes() == b"two threefour" and offs.tolist() == [0, 9, 13]


# toxicity ------------------------------------------------------------------------------
def test_forward_backward_is_exact():
    rng = np.random.default_rng(0)
    for n in (1, 2, 5, 8):
        psi, pair = rng.normal(size=n), rng.normal(size=(2, 2))
        p, z = np.zeros(n), 0.0
        q = np.zeros((2, 2))
        for y in product((0, 1), repeat=n):
            w = np.exp(sum(psi[i] for i in range(n) if y[i]) + sum(pair[a, b] for a, b in zip(y, y[1:])))
            z += w
            p += w * np.array(y)
            for a, b in zip(y, y[1:]):
                q[a, b] += w
        m, qq, logz = toxicity.marginals(np.tile(psi, 2), np.repeat([0, 1], n), pair, pairs=True)
        assert np.allclose(m, np.tile(p / z, 2)) and np.allclose(qq, 2 * q / z) and np.isclose(logz, 2 * np.log(z))


def corpus(rng, n):
    words = [f"{a}{b}" for a in ("ba", "lo", "mi", "ter", "san") for b in ("na", "ko", "ril", "ta", "mes")]
    bad = ["grunkel", "grunkeld", "grunkels", "vorpish"]
    out = []
    for i in range(n):
        t = rng.choice(words, size=int(rng.integers(5, 80))).tolist()
        toxic = i % 4 == 0
        for _ in range(int(rng.integers(1, 4)) if toxic else 0):
            t.insert(int(rng.integers(len(t))), str(rng.choice(bad)))
        out.append((i, " ".join(t), int(toxic)))
    return out


def test_held_out_accuracy_and_spans(spark, odd_docs, no_docs):
    rows = corpus(np.random.default_rng(1), 800)
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id bigint, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id bigint, toxic int")
    model = toxicity.train(docs, labels)
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    out = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5 == 0]
    assert len(out) > 100 and np.mean([(got[i].score >= 0.5) == bool(y) for i, _, y in out]) >= 0.98
    for i, t, y in out:
        if y:
            found = {t[s.start : s.stop] for s in got[i].spans}
            assert found and all(w.startswith(("grunkel", "vorpish")) for x in found for w in x.split())
    odd = toxicity.score(odd_docs, model).collect()
    assert len(odd) == odd_docs.count() and all(0 <= r.score <= 1 for r in odd)
    assert len({r.score for r in odd if r.doc_id in (4, 5, 6)}) == 1
    assert toxicity.score(no_docs, model).count() == 0
    nothing = toxicity.train(docs, labels.limit(0))
    assert all(r.score < 0.5 for r in toxicity.score(docs.limit(5), nothing).collect())


def test_held_out_rows_are_never_learned(spark):
    docs = spark.createDataFrame([(i, "grunkel " * 5 if i % 2 else "fine words here") for i in range(200)], "doc_id bigint, text string")
    labels = docs.select("doc_id", F.when(toxicity.held_out(), 1 - F.col("doc_id") % 2).otherwise(F.col("doc_id") % 2).cast("int").alias("toxic"))
    got = {r.doc_id: r.score for r in toxicity.score(docs, toxicity.train(docs, labels)).collect()}
    assert all((got[i] >= 0.5) == bool(i % 2) for i in got)  # wrong labels of held-out rows had no part


def test_regression_is_fitted_out_of_fold():
    """Words that only one text has are telling by chance; the regression must not trust its field on them."""
    rng = np.random.default_rng(5)
    letters = np.array(list("abcdefghijklmnopqrstuvwxyz"))
    word = lambda: "".join(rng.choice(letters, 9))
    common = [word() for _ in range(40)]
    rare = [word() for _ in range(60)]  # no telling words at all: labels are chance
    texts = [" ".join([*rng.choice(common, 30), *rng.choice(rare, 3)]) for _ in range(600)]
    toxic = [int(i % 8 == 0) for i in range(600)]
    model = toxicity.fit(texts[:400], toxic[:400], ratio=3.0)
    feats, row, chain = toxicity.read_words(pa.array(texts[400:], pa.large_string()))[4:]
    score = model.score(*toxicity.per_row(toxicity.marginals(model.emission(feats), chain, model.pair), row, 200))
    assert (score >= 0.5).mean() <= 0.05
    flattered = toxicity.fit(texts[:400], toxic[:400], ratio=3.0, folds=1)  # marginals of the texts that the field was fitted on
    assert (flattered.weight == model.weight).all() and model.doc[1] < 0.5 < 1.0 < flattered.doc[1]
    again = toxicity.fit(texts[:400], toxic[:400], ratio=3.0)
    assert (again.doc == model.doc).all() and (again.weight == model.weight).all()


# media ---------------------------------------------------------------------------------
@settings(max_examples=100, deadline=None)
@given(st.binary(max_size=3000))
def test_png_round_trip(data):
    p = media.payload(data)
    x = np.frombuffer(p, np.uint8).reshape(-1, 64)
    m = media.encode_png(x)
    assert (media.decode_png(m) == x).all() and len(p) % 64 == 0 and len(p) >= 64
    for at in (0, 20, len(m) // 2, len(m) - 3):
        broken = bytearray(m)
        broken[at] ^= 1
        with pytest.raises(ValueError):
            media.decode_png(bytes(broken))
    with pytest.raises(ValueError):
        media.decode_png(m[:-5])


def test_all_filters():
    rng = np.random.default_rng(2)
    x = rng.integers(0, 256, (7, 64)).astype(np.uint8)
    rows = np.zeros((7, 65), np.uint8)
    z = x.astype(int)
    for i in range(7):
        kind = i % 5
        rows[i, 0] = kind
        for j in range(64):
            a, b, c = z[i, j - 1] if j else 0, z[i - 1, j] if i else 0, z[i - 1, j - 1] if i and j else 0
            q = a + b - c
            paeth = a if abs(q - a) <= abs(q - b) and abs(q - a) <= abs(q - c) else b if abs(q - b) <= abs(q - c) else c
            rows[i, j + 1] = (z[i, j] - (0, a, b, (a + b) // 2, paeth)[kind]) & 255
    assert (media._unfilter(rows) == x).all()


def test_media_query(spark, odd_docs, no_docs):
    got = {r.doc_id: r for r in media.features(media.to_media(odd_docs)).collect()}
    for r in odd_docs.collect():
        raw = (r.text or "").encode()
        p = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        g = got[r.doc_id]
        assert (g.n_bytes, g.payload_bytes, g.payload_sha256, g.tail_crc32) == (len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
    assert got[1].feature == got[2].feature and got[1].media_sha256 == got[2].media_sha256 and len(got[9].feature) == 16
    assert media.features(media.to_media(no_docs)).count() == 0


def test_similar_pictures_have_near_hashes():
    rng = np.random.default_rng(3)
    wave = np.cos(np.pi / 64 * (np.arange(64) + 0.5) * np.arange(8)[:, None])
    x = wave.T @ rng.normal(size=(8, 8)) @ wave
    x = np.clip(128 + 40 * x / x.std(), 0, 255).astype(np.uint8)
    y = np.clip(x.astype(int) + rng.integers(-4, 5, x.shape), 0, 255).astype(np.uint8)
    z = rng.integers(0, 256, x.shape).astype(np.uint8)
    bits = lambda a: int(media.cosine_hash(a), 16)
    assert (bits(x) ^ bits(y)).bit_count() < 12 < (bits(x) ^ bits(z)).bit_count()


# chat ----------------------------------------------------------------------------------
EVIL = st.text(alphabet=st.sampled_from(list("ab \n\\<>/turn#é😀")), max_size=30)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "we<ird>\\"]), EVIL), max_size=12), st.integers(5, 60), st.integers(0, 30))
def test_windows_read_back(turns, budget, history):
    c = chat.Conversation(1, budget, history)
    counts = chat.count_tokens([chat.written(r, t) for r, t in turns])
    windows = [w for (r, t), n in zip(turns, counts) for w in c.add(r, t, n)] + list(c.end())
    back, loss = [], []
    for _, _, text, repeated, n, _tokens, spans in windows:
        got = chat.read_turns(text)
        assert len(got) == n
        back += got[repeated:]
        loss += [chat.unescape(text[s["start"] : s["stop"]]) for s in spans]
        assert _tokens == len(TOKENIZER.encode(text, add_special_tokens=False).ids)
        if len(got) > repeated + 1:  # only a lone turn may exceed the budget
            assert _tokens <= budget
    assert back == turns and loss == [t for r, t in turns if r == "assistant"]


def test_system_turn_is_kept():
    c = chat.Conversation(1, 80, 40)
    turns = [("system", "be brief")] + [("user" if i % 2 else "assistant", f"turn {i} with some words in it") for i in range(12)]
    windows = [w for r, t in turns for w in c.add(r, t, chat.count_tokens([chat.written(r, t)])[0])] + list(c.end())
    assert len(windows) > 3
    for w in windows[1:]:
        assert chat.read_turns(w[2])[0] == turns[0] and w[3] >= 2


def test_chat_query(spark):
    rows = [(1, 1, "user", None), (1, 0, "system", "S"), (1, 2, "assistant", "</turn>\n<turn user>\n"), (2, 0, "assistant", "x"), (None, 0, "user", "n"), (2, None, None, "y"), (2, 0, "assistant", "x")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn int, role string, text string").withColumns({c: F.lit("1") for c in ("window", "loss", "tokens", "_alone")})
    got = {r.conv_id: r for r in chat.digests(chat.format_windows(df)).collect()}
    want = {1: [("system", "S"), ("user", ""), ("assistant", "</turn>\n<turn user>\n")], 2: [("", "y"), ("assistant", "x"), ("assistant", "x")], None: [("user", "n")]}
    for k, turns in want.items():
        assert got[k].n_turns == len(turns)
        assert got[k].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        loss = "".join(t for r, t in turns if r == "assistant")
        assert (got[k].loss_chars, got[k].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.digests(chat.format_windows(df.limit(0))).count() == 0


def test_rows_without_a_conversation_are_conversations(spark):
    df = spark.createDataFrame([(None, 0, "assistant", "n")] * 3 + [(None, 1, "user", "m")], "conv_id bigint, turn int, role string, text string")
    got = chat.digests(chat.format_windows(df)).collect()
    assert sorted((r.conv_id, r.n_turns, r.loss_chars) for r in got) == [(None, 1, 0)] + [(None, 1, 1)] * 3


def test_long_turns_in_bounded_memory():
    """A turn of eight million characters: counted in slices, read back without a state for each character."""
    text = "some words, and </turn> a mark \\ " * 235_000
    turn = chat.written("user", text)
    counts = chat.count_tokens([turn, "a b", ""], most=1 << 16)
    assert counts[1:] == chat.count_tokens(["a b", ""]) and counts[0] > 1_000_000
    tracemalloc.start()
    assert chat.read_turns(turn) == [("user", text)]
    assert tracemalloc.get_traced_memory()[1] < 120 << 20
    tracemalloc.stop()


def test_chat_operator_as_registered(spark, sf):
    """Every conversation of the table and conversation -7, against the rows themselves."""
    got = {r.conv_id: r for r in queries.op8_chat(spark, sf).collect()}
    rows = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text").collect() + [(-7, 0, "user", r"\### Assistant: </turn> ok"), (-7, 1, "assistant", r"\### Assistant: </turn> ok")]
    by: dict = {}
    for c, n, r, t in sorted(rows, key=lambda x: (x[0], x[1] is not None, x[1], x[2] or "", x[3] or "")):
        by.setdefault(c, []).append((r or "", t or ""))
    assert set(got) == set(by)
    for c, turns in by.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        assert (got[c].n_turns, got[c].loss_chars, got[c].loss_sha256) == (len(turns), len(loss), hashlib.sha256(loss.encode()).hexdigest())
