"""The registered queries themselves: against their SQL, and against the rows where SQL cannot say it."""

import hashlib
import math
import zlib
from bisect import bisect_left
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from fiberlake.llm import bpe, media, queries, ring, token_counts, toxicity
from fiberlake.llm.common import WORD, table


def norm(x):
    if isinstance(x, (float, np.floating)):
        return None if math.isnan(x) else float(f"{x:.9g}")
    return x


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in ("documents", "embeddings", "labels", "conversations"):
        c.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return c


@pytest.fixture(scope="module")
def documents(spark, sf):
    return table(spark, sf, "documents").collect()


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_matches_sql(spark, sf, con, name):
    df = queries.QUERIES[name](spark, sf)
    rel = con.sql(queries.ORACLES[name])
    assert sorted(rel.columns) == sorted(df.columns)
    at = [list(rel.columns).index(c) for c in sorted(df.columns)]
    want = sorted((tuple(norm(r[i]) for i in at) for r in rel.fetchall()), key=repr)
    assert sorted((tuple(norm(r[c]) for c in sorted(df.columns)) for r in df.collect()), key=repr) == want


def test_toxicity_scores_every_document(spark, sf, documents):
    got = queries.op1_toxicity(spark, sf).collect()
    assert sorted(r.doc_id for r in got) == sorted(r.doc_id for r in documents)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)


def test_a_text_that_does_not_fit_is_passed_over(spark):
    rows = [(i, ("vile slurry filth " if i % 2 else "some good words ") + f"number {i} " * (200_000 if i == 3 else 1), i % 2) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, toxic int")
    model = toxicity.train(df, df, max_bytes=100_000)
    got = {r.doc_id: r.score for r in toxicity.score(df, model).collect()}
    assert all((got[i] >= 0.5) == bool(y) for i, _, y in rows)


def read_by_hand(data):
    """Samples of a grey 8-bit picture, by the definition of the format: a byte at a time."""
    assert data[:8] == bytes([137, 80, 78, 71, 13, 10, 26, 10])
    at, body, kinds = 8, b"", []
    while at < len(data):
        n, kind = int.from_bytes(data[at : at + 4], "big"), data[at + 4 : at + 8]
        assert zlib.crc32(data[at + 4 : at + 8 + n]) == int.from_bytes(data[at + 8 + n : at + 12 + n], "big")
        part = data[at + 8 : at + 8 + n]
        if kind == b"IHDR":
            w, h = int.from_bytes(part[:4], "big"), int.from_bytes(part[4:8], "big")
            assert part[8:] == bytes([8, 0, 0, 0, 0])
        body += part if kind == b"IDAT" else b""
        kinds.append(kind)
        at += 12 + n
    assert at == len(data) and kinds[0] == b"IHDR" and kinds[-1] == b"IEND"
    raw, above, out = zlib.decompress(body), bytes(w), []
    assert len(raw) == h * (w + 1)
    for y in range(h):
        f, row = raw[y * (w + 1)], bytearray(raw[y * (w + 1) + 1 : (y + 1) * (w + 1)])
        assert f in (0, 1, 2)
        for x in range(w):
            row[x] = (row[x] + (0 if f == 0 else above[x] if f == 2 else row[x - 1] if x else 0)) & 255
        above = bytes(row)
        out.append(above)
    return b"".join(out), w, h


def test_media_columns(spark, sf, documents):
    stored = {r.doc_id: bytes(r.media) for r in media.to_media(table(spark, sf, "documents")).collect()}
    got = {r.doc_id: r for r in queries.op3_media(spark, sf).collect()}
    assert sorted(got) == sorted(r.doc_id for r in documents)
    for r in documents:
        raw, m = (r.text or "").encode(), stored[r.doc_id]
        p = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        samples, w, h = read_by_hand(m)
        assert samples == p and w == 64
        x = got[r.doc_id]
        assert (x.n_bytes, x.payload_bytes, x.payload_sha256, x.tail_crc32) == (len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
        assert (x.media_bytes, x.media_sha256) == (len(m), hashlib.sha256(m).hexdigest())


def test_media_feature_is_the_cosine_transform(spark, sf, documents):
    got = {r.doc_id: r.feature for r in queries.op3_media(spark, sf).collect()}
    cos = lambda n: np.cos(np.pi / n * np.outer(np.arange(8), np.arange(n) + 0.5))
    near = 0
    for r in documents:
        x = np.frombuffer(media.payload((r.text or "").encode()), np.uint8).reshape(-1, 64).astype(float)
        c = np.rint((cos(len(x)) @ x @ cos(64).T) * 16 / len(x)).ravel()
        want = np.packbits(c > np.median(c[1:])).tobytes().hex()
        off = bin(int(want, 16) ^ int(got[r.doc_id], 16)).count("1")
        assert off <= 4  # of 64: single precision may round a coefficient at the median the other way
        near += off == 0
    assert near >= 0.95 * len(documents)


def test_sharding_law_and_ring(spark, sf, documents):
    got = queries.op4_sharding(spark, sf).collect()
    text = {r.doc_id: (r.text or "").encode() for r in documents}
    assert {r.doc_id for r in got} == set(text) and len(got) == len(documents)
    assert all(r.size == len(text[r.doc_id]) + 8 and r.text_crc32 == zlib.crc32(text[r.doc_id]) and r.law == "rows" and r.grown_shard is None for r in got)
    by: dict = {}
    for r in got:
        by.setdefault(r.shard, []).append(r.slot)
    assert set(by) == set(range(24)) and max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert all(sorted(x) == list(range(len(x))) for x in by.values())
    # with room for all, every key stays with the point that a search of the ring finds
    points = ring.ring(24, 64)
    keys = {r.doc_id: r.k for r in table(spark, sf, "documents").select("doc_id", F.shiftrightunsigned(F.xxhash64("doc_id"), 32).alias("k")).collect()}
    free = ring.assign(table(spark, sf, "documents"), slack=23.0).collect()
    assert all(r.shard == points[bisect_left([p for p, _ in points], keys[r.doc_id]) % len(points)][1] for r in free)


def test_token_totals(spark, sf, documents):
    tok = Tokenizer.from_file(bpe.default_path())
    lab = {}
    for r in table(spark, sf, "labels").collect():
        t, q = lab.get(r.doc_id, (0, 1))
        lab[r.doc_id] = max(t, r.toxic), min(q, r.quality)
    want: Counter = Counter()
    for r in documents:
        toxic, quality = lab.get(r.doc_id, (0, 1))
        if not toxic:
            words = len(__import__("re").findall(WORD, r.text or ""))
            version = "words" if quality == 0 else "word_bpe_49k"
            want[r.source, r.lang, version, "docs"] += 1
            want[r.source, r.lang, version, "tokens"] += words if quality == 0 else len(tok.encode(r.text or "", add_special_tokens=False).ids)
            want[r.source, r.lang, version, "chars"] += len(r.text or "")
    got = {(r.source, r.lang, r.tokenizer, c): r[c] for r in queries.op5_token_counts(spark, sf).collect() for c in ("docs", "tokens", "chars")}
    assert {k: n for k, n in got.items() if n} == {k: n for k, n in want.items() if n}
    assert {k[2] for k in got} == {"words", "word_bpe_49k"}


def test_a_batch_that_shrinks_replaces_all_it_had(spark, tmp_path):
    rows = spark.createDataFrame([("a", "en", 5, 9), ("b", "fr", 7, 8)], "source string, lang string, tokens bigint, chars bigint")
    store, ins = str(tmp_path / "s"), token_counts.changes(rows, F.lit("insert"), F.lit("v"))
    total = lambda: {(r.source, r.lang): (r.docs, r.tokens, r.chars) for r in token_counts.totals(spark, store).collect()}
    token_counts.commit(ins, store, "x/y=1")
    assert total() == {("a", "en"): (1, 5, 9), ("b", "fr"): (1, 7, 8)}
    token_counts.commit(ins.filter("source = 'a'"), store, "x/y=1")
    assert total() == {("a", "en"): (1, 5, 9)}
    token_counts.commit(ins.limit(0), store, "x/y=1")
    assert total() == {}


def test_packing_holds_every_token_once(spark, sf, documents):
    tok = Tokenizer.from_file(bpe.default_path())
    got = queries.op9_packing(spark, sf).collect()
    by: dict = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for x in by.values():
        x.sort()
        assert all(a + n == b for (a, n), (b, _) in zip(x, x[1:])) and x[0][0] == 0 and sum(n for _, n in x) <= 2048
    ids: dict = {}
    for r in sorted(got, key=lambda r: (r.doc_id, r.piece)):
        ids.setdefault(r.doc_id, []).append(r)
    assert sorted(ids) == sorted(d.doc_id for d in documents)
    for d in documents:
        want = np.array([*tok.encode(d.text or "", add_special_tokens=False).ids, 0], "<u4")
        assert [(r.start, r.length, r.ids_crc32) for r in ids[d.doc_id]] == [(i, len(want[i : i + 2048]), zlib.crc32(want[i : i + 2048].tobytes())) for i in range(0, len(want), 2048)]
