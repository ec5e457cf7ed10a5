"""The registered queries of the operators, and SQL for those that SQL can express."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, crosspoly, fim, line_dedup, media, mixing, packing, partenum, prefix_tree, ring, token_counts, topk, toxicity
from .common import settle, shared_dir, table


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    out = toxicity.score(docs, model)
    return out.select("doc_id", toxicity.held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_toxic", "spans")


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return partenum.near_duplicates(table(spark, sf_dir, "documents"))


def op3_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.features(media.to_media(table(spark, sf_dir, "documents")))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ring.assign(table(spark, sf_dir, "documents"), shards=24)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"), "slot", F.lit(None).cast("int").alias("grown_shard"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals after five commits: inserts with estimated counts, revisions to the
    tokenizer's counts, the same revisions again, a move of the documents labelled of low
    quality to another version (which counts words) and deletes of those labelled toxic."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    told = labels.groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min("quality").alias("quality"))
    rows = docs.withColumn("estimate", mixing.words(F.col("text")))
    rows = settle(token_counts.count_tokens(rows, ["doc_id", "source", "lang", "estimate"]), "token-counts")
    store, version, other = f"{shared_dir(spark)}/token-store-{uuid.uuid4().hex}", F.lit("word_bpe_49k"), F.lit("words")
    token_counts.commit(token_counts.changes(rows.withColumn("tokens", F.col("estimate")), F.lit("insert"), version), store, "ingest")
    revised = token_counts.changes(rows.withColumn("old_tokens", F.col("estimate")), F.lit("revise"), version)
    for _ in range(2):
        token_counts.commit(revised, store, "recount")
    rows = rows.join(told, "doc_id", "left").withColumn("low", F.coalesce(F.col("quality") == 0, F.lit(False)))
    moved = rows.filter("low")
    token_counts.commit(token_counts.changes(moved, F.lit("delete"), version).unionByName(token_counts.changes(moved.withColumn("tokens", F.col("estimate")), F.lit("insert"), other)), store, "move")
    gone = rows.filter("toxic = 1").withColumn("tokens", F.when(F.col("low"), F.col("estimate")).otherwise(F.col("tokens")))
    token_counts.commit(token_counts.changes(gone, F.lit("delete"), F.when(F.col("low"), other).otherwise(version)), store, "toxic")
    return token_counts.totals(spark, store)


def op6_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0, k=20)


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), min_chars=1)
    return out.select("doc_id", F.col("_lines").cast("long").alias("n_lines"), F.col("_dropped").cast("long").alias("n_dropped"), "text")


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    trap = r"\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", trap), (-7, 1, "assistant", trap)], "conv_id long, turn int, role string, text string")
    return chat.digests(chat.format_windows(turns.unionByName(extra)))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), capacity=2048)


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_tree.trie(prefix_tree.regrafted(prefix_tree.turn_ids(table(spark, sf_dir, "conversations"))))


def op12_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fim.restore(fim.transform(table(spark, sf_dir, "documents")))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))


def op13_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crosspoly.near_vectors(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        *(op1_toxicity, op2_ngram_jaccard, op3_media, op4_sharding, op5_token_counts, op6_topk, op7_line_dedup, op8_chat, op9_packing, op10_mixing),
        *(op11_prefix_trie, op12_fim, op13_near_vectors),
    )
}

_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"
_AZ = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

ORACLES: dict[str, str] = {
    "op2_ngram_jaccard": f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format(f"translate(coalesce(text, ''), '{_AZ}', '{_AZ.lower()}')")} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
      ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM w),
n AS (SELECT w.doc_id, coalesce(c.n, 0) AS n FROM w LEFT JOIN (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id) c USING (doc_id)),
link AS (SELECT p.a, p.b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2) p
         JOIN n na ON na.doc_id = p.a JOIN n nb ON nb.doc_id = p.b WHERE 100 * p.c >= 75 * (na.n + nb.n - p.c)),
reach AS (SELECT doc_id AS d, doc_id AS r FROM n UNION SELECT reach.d, link.b FROM reach JOIN link ON link.a = reach.r)
SELECT n.doc_id, n.n::BIGINT AS n_shingles, min(reach.r) AS component_id FROM n JOIN reach ON reach.d = n.doc_id GROUP BY ALL""",
    "op6_topk": """
WITH v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.r, q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score FROM v q JOIN v c ON q.r <> c.r WHERE q.vec_id % 20 = 0)
SELECT query_id, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM s
QUALIFY rank <= 20""",
    "op7_line_dedup": r"""
WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, no, regexp_replace(raw, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS line, raw
      FROM (SELECT doc_id, unnest(range(len(ls))) AS no, unnest(ls) AS raw FROM d)),
u AS (SELECT line, min({'d': doc_id, 'n': no}) AS pos, count(*) AS copies, string_split(line, ' ') AS w FROM l WHERE length(line) >= 1 GROUP BY line),
m AS (SELECT line, pos, w, len(w) AS n, length(bin(len(w))) AS e, length(bin(len(w) + 1)) AS e1 FROM u WHERE len(w) >= 8),
c AS (SELECT *, (1::BIGINT << (e - 2)) AS c FROM m UNION ALL SELECT *, (1::BIGINT << (e1 - 2)) AS c FROM m WHERE e1 > e),
k AS (SELECT line, pos, w, n, c, array_to_string(w[1:c], ' ') AS k, 'p' AS side FROM c UNION ALL SELECT line, pos, w, n, c, array_to_string(w[n - c + 1:n], ' '), 's' FROM c),
p AS (SELECT DISTINCT a.line, a.w AS a, b.w AS b, a.n AS na, b.n AS nb FROM k a JOIN k b ON a.k = b.k AND a.side = b.side AND a.c = b.c AND b.pos < a.pos AND abs(a.n - b.n) <= 1),
q AS (SELECT *, coalesce(list_position(list_transform(range(1, least(na, nb) + 1), lambda i: a[i] = b[i]), false), least(na, nb) + 1) AS x FROM p),
near AS (SELECT DISTINCT line FROM q WHERE CASE WHEN na = nb THEN a[x + 1:] = b[x + 1:] WHEN na > nb THEN a[x + 1:] = b[x:] ELSE a[x:] = b[x + 1:] END),
f AS (SELECT l.doc_id, l.no, l.raw, (u.line IS NOT NULL AND (u.pos < {'d': l.doc_id, 'n': l.no} OR near.line IS NOT NULL)) AS gone
      FROM l LEFT JOIN u USING (line) LEFT JOIN near USING (line))
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped, coalesce(string_agg(raw, chr(10) ORDER BY no) FILTER (NOT gone), '') AS text FROM f GROUP BY doc_id
UNION ALL SELECT doc_id, 0, 0, NULL FROM documents WHERE text IS NULL""",
    "op10_mixing": rf"""
WITH r0 AS (SELECT doc_id AS id, source, len({_WORDS.format("coalesce(text, '')")})::BIGINT AS size FROM documents),
r AS (SELECT *, greatest(1, least(64, length(bin(size)))) AS wt, (('0x' || substr(md5('1:' || coalesce(id::VARCHAR, 'null') || ':' || size), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0 AS u FROM r0),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM r GROUP BY source),
w AS (SELECT *, [3, 1, 2][((row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3) + 1]::BIGINT AS w, source_size * 2 AS lim FROM s),
t AS (SELECT *, coalesce(sum(lim) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used, sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS w_left,
             sum(source_size) OVER () * 3 AS total, row_number() OVER o AS k FROM w WINDOW o AS (ORDER BY lim / w, encode(source) NULLS LAST)),
t2 AS (SELECT *, (total - used * 2)::DOUBLE / (w_left * 2)::DOUBLE AS share FROM t),
t3 AS (SELECT *, arg_min(share, k) FILTER (lim > share * w) OVER () AS level FROM t2),
g AS (SELECT source, source_size, CASE WHEN level IS NULL OR lim <= share * w THEN lim::DOUBLE ELSE w * level END AS target FROM t3),
k0 AS (SELECT r.source, wt, sum(size)::BIGINT AS words, any_value(target) AS target FROM r JOIN g ON r.source IS NOT DISTINCT FROM g.source WHERE size > 0 GROUP BY r.source, wt),
k1 AS (SELECT *, coalesce(sum(words) OVER (PARTITION BY source ORDER BY wt DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) * 2 AS used,
              sum(words * wt) OVER (PARTITION BY source ORDER BY wt DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS heavy FROM k0),
k2 AS (SELECT *, (target - used::DOUBLE) / heavy::DOUBLE AS share FROM k1),
k3 AS (SELECT *, arg_max(share, wt) FILTER (2.0 > share * wt) OVER (PARTITION BY source) AS level FROM k2),
k4 AS (SELECT *, greatest(CASE WHEN level IS NULL OR 2.0 <= share * wt THEN 2.0::DOUBLE ELSE level * wt END, 0.0::DOUBLE) AS expected FROM k3),
k5 AS (SELECT source, wt, floor(expected) AS whole, expected - floor(expected) AS p, target - sum(floor(expected) * words) OVER (PARTITION BY source) AS rest FROM k4),
d AS (SELECT r.id, r.source, size, u, source_size, target, coalesce(whole, 0) AS whole, p, coalesce(rest, 0) AS rest
      FROM r JOIN g ON r.source IS NOT DISTINCT FROM g.source LEFT JOIN k5 ON r.source IS NOT DISTINCT FROM k5.source AND r.wt = k5.wt AND size > 0),
d2 AS (SELECT *, size > 0 AND coalesce(p, 0) > 0 AND rest >= 0.5 AS open, CASE WHEN p > 0 THEN (u / (1 - u)) / (p / (1 - p)) END AS odds FROM d),
c AS (SELECT *, sum(CASE WHEN open THEN size ELSE 0 END) OVER (PARTITION BY source ORDER BY NOT open, odds, id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM d2),
e AS (SELECT *, open AND upto <= rest AS took FROM c),
e2 AS (SELECT *, sum(CASE WHEN took THEN size ELSE 0 END) OVER (PARTITION BY source) AS got FROM e),
x AS (SELECT source, min({{'m': abs(rest - got - size), 'o': odds, 'i': id, 's': size}}) AS x FROM e2 WHERE open AND NOT took AND abs(rest - got - size) < rest - got GROUP BY source)
SELECT e2.id AS doc_id, size, source_size, target, (size * CASE WHEN size > 0 THEN whole + CASE WHEN took OR (open AND coalesce(x.x.i = e2.id AND x.x.o = odds AND x.x.s = size, false)) THEN 1 ELSE 0 END ELSE 0 END)::BIGINT AS taken
FROM e2 LEFT JOIN x ON e2.source IS NOT DISTINCT FROM x.source""",
    "op11_prefix_trie": """
WITH RECURSIVE t AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS i, {'r': coalesce(role, ''), 't': coalesce(text, '')} AS x FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT c, list(x ORDER BY i) AS xs FROM t GROUP BY c),
h AS (SELECT c, xs, c - (c % 5 + 5) % 5 AS b, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(c::VARCHAR, ''), lambda s: ascii(s)::BIGINT)),
        lambda crc, y: list_reduce(list_prepend(xor(crc, y), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda z, k: xor(z >> 1, 3988292384 * (z & 1)))), 4294967295) % 9 AS h FROM o),
r AS (SELECT h.c, list_concat(coalesce(o.xs[1:h], []), h.xs[h + 1:]) AS xs FROM h LEFT JOIN o ON o.c = h.b),
n AS (SELECT c, len(xs) AS l, d, xs[1:d] AS p FROM (SELECT c, xs, unnest(range(len(xs) + 1)) AS d FROM r)),
g AS (SELECT p, d, min(c) AS conv, count(*) AS n, coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (l = d), '') AS ends, coalesce(octet_length(encode(p[d].t)), 0) AS size FROM n GROUP BY p, d),
k AS (SELECT p[1:d - 1] AS p, d - 1 AS d, count(*) AS kids FROM g WHERE d > 0 GROUP BY 1, 2),
f AS (SELECT g.*, coalesce(kids, 0) AS kids FROM g LEFT JOIN k USING (p, d)),
u AS (SELECT p, d, (kids = 0)::BIGINT AS leaf, (n - 1) * size AS saved FROM f UNION ALL SELECT p[1:d - 1], d - 1, leaf, saved FROM (SELECT p, d, leaf, saved FROM u) WHERE d > 0),
s AS (SELECT p, d, sum(leaf)::BIGINT AS leaves, sum(saved)::BIGINT AS saved FROM u GROUP BY p, d)
SELECT f.conv AS conv_id, f.d::BIGINT AS depth, q.conv AS parent_conv_id, f.n AS n_convs, f.kids::BIGINT AS n_children, leaves AS n_leaves, s.saved AS saved_tokens, sha256(f.ends) AS ends_sha256
FROM f JOIN s USING (p, d) LEFT JOIN g q ON f.d > 0 AND q.d = f.d - 1 AND q.p = f.p[1:f.d - 1]""",
    "op12_fim": r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS x, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS w, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS s FROM documents),
h AS (SELECT *, len(w) AS n, ('0x' || s[1:8])::BIGINT AS h1, ('0x' || s[9:16])::BIGINT AS h2, ('0x' || s[17:24])::BIGINT AS h3, ('0x' || s[25:32])::BIGINT AS h4 FROM t),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
             CASE WHEN x = '' OR contains(x, '<P>') OR contains(x, '<S>') OR contains(x, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT *, array_to_string(w[1:a], '') AS pre, array_to_string(w[a + 1:b], '') AS mid, array_to_string(w[b + 1:], '') AS suf FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN x WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
       sha256(CASE form WHEN 'plain' THEN x ELSE pre || mid || suf END) AS restored_sha256 FROM p""",
    "op13_near_vectors": """
WITH RECURSIVE v AS (SELECT row_number() OVER () AS r, vec_id, label::VARCHAR AS label, embedding::DOUBLE[] AS e FROM embeddings),
u AS (SELECT r, vec_id, label, e FROM v WHERE label IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
l AS (SELECT a.r AS a, b.r AS b FROM u a JOIN u b ON a.label = b.label AND a.r <> b.r WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
c AS (SELECT r AS a, r AS z FROM v UNION SELECT c.a, l.b FROM c JOIN l ON l.a = c.z)
SELECT v.vec_id, (SELECT count(*) FROM l WHERE l.a = v.r) AS n_links, min(w.vec_id) AS component_id, v.vec_id IS NOT DISTINCT FROM min(w.vec_id) AS kept
FROM v JOIN c ON c.a = v.r JOIN v w ON w.r = c.z GROUP BY v.r, v.vec_id""",
}
