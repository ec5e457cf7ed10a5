"""The pipeline's stages, in order, on the small tables."""

import corpus_pipeline
from fiberlake.llm import mixing, partenum
from fiberlake.llm.common import table


def test_stages(spark, sf):
    docs = table(spark, sf, "documents")
    cols, ids = docs.columns, {r.doc_id for r in docs.select("doc_id").collect()}
    toxic = {r.doc_id for r in table(spark, sf, "labels").filter("toxic = 1").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf).cache()
        assert out.columns == cols, name
        kept = {r.doc_id for r in out.select("doc_id").collect()}
        assert kept <= ids
        if name == "toxicity":
            assert len(kept) >= 0.8 * (len(ids) - len(toxic))
            assert len(toxic) < 100 or len(kept & toxic) <= 0.2 * len(toxic)
        if name == "ngram_jaccard":
            assert partenum.near_duplicates(out).filter("component_id <> doc_id").count() == 0
        docs, ids = out, kept
    placed = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert {r.doc_id for r in placed.collect()} == ids


def test_odd_documents_pass_every_stage(spark, odd_docs, no_docs, sf):
    for docs in (odd_docs, no_docs):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, docs, sf).columns == odd_docs.columns, name
            stage(spark, docs, sf).count()
        pieces = corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()
        assert {r.doc_id for r in pieces} == {r.doc_id for r in docs.collect()} and all(r.length > 0 for r in pieces)


ROWS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def test_rows_decide_for_themselves(spark, sf):
    """Repeated rows, rows that share an id and rows without one, through the near and the mix stage."""
    long = [" ".join(f"w{k}x{i}" for i in range(80)) for k in range(5)]
    rows = [
        (1, long[0], "en", "a", 1), (1, long[0], "en", "a", 1),  # one row twice
        (2, long[0] + " more", "en", "a", 1), (None, long[0], "en", "a", 1),  # near it
        (3, long[1], "en", "a", 1), (3, long[2], "en", "a", 1),  # two texts of one id
        (None, long[3], "en", None, 1), (None, long[3], "en", None, 1), (5, long[3], "en", None, 2),
        (None, long[4], "en", "b", 1), (6, "", "en", "b", 1), (7, None, "en", "b", 1), (7, None, "en", "b", 1),
    ]
    docs = spark.createDataFrame(rows, ROWS)
    got = sorted(map(tuple, corpus_pipeline.near_stage(spark, docs, sf).collect()), key=repr)
    want = [rows[0], rows[4], rows[5], rows[8], rows[9], rows[10], rows[11]]
    assert got == sorted(want, key=repr)


def test_mix_takes_what_the_operator_takes(spark, sf):
    rows = [(i // 7, " ".join(["w"] * (1 + i % 5 * (i % 3))), "en", "ab"[i % 2], 1) for i in range(210)] + [(None, "a b c", "en", "a", 1)] * 25 + [(9, "x y", "en", "b", 1)] * 31
    docs = spark.createDataFrame(rows, ROWS).withColumn("__k", corpus_pipeline._key(spark.createDataFrame(rows, ROWS)))
    want = {}
    for r in mixing.mix(docs, "__k").collect():
        want[r.id] = want.get(r.id, 0) + r.copies
    out = corpus_pipeline.mix_stage(spark, docs.drop("__k"), sf)
    got = {r.k: r["count"] for r in out.groupBy(corpus_pipeline._key(out).alias("k")).count().collect()}
    assert got == {k: n for k, n in want.items() if n}
