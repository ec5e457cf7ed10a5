"""Whole results where a bound once cut them."""

import duckdb

import corpus_pipeline
from fiberlake.llm import queries, toxicity

from test_near import brute_lines


def test_short_lines_are_compared(spark, tmp_path):
    docs = [(1, "And ornd.\nOf, edti oner.\n\n}"), (2, " And ornd.\na line of its own\n\n}"), (3, "And ornd."), (4, "a b c d e f g h\nOf, edti oner."), (5, "a b c d e f g x\n\nlast")]
    spark.createDataFrame([(d, t, "en", "a", len(t)) for d, t in docs], "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    want = brute_lines(docs, min_chars=1)
    assert want[2] == "a line of its own\n" and want[3] == ""
    assert {r.doc_id: r.text for r in queries.op7_line_dedup(spark, str(tmp_path)).collect()} == want
    out = corpus_pipeline.line_stage(spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path))
    assert {r.doc_id: r.text for r in out.collect()} == {d: t for d, t in want.items() if t.strip()}


def test_lines_match_sql_of_every_length(spark, sf):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{sf}/documents.parquet'")
    sql = queries.ORACLES["op7_line_dedup"]
    want = {tuple(r) for r in con.sql(f"SELECT doc_id, n_lines, n_dropped, text FROM ({sql})").fetchall()}
    got = {(r.doc_id, r.n_lines, r.n_dropped, r.text) for r in queries.op7_line_dedup(spark, sf).collect()}
    assert got == want


def test_toxic_rows_go_by_their_own_score(spark, odd_docs, sf, monkeypatch):
    clean, toxic = [f"some good words about number {i}" for i in range(40)], [f"vile slurry filth {i}" for i in range(40)]
    model = toxicity.fit(clean + toxic, [0] * 40 + [1] * 40)
    monkeypatch.setattr(toxicity, "train", lambda *_: model)
    rows = [(None, toxic[0]), (None, clean[0]), (1, toxic[1]), (1, clean[1]), (2, toxic[2]), (2, toxic[2]), (3, clean[3]), (3, clean[3]), (4, None), (None, None)]
    docs = spark.createDataFrame([(d, t, "en", "a", 1) for d, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    got = sorted(((r.doc_id, r.text) for r in corpus_pipeline.toxic_stage(spark, docs, sf).collect()), key=repr)
    assert got == sorted(((d, t) for d, t in rows if t not in toxic), key=repr)
    assert corpus_pipeline.toxic_stage(spark, odd_docs, sf).count() == toxicity.score(odd_docs, model).filter("score < 0.5").count()
