import pytest

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows and columns whose names clash."""
    base = " ".join(f"word{i}" for i in range(60))
    rows = [
        (1, base, "en", "a", 10),
        (2, base, "en", "a", 10),
        (3, base.replace("word30", "other"), "en", None, 10),
        (4, None, "en", "b", None),
        (5, "", None, "b", 0),
        (6, "  \n\t ", "en", "b", 5),
        (7, "One two.\n" + base + "\nEnd of the text.", "en", "c", 5),
        (8, "x" * 50_000, "en", "c", 5),
        (9, "\n".join(f"Line number {i} of a long text with some words." for i in range(3000)), "en", "c", 5),
        (None, "a text without an id, and some words more", "en", "c", 5),
        (10, "repeated row with a few words in it", "en", "c", 5),
        (10, "repeated row with a few words in it", "en", "c", 5),
        (11, "Été où Ça — naïve 日本語 \U0001f600 'quoted' it's <|endoftext|> x", "fr", "d", 5),
    ]
    df = spark.createDataFrame(rows, DOCS)
    clash = {c: "1" for c in ("id", "doc", "k", "at", "size", "rank", "key", "n", "rep", "digest", "_salt", "line", "no", "copies", "target", "slot", "piece", "length", "score", "ids")}
    from pyspark.sql import functions as F

    return df.withColumns({c: F.lit(v) for c, v in clash.items()})


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
