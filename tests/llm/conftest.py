import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
PAGES = "page_id long, url string, html string"


@pytest.fixture(scope="session")
def docs(spark):
    """A table from rows (doc_id, text[, lang, source]); with columns whose names clash with the operators' own."""

    def make(rows, extra=True):
        full = [(i, t, *(rest or (None, None))[:2], None if t is None else len(t)) for i, t, *rest in rows]
        df = spark.createDataFrame(full, DOCS)
        if extra:
            from pyspark.sql import functions as F

            for name in ("rid", "fp", "node", "h", "place", "token", "line", "host", "__rid", "body", "block"):
                df = df.withColumn(name, F.lit("clash"))
        return df

    return make


@pytest.fixture(scope="session")
def pages(spark):
    return lambda rows: spark.createDataFrame(rows, PAGES)


#: Nulls, empty and blank texts, repeated rows, ties, a long text, marks and other scripts.
ODD = [
    (1, None), (2, ""), (3, " \n\t "), (4, "one"), (4, "one"), (5, "one two three four five"), (5, "other text of the same id"), (None, "one two three four five"), (None, None),
    (6, "word " * 20000), (7, "日本語のテキスト — “quotes” … ß İ"), (8, "a\x00b\x1fc \x85d\u2028e"), (9, "🙂" * 40), (10, "x" * 30000), (11, "one two three four five"),
]
