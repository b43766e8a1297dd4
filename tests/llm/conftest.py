import pytest


@pytest.fixture()
def make_docs(spark):
    """Documents from (doc_id, text) or (doc_id, text, source) rows."""
    def make(rows, extra=""):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or "")) for r in rows]
        df = spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long")
        return df.selectExpr("*", *extra.split(";")) if extra else df
    return make
