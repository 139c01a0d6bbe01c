import pytest

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def frame(spark):
    """Documents from (doc_id, text) rows, with more columns, some of which clash with
    names that operators use inside."""

    def make(rows, **extra):
        full = [
            (i, t, extra.get("lang", "en"), extra.get("source", "s"), len(t or ""), 7, "x", 1.5) for i, t in rows
        ]
        return spark.createDataFrame(full, DOCS + ", count bigint, name string, `offset` double")

    return make
