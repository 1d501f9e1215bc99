from __future__ import annotations

import pytest


@pytest.fixture(scope="session")
def docs_schema():
    return "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture()
def make_docs(spark, docs_schema):
    """Documents from (doc_id, text) pairs."""

    def make(rows):
        return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], docs_schema)

    return make


@pytest.fixture()
def awkward(make_docs):
    """Nulls, empty and very long texts, ties, repeated rows; clashing columns."""
    from pyspark.sql import functions as F

    rows = [(1, None), (2, ""), (3, "   \n\t "), (4, "alpha beta gamma. " * 30_000), (5, "Same words here."), (5, "Same words here."), (6, "Same words here."), (None, "An unnamed text of seven plain words."), (7, "…!?\u0000 ")]
    df = make_docs(rows)
    for c in ("id", "bucket", "score", "a", "b", "path", "hash", "label", "words"):
        df = df.withColumn(c, F.lit(c))
    return df
