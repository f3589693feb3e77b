"""Small frames with the awkward cases every operator must handle."""

from __future__ import annotations

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, content string"


def docs(spark, rows):
    """Documents with extra columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), 9.0, "clash") for i, t in rows], DOCS)


def awkward(spark, *more):
    """Null and empty texts, a null id, repeated rows, one id with two texts, a very long text."""
    rows = [(1, None), (2, ""), (None, "no id here at all"), (3, "same row twice over and over"), (3, "same row twice over and over"), (4, "one text"), (4, "another text"), (5, "long " * 60_000), (6, " \n\t "), *more]
    return docs(spark, rows)


def empty(spark):
    return spark.createDataFrame([], DOCS)


def rows_of(df, *names):
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)
