from __future__ import annotations

import pyarrow.dataset as ds
import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def rows():
    """(doc_id, text, lang) of the smallest documents table."""
    t = ds.dataset(f"{SF}/documents.parquet").to_table(columns=["doc_id", "text", "lang"])
    return list(zip(*(t.column(c).to_pylist() for c in t.column_names), strict=True))


@pytest.fixture(scope="session")
def documents(spark):
    """A frame of (doc_id, text, lang), with columns whose names clash with what operators add."""

    def make(values, parts=3):
        from pyspark.sql import functions as F

        df = spark.createDataFrame([(i, t, lang) for i, t, lang in values], "doc_id long, text string, lang string")
        return df.repartition(parts).withColumns({c: F.lit("x") for c in ("kept", "ids", "fp", "start", "spans", "score", "piece", "next_text", "sketch", "batch", "rows")})

    return make


#: Null and empty texts, a null id, repeated rows, equal texts, white space of all kinds, an undivided long text.
ODD = [
    (None, "no id here but words enough to make several shingles of them all", "en"), (0, None, None), (1, "", "en"), (2, " \t\n ", "en"), (3, "one", "en"), (4, "one", "de"), (5, "a b c d", None),
    (6, "the same row twice, with mail a.b@c.org in it", "en"), (6, "the same row twice, with mail a.b@c.org in it", "en"), (7, "x" * 50_000, "en"), (8, "word " * 20_000, "fr"), (9, "é́　\x1c\U0001f600 \r\n  two    three", "fr"),
    (10, "<|endoftext|> </w> 'tis 12 3.4", "en"), (11, "0" * 5_000 + " 1.2.3.4 +1 (900) 555-2077", "en"),
]


@pytest.fixture(scope="session")
def odd():
    return ODD
