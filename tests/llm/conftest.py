"""Small tables of awkward rows shared by the operators' tests."""

import pytest
from pyspark.sql import types as T

#: Null text, empty, blank, short, repeated rows, odd bytes, a very long text.
TEXTS = [None, "", "  \n\t ", "one two three", "one two three", "Fünf Wörter sind nicht viel hier.",
         "a\x00b \\### <x> ▁ </turn> 中文 \U0001F600", "the same line again and again\n" * 6,
         "word " * 30_000, "x" * 50_000, "tail words that end this small table of texts here"]


@pytest.fixture(scope="session")
def awkward(spark):
    """documents with extra columns whose names clash with the operators' own."""
    schema = T.StructType([
        T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()), T.StructField("row", T.StringType()),
        T.StructField("out", T.LongType()), T.StructField("shard", T.LongType()),
        T.StructField("n", T.StringType()), T.StructField("id", T.StringType())])
    rows = [(i, t, ["en", "de", None][i % 3], None, len(t) if t else None, "r", i, 7, "n", "i")
            for i, t in enumerate(TEXTS)]
    rows.append((None, "a text without an id but with words enough to count", None, None, None, None, None, None, None, None))
    rows.append(rows[5])  # a repeated row
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="session")
def no_rows(awkward):
    return awkward.limit(0)


@pytest.fixture(scope="session")
def labels(spark):
    rows = [(i, i % 2, 0) for i in range(len(TEXTS))] + [(3, 1, 1), (99, None, None), (None, 1, 0)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
