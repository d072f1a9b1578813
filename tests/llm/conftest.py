import pytest
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


@pytest.fixture(scope="session")
def documents(spark):
    """Documents from (id, text) or (id, text, source)."""

    def make(rows):
        rows = [(*r, "s0")[:3] for r in rows]
        return spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], DOCS)

    return make


@pytest.fixture(scope="session")
def odd_texts():
    """Null, empty, blank, repeated, very long, with control characters and scripts."""
    return [None, "", " ", "\n", "a", "A b\nc\n\nA B \n", "<|endoftext|> x<s>", "é ü ß 中文 ▁ \t x\r\ny", "word " * 5000, "same line\n" * 300, "  two  blanks \n\n", "same line", "same line", "\x00\x1c\x85", "😀 ok"]
