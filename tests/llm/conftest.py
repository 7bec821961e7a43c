import pytest
from pyspark.sql import types as T

SCHEMA = T.StructType([T.StructField(n, t) for n, t in (("doc_id", T.LongType()), ("text", T.StringType()), ("lang", T.StringType()), ("source", T.StringType()), ("n_chars", T.LongType()))])


@pytest.fixture(scope="session")
def documents(spark):
    """A maker of documents tables from (doc_id, text) pairs; `extra` adds columns whose names the operators use themselves."""

    def make(pairs, extra=False):
        df = spark.createDataFrame([(i, t, None, None, None) for i, t in pairs], SCHEMA)
        if extra:
            for name in ("h", "n", "k", "k1", "score", "predicted", "component", "shard", "spans", "batch", "_row", "_d", "_h", "bucket", "length", "own", "found", "rank"):
                df = df.withColumn(name, df.doc_id.cast("string"))
        return df

    return make


@pytest.fixture(scope="session")
def odd():
    """Nulls, empty and blank texts, repeated rows, ties, a long text, and separators that only look like spaces."""
    long = " ".join(f"w{i % 977}x{i % 13}" for i in range(30_000))
    return [(1, None), (2, ""), (3, " \t\n "), (4, "one"), (5, "one two three four five six"), (5, "one two three four five six"), (6, "one two three four five six"), (None, "one two three four five six"), (7, "a b c d"), (8, long), (9, long + " end"), (None, None), (10, "İstanbul ẞ \U0001f600 K"), (11, "one " * 500)]
