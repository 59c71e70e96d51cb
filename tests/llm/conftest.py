import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def docs(spark):
    """A function from (id, text) pairs to a table like ``documents``."""

    def make(pairs, partitions=3):
        rows = [(i, t, "en", "src0", None if t is None else len(t)) for i, t in pairs]
        return spark.createDataFrame(rows, SCHEMA).repartition(partitions)

    return make


@pytest.fixture(scope="session")
def odd(spark):
    """The same with extra columns whose names operators use inside."""

    def widen(df):
        from pyspark.sql import functions as F

        names = ["uid", "fp", "id", "ident", "word", "gram", "n", "k", "cid", "score", "held_out", "component", "spans", "items", "ids", "base", "y", "x", "__text", "__row", "__hash", "__key", "h", "chunk", "docs"]
        return df.select("*", *(F.lit(i).alias(n) for i, n in enumerate(names)))

    return widen
