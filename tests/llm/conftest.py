import pytest
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("n_tokens", T.StringType()), T.StructField("component_id", T.StringType())])


@pytest.fixture(scope="session")
def documents(spark):
    """Makes a table of documents from (id, text) or (id, text, lang); two further columns clash with names of results."""

    def make(rows, parts=3):
        rows = [(r[0], r[1], r[2] if len(r) > 2 else None, "s", None if r[1] is None else len(r[1]), "x", "y") for r in rows]
        return spark.createDataFrame(rows, DOCS).repartition(parts)

    return make
