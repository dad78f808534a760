import pytest
from pyspark.sql import types as T


@pytest.fixture()
def make(spark):
    """A documents table of ``(doc_id, text)`` rows with further columns."""
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])

    def rows(items):
        return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in items], schema)

    return rows
