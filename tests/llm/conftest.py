import pytest
from pyspark.sql import types as T

DOCUMENTS = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())]
)


@pytest.fixture(scope="session")
def documents(spark):
    """Documents of (id, text) pairs, with a column whose name clashes with results."""

    def make(rows, extra=()):
        df = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOCUMENTS)
        for name in extra:
            df = df.selectExpr("*", f"'clash' AS {name}")
        return df

    return make
