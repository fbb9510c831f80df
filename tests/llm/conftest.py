import pytest
from pyspark.sql import functions as F

TEXT = "Some plain words of a short text that nothing else repeats, one after another."


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Null ids and texts, blank and long texts, equal rows, and columns named like those that operators make."""
    long = " ".join(f"word{i % 977}x{i % 389}" for i in range(60_000))
    rows = [
        (1, TEXT, "a"), (1, TEXT, "a"), (2, None, "a"), (3, "", "b"), (4, " \n\t ", None), (None, TEXT + " And more.", "b"),
        (None, None, None), (5, long, "c"), (6, "one", "c"), (7, "é ü ß 漢字   x", "c"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for name in ("score", "n", "bucket", "row_id", "_row", "size", "id", "start", "key", "_score", "target", "held_out"):
        docs = docs.withColumn(name, F.lit("other"))
    return docs


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.where("false")
