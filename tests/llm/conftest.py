import pytest
from pyspark.sql.types import LongType, StringType, StructField, StructType

CLASHING = ("_id", "_key", "_sha", "_dropped", "content", "text_key", "n")
DOCS = StructType([StructField("doc_id", LongType()), StructField("text", StringType()), StructField("size", StringType()), StructField("class", StringType()), StructField("row", LongType()), *(StructField(n, LongType()) for n in CLASHING)])


@pytest.fixture(scope="session")
def frame(spark):
    """Documents with extra columns whose names the operators use inside."""
    return lambda rows: spark.createDataFrame([(i, t, "x", "y", 1, *range(len(CLASHING))) for i, t in rows], DOCS)


def edge_rows():
    """Nulls, empty and white-space texts, ties, repeated rows and one very long text."""
    long = " ".join(f"w{i % 977}" for i in range(60_000))
    return [(5, "a b  c"), (3, "a\tb c"), (3, "a\tb c"), (None, "a b c"), (None, "alone"), (7, None), (8, ""), (9, "  \n"), (10, long), (11, long + " end")]
