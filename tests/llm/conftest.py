import pytest
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark():
    own = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.driver.memory", "6g").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    own.sparkContext.setLogLevel("ERROR")
    return own


DOCS = "doc_id long, text string, lang string, source string, n_chars long, shard string, score string"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty, very long and repeated texts, clashing extra columns."""
    long = " ".join(f"w{i % 997} thing" for i in range(30_000))
    rows = [
        (1, "the quick brown fox jumps over the lazy dog", "en", "a", 43, "x", "y"), (2, "", "en", "a", 0, None, None), (3, None, None, None, None, None, None), (4, long, "de", "b", len(long), "x", "y"),
        (5, "the quick brown fox jumps over the lazy dog", "en", "b", 43, "x", "y"), (5, "the quick brown fox jumps over the lazy dog", "en", "b", 43, "x", "y"), (None, "no key here at all", "en", None, 18, "x", "y"), (7, "\n \t\n", "fr", "", 4, "x", "y"),
    ]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def small(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
