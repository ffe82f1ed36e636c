import pytest

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def rows(docs):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows and columns with clashing names."""
    long = "word " * 30_000 + "tail"
    data = [(1, "a b c d", "en", None, 7), (1, "a b c d", "en", None, 7), (2, None, None, None, None), (None, "x y z", "fr", "s", 5), (3, "", "en", "s", 0), (4, long, "en", "s", len(long)), (5, " \t\n", None, "s", 3), (6, long, "de", "s", 1), (None, None, None, None, None), (7, "A B C D", "en", "s", 7)]
    frame = spark.createDataFrame(data, SCHEMA)
    return frame.selectExpr("*", "1 as fp", "2 as node", "'x' as edges", "3 as words", "4 as ids", "5 as _keep_id")


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
