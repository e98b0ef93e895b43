import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def odd_documents(spark):
    """Nulls in every column, empty and long texts, repeated rows and ids, a clashing extra column."""
    long = "alpha beta gamma delta " * 4000
    rows = [(1, "", None, "a", 5), (2, None, "en", None, 6), (3, long, "en", "a", 7), (4, long, "en", "b", 8), (4, long, "en", "b", 8), (5, " \n\t ", None, None, None), (6, "x", "fr", "c", 1), (7, "x", "fr", "c", 1), (7, "other words here", "fr", "c", 1), (8, "é" * 50 + "\n" + "ß ü 日本語 " * 20, "de", "c", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, line int")


@pytest.fixture(scope="session")
def odd(spark):
    return odd_documents(spark)


@pytest.fixture(scope="session")
def none(spark):
    return odd_documents(spark).limit(0)
