import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, node long, ids string, label string"


def odd_documents(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, and extra columns whose names clash."""
    prose = "the quick brown fox jumps over the lazy dog and runs away from the hunter in the wood"
    rows = [
        (1, prose, "en", "a", 10, 0.5, 1, "x", "y"), (2, prose, "en", "a", 10, 0.5, 1, "x", "y"), (2, prose, "en", "a", 10, 0.5, 1, "x", "y"),
        (3, None, None, None, None, None, None, None, None), (None, prose + " today", "en", None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None),
        (4, "", "en", "a", 0, None, None, "", ""), (5, "   \n\t ", "en", "a", 0, None, None, "", ""), (6, "one", "en", "b", 3, None, None, "", ""),
        (7, "z" * 200_000, "en", "b", 200_000, None, None, "", ""), (8, "word " * 60_000, "en", "b", 1, None, None, "", ""), (9, "😀 é ‍ \x00 नेपाल\r\n<|endoftext|>", "de", "b", 1, None, None, "", ""),
    ]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="session")
def odd(spark):
    return odd_documents(spark).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 0, 1), (2, 0, 1), (6, None, None), (None, 1, 1), (99, 1, 0)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="session")
def no_labels(spark):
    return spark.createDataFrame([], "doc_id long, quality int, toxic int")
