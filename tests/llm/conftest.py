import pytest

from sensorspark.llm.common import prepare

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, n_words string, mix string"
LABELS = "doc_id bigint, quality int, toxic int"
LONG = " ".join(f"word{i % 977}" for i in range(60_000))


@pytest.fixture(autouse=True)
def _prepared(spark):
    prepare(spark)


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, clashing extra columns."""
    plain = "The quick brown fox jumps over the lazy dog near the quiet river bank today . " * 8
    rows = [
        (1, plain, "en", "src1", 1, "x", "m"),
        (1, plain, "en", "src1", 1, "x", "m"),
        (2, plain, "en", "src2", 1, "x", "m"),
        (None, plain, "en", "src2", 1, None, None),
        (None, None, None, None, None, None, None),
        (4, "", "de", "src3", 0, "", ""),
        (5, None, "de", None, None, "y", "m"),
        (6, " \n\t ", None, "web", 4, "y", "m"),
        (7, LONG, "fr", "src7", len(LONG), "y", "m"),
        (8, "one", "fr", "src7", 3, "y", "m"),
        (9, "a@b.io 10.0.0.1 +49 30 1234567 4111 1111 1111 1111 🙂 x@y.co", "es", "src9", 9, "z", "m"),
    ]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def no_labels(spark):
    return spark.createDataFrame([], LABELS)
