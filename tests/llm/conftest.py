import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, lang_pred string, item_ids string, copies int, rows int, range int"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and very long texts, repeated rows, ties, clashing extra columns."""
    long = "the rain in spain falls mainly on the plain and so on. " * 4000
    rows = [
        (1, None, "en", "a"), (2, "", "en", "a"), (3, "  \n\t ", None, "b"), (4, "123 456 !!!", "en", None), (5, long, "en", "a"),
        (6, "the same words are here for all of us to read today", "en", "b"), (6, "the same words are here for all of us to read today", "en", "b"),
        (7, "the same words are here for all of us to read today", "en", "b"), (None, "a row without any id at all", "en", "b"), (8, "der hund und die katze sind im haus", "de", "c"), (9, "x", None, None),
    ]
    return spark.createDataFrame([(*r, 0, 0.5, "zz", "q", 1, 2, 3) for r in rows], SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
