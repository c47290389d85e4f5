import pytest

from flowtrace.llm.common import ASCII_SPACE  # noqa: F401


@pytest.fixture()
def docs(spark):
    """Rows with nulls, empty and long texts, repeated rows and clashing column names."""
    long = " ".join(f"word{i % 997}" for i in range(30_000))
    rows = [(1, "the cat sat on the mat and the dog lay on the rug in the sun " * 5, "en", "a", "x"),
            (2, None, None, None, "x"), (3, "", "en", "a", "x"), (None, "no id here at all", "en", "b", "x"),
            (5, long, "en", "a", "x"), (6, "one line\nand more\none line\n", "en", "a", "x"),
            (7, "tie tie tie", None, "a", "x"), (7, "tie tie tie", None, "a", "x")]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, ids string")


@pytest.fixture()
def no_docs(docs):
    return docs.filter("false")
