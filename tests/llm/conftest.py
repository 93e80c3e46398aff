import pytest

#: Null, empty, blank, long, repeated and tied rows; extra columns whose names operators use inside.
LONG = " ".join(f"word{i % 977} and, {i}." for i in range(30_000))
EDGE_TEXTS = [None, "", "   \n\t ", "one", "same text here", "same text here", "ünïcödé 日本語 😀 İstanbul",
              "a  b   c \n\n d \n", "x" * 5000, "1" * 3000, "a@" * 500, LONG]


@pytest.fixture
def edge_docs(spark):
    rows = [(i, t, "en", "s", len(t or ""), "clash", 1, 2) for i, t in enumerate(EDGE_TEXTS)]
    rows += [rows[4], (None, "null id", None, None, None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, "
                                       "file_no string, piece int, fp int")


@pytest.fixture
def no_docs(edge_docs):
    return edge_docs.where("false")
