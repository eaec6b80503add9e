import pytest


@pytest.fixture(scope="session")
def docs(spark):
    """Rows with every edge case: nulls in each column, empty and blank texts,
    copies, near copies, a long text, repeated rows, clashing names."""
    base = " ".join(f"word{i % 37} tail{i % 11}x{i % 7}" for i in range(120))
    near = base.replace("word5 ", "other5 ", 1)
    rows = [
        (1, base, "a", 0, 7), (2, base, "a", 1, 7), (3, near, "b", 2, 7), (4, "short text", "b", 3, 7), (5, "", "a", 4, 7),
        (6, None, "a", 5, 7), (7, "   \n\t ", None, 6, 7), (None, "a row without an id " * 3, "c", 7, 7), (9, "x " * 4000 + "end", "c", None, None),
        (10, "Quite another text, " + " ".join(f"n{i}" for i in range(200)), "c", 9, 7), (4, "short text", "b", 3, 7),
        (12, "one", "ä", 11, 7), (13, "| # % $ & " * 30, "a", 12, 7), (14, "same line here\n" * 40, "b", 13, 7),
    ]
    return spark.createDataFrame(rows, "doc_id bigint, text string, source string, size int, row_id int")


@pytest.fixture(scope="session")
def empty(docs):
    return docs.limit(0)
