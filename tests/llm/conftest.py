import os

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
LONG = "lorem ipsum dolor sit amet " * 4000


@pytest.fixture(autouse=True)
def workers_find_the_package(spark):
    spark.sparkContext.environment.setdefault("PYTHONPATH", ROOT)


@pytest.fixture(scope="session")
def make(spark):
    """Documents of (doc_id, text, source) with further columns whose names the operators use inside."""

    def build(rows):
        rows = [(*r, "en")[:3] if len(r) < 3 else r for r in rows]
        frame = spark.createDataFrame([(i, t, s, 1, "x", 2.0, None) for i, t, s in rows], "doc_id long, text string, source string, n long, row string, score double, key long")
        return frame.withColumns({"bucket": frame.n, "id": frame.doc_id, "label": frame.row, "u": frame.n, "h": frame.n, "sub": frame.n, "_text": frame.row})

    return build


@pytest.fixture(scope="session")
def odd():
    """Nulls, empty and very long texts, repeated rows and repeated ids."""
    return [(1, None, None), (2, "", "a"), (3, "   \n", "a"), (4, LONG, "b"), (5, "one two", "b"), (5, "one two", "b"), (6, "one two", None), (None, "a null id", "b"), (7, LONG, "a"), (5, "three", "b")]
