import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tests")]


@pytest.fixture(scope="session")
def docs(spark):
    """Nulls, empty and long texts, copies, near copies, repeated rows, a clashing column."""
    base = "the quick brown fox jumps over the lazy dog and then runs far away from home".split()
    long = " ".join(f"{w}{i}" for i in range(3000) for w in ("alpha", "beta"))
    rows = [
        (1, " ".join(base), "a"), (2, " ".join(base), "a"), (2, " ".join(base), "a"),
        (3, " ".join(base).upper(), "b"), (4, None, None), (5, "", "b"), (6, "   \n\t", "c"),
        (7, long, "c"), (8, "one two", "c"), (None, "no number here at all today", None),
        (9, "x" * 5000, "d"), (10, "line one of the shared text\nown words are here too\nline one of the shared text", "d"),
        (11, "Line  one of the SHARED text\nsomething else is written here", "d"), (12, "a\x1cb <|endoftext|> c é", "d"),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, score string")


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, score string")
