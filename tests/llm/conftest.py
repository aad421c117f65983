import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

#: Rows with NULLs, empty and blank texts, repeated rows and one long text.
ODD = [
    (1, "One two three four five six."),
    (2, "one two  three four five six."),
    (3, None),
    (4, ""),
    (5, " \n\t "),
    (6, "One two three four five six."),
    (6, "One two three four five six."),
    (None, "One two three four five six."),
    (7, "word " * 6000 + "end"),
    (8, "a\nb\nc"),
    (9, "x"),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Odd rows with extra columns whose names operators use themselves."""
    schema = "doc_id long, text string, n long, id long, digest string, size int, row int, kept boolean, copy_key int, d int, l int"
    return spark.createDataFrame([(*r, 1, 2, "x", 3, 4, False, 5, 6, 7) for r in ODD], schema)


@pytest.fixture(scope="session")
def nothing(odd):
    return odd.limit(0)
