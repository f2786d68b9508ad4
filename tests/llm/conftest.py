import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(__file__))

from llm_rows import ODD  # noqa: E402


@pytest.fixture(scope="session")
def odd(spark):
    """Odd rows with further columns, some of them named as the operators' own."""
    rows = [(i, t, "x", 1.0, [1]) for i, t in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, id string, score double, items array<int>")


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, id string")
