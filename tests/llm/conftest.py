import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture
def odd(spark):
    """Rows with extra columns whose names clash with those that operators make."""
    from llm_rows import ROWS

    return spark.createDataFrame([(*r, 1, "n", "k", True) for r in ROWS], "doc_id long, text string, shard int, n_lines string, key string, kept boolean")


@pytest.fixture
def none(odd):
    return odd.filter("false")
