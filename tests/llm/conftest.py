from __future__ import annotations

import pytest


@pytest.fixture(scope="session")
def documents(spark):
    """Rows with nulls, empties, ties, repeats, a very long text and clashing extra columns."""
    long = " ".join(f"word{i % 977}" for i in range(40_000))
    rows = [
        (1, None), (2, ""), (3, " \n\t"), (4, "short text"), (5, "short text"), (5, "short text"), (None, "no id here"),
        (6, long), (7, "é ü 漢字 😀 mixed Text, with PUNCTUATION!"), (8, "x" * 5_000),
    ]
    return spark.createDataFrame(rows, "doc_id bigint, text string")
