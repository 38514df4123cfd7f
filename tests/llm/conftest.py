import random

import pytest
from llm_helpers import CLASHING, prose

@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and very long texts, ties, repeated rows, and columns whose names clash."""
    draw = random.Random(3)
    base = prose(draw, 60)
    rows = [(1, base, "a"), (1, base, "a"), (2, None, "a"), (3, "", None), (None, base, "b"), (4, prose(draw, 60_000), "b"), (5, " \t\n ", None), (6, "one", "b"), (7, base.upper(), None), (8, None, None)]
    extra = ", ".join(f"{c} string" for c in CLASHING)
    return spark.createDataFrame([(*r, *("x" for _ in CLASHING)) for r in rows], f"doc_id long, text string, source string, {extra}")


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.where("false")
