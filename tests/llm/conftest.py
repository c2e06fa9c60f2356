import random

import pytest

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and white texts, repeats, ties, a very long text, and columns with clashing names."""
    rng = random.Random(1)
    long = " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "été", "日本"]) + str(rng.randint(0, 50)) for _ in range(60_000))
    base = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen"
    rows = [(1, None, None, None), (2, "", "a", "x"), (3, " \n\t ", "a", "x"), (4, base, "a", "x"), (5, base.replace(" two ", "  two\n"), "b", None), (6, base.upper(), "b", "x"), (7, base + " eighteen", "b", "x"), (8, "short text", None, "x"), (9, "short   text", "a", "x"), (9, "short   text", "a", "x"), (10, long, "a", "x"), (11, long + " end", "a", "x"), (None, "no id here", "a", "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").selectExpr("*", "doc_id AS key", "text AS recipe", "source AS position", "1 AS score", "1 AS n", "doc_id AS a", "doc_id AS id", "0 AS label")
