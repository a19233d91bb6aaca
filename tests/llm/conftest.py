from __future__ import annotations

import random

import pytest

#: What every operator must take: nulls, empty and wordless texts, ties, repeats, long texts.
ODD = [None, "", " \n\t ", "...", "a", "A a", "日本 語", "x" * 5000, "word " * 3000]


@pytest.fixture(scope="session")
def make(spark):
    """Documents from (doc_id, text) pairs, with extra columns whose names operators might use."""

    def build(rows, schema="doc_id bigint, text string"):
        return spark.createDataFrame(list(rows), schema).selectExpr(
            "*", "'x' AS row", "1 AS id", "'k' AS key", "'t' AS `__text`", "0 AS n", "'s' AS score"
        )

    return build


@pytest.fixture
def vocabulary():
    rng = random.Random(5)
    return ["".join(rng.choice("abcdeéß") for _ in range(rng.randint(1, 7))) for _ in range(400)]


def prose(rng, vocabulary, n):
    return " ".join(rng.choice(vocabulary) for _ in range(n))
