from __future__ import annotations

import random

import pytest

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long, fp long, score double"


@pytest.fixture(scope="session")
def prose():
    """Made-up sentences, the same for one seed."""

    def make(seed: int, words: int, vocabulary: int = 400) -> str:
        pick = random.Random(seed)
        stems = random.Random(1)
        known = ["".join(stems.choice("aeiounrstlm") for _ in range(stems.randint(2, 8))) for _ in range(vocabulary)]
        text = [pick.choice(known) + pick.choice(["", "", "", ",", "."]) for _ in range(words)]
        lines = [" ".join(text[i : i + 15]) for i in range(0, words, 15)]
        return "\n".join(lines)

    return make


@pytest.fixture(scope="session")
def documents(spark, prose):
    """Rows of ``documents`` with two further columns whose names operators use inside."""

    def make(rows):
        full = [(i, t, lang, source, None if t is None else len(t), 7, 0.5) for i, t, lang, source in rows]
        return spark.createDataFrame(full, DOCUMENTS)

    return make


@pytest.fixture(scope="session")
def messy(documents, prose):
    """Nulls in any column, empty and long texts, ties, and repeated rows."""
    long = prose(99, 30_000)
    rows = [(i, prose(i, 60 + i), "en" if i % 2 else "fr", f"s{i % 3}") for i in range(40)]
    rows += [(100, None, None, None), (101, "", "en", None), (102, " \n\t ", None, "s1")]
    rows += [(103, long, "en", "s1"), (104, long, "fr", None), (None, prose(1, 61), "en", "s1")]
    rows += [(105, rows[3][1], "en", "s0")] * 2 + [(None, None, None, None)]
    return documents(rows)


@pytest.fixture(scope="session")
def empty(documents):
    return documents([])
