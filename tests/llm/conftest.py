from __future__ import annotations

import pytest

DOCUMENTS = "doc_id bigint, text string, lang string, source string, n_chars bigint, n_words string, fp string, score string, spans string, key string, doc string"

PHRASE = "the quick brown fox jumps over the lazy dog while seven wise owls watch from the old oak tree near a quiet river bank"


def rows(*texts: tuple[int | None, str | None]) -> list[tuple]:
    """Documents with extra columns whose names operators use themselves."""
    return [(i, t, "en", "s", None if t is None else len(t), "x", "x", "x", "x", "x", "x") for i, t in texts]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and very long texts, ties, repeated rows and near copies."""
    long = " ".join(f"w{k % 997}q{k % 31}" for k in range(30_000))
    return spark.createDataFrame(
        rows(
            (1, PHRASE), (2, PHRASE), (2, PHRASE), (3, PHRASE + " and more words follow here"), (4, None), (5, ""), (6, " \t\n "), (7, long), (8, long[1000:90_000]),
            (9, "a" * 5000), (10, "a" * 5000 + "b"), (11, "mail me at a.b@example.org or +1 (555) 010-9999, card 4111 1111 1111 1111"), (12, "ÄÖÜ ▁ 日本語 emoji 😀\x00 end"), (None, PHRASE), (None, None), (13, "x y"),
        ),
        DOCUMENTS,
    )


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCUMENTS)
