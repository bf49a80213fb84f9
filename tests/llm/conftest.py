import random

import pytest

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def make(spark):
    """Frames of (doc_id, text) or (doc_id, text, lang, source), with the columns of documents and clashing extra ones."""

    def docs(rows, extra=True):
        full = [(r[0], r[1], *(r[2:4] if len(r) > 2 else ("en", "src0")), len(r[1] or "")) for r in rows]
        frame = spark.createDataFrame(full, DOCS)
        if extra:
            frame = frame.selectExpr("*", "'x' AS key", "1 AS slot", "2L AS score", "'y' AS row", "'z' AS `class`", "3 AS _part", "4 AS n_links", "5 AS lang_pred")
        return frame

    return docs


@pytest.fixture(scope="session")
def prose():
    """A function from a seed and a number of words to invented prose."""

    def text(seed: int, n: int) -> str:
        rng = random.Random(seed)
        syllables = ["ta", "mo", "rel", "ing", "quo", "ver", "du", "ness", "ark", "ol", "pri", "the"]
        return " ".join("".join(rng.choices(syllables, k=rng.randint(1, 4))) for _ in range(n))

    return text


@pytest.fixture(scope="session")
def odd(prose):
    """Rows that every operator must take: nulls, empty and very long texts, repeated rows, text without words."""
    return [
        (1, None), (2, ""), (3, prose(1, 40_000)), (4, prose(2, 60)), (4, prose(2, 60)), (5, prose(2, 60)), (None, prose(3, 30)),
        (None, None), (6, " \n\t "), (7, "x"), (8, "漢字 😀 é ñ ▁ a▁b"), (9, "ab" * 30_000),
    ]
