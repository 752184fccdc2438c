"""Small tables with the awkward cases that every operator must stand."""

from __future__ import annotations

import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
SHARED = "This line of text stands in many documents.\n"


def prose(seed: int, words: int) -> str:
    rng = random.Random(seed)
    vocabulary = ["the", "of", "and", "to", "is", *("".join(rng.choices("abdefgiklmnoprstu", k=rng.randint(2, 8))) for _ in range(200))]
    return " ".join(rng.choice(vocabulary) for _ in range(words))


@pytest.fixture(scope="session")
def rows():
    """Nulls, empty and very long texts, copies, near copies, ties, repeated rows, null ids."""
    base = prose(1, 120)
    out = [
        (0, base, "en", "a", None),
        (1, base, "en", "a", None),
        (2, base.replace("the", "a", 1), "en", "a", None),
        (3, None, None, None, None),
        (4, "", "en", "a", 0),
        (5, " \t\n ", "en", None, 4),
        (6, "word", "en", "a", 4),
        (7, SHARED + prose(7, 60) + "\n" + SHARED, "en", "a", None),
        (8, SHARED.upper() + prose(8, 60), "en", "a", None),
        (9, "  " + SHARED + prose(9, 40), "de", "b", None),
        (10, prose(10, 6000), "en", "b", None),
        (10, prose(10, 6000), "en", "b", None),
        (11, "Größe Ärger Übel été ça Ñandú привет 你好 " * 30, "de", "b", None),
        (11, "another text with the id of the last one", "en", "b", None),
        (None, prose(12, 50), "en", "b", None),
        (None, SHARED + prose(13, 50), "fr", "b", None),
        (14, "12345 67890 !!! ???", "en", "b", None),
    ]
    return out + [(20 + i, prose(100 + i % 7, 30 + i % 11), ("en", "fr", "de")[i % 3], "c", None) for i in range(60)]


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(3).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
