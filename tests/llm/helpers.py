"""Small tables for the operators' tests."""

from __future__ import annotations

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng: random.Random, words: int, vocabulary: int = 400) -> str:
    return " ".join(f"w{rng.randrange(vocabulary)}x" for _ in range(words))


def changed(rng: random.Random, text: str, words: int) -> str:
    out = text.split(" ")
    for _ in range(words):
        out[rng.randrange(len(out))] = f"new{rng.randrange(10**6)}"
    return " ".join(out)


def table(spark, rows, schema=DOCS):
    """Rows as given; short rows are filled with nulls."""
    width = len(schema.split(", "))
    return spark.createDataFrame([tuple(r) + (None,) * (width - len(r)) for r in rows], schema)


def edge_rows() -> list[tuple]:
    """Nulls in every column, empty and blank texts, repeated rows and a very long text."""
    rng = random.Random(5)
    long = prose(rng, 40_000, 10**6)
    return [
        (None, "one two three four five six", "en", "a", 27), (None, None, None, None, None), (1, None, None, "a", None), (2, "", "en", None, 0),
        (3, " \t\n", "de", "b", 3), (4, "word", "en", "a", 4), (5, "word", "en", "a", 4), (4, "word", "en", "a", 4), (6, long, "en", "a", len(long)),
        (7, long + " tail", "en", "a", len(long) + 5), (8, "Ünï cödé 漢字 \U0001F600 text of some words here", "fr", "c", 40),
    ]
