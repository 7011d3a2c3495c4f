"""Small frames of awkward rows, and plain Python versions of what the operators compute."""

from __future__ import annotations

import hashlib

DOCS = "doc_id long, text string, source string, lang string, KEPT string, size string"

LONG = " ".join(f"w{i % 977}x{i % 13}" for i in range(60_000))


def docs(spark, rows):
    """rows: (doc_id, text, source, lang); two more columns have names that operators add."""
    return spark.createDataFrame([(*r, "mine", "mine") for r in rows], DOCS)


AWKWARD = [
    (1, "a b c d e", "s1", "en"),
    (2, "a b c d e", "s1", "en"),
    (3, None, "s2", None),
    (4, "", "s2", "en"),
    (5, " \t\n ", None, "de"),
    (6, LONG, "s1", "en"),
    (7, LONG, None, "en"),
    (8, "a b c d e", None, "en"),
    (8, "a b c d e", None, "en"),
    (None, "lonely row", "s3", "en"),
    (None, None, None, None),
    (9, "Über   \x1c Straße \U0001f600 <|endoftext|>", "s3", "de"),
]


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()
