"""Small tables that hold what every operator has to take."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, h string"


def words(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}x{rng.randrange(7)}" for _ in range(n))


def hard_documents(spark, rows=()):
    """Nulls in every column, empty, blank and very long texts, ties, repeated rows and
    columns whose names clash with an operator's own."""
    rng = random.Random(5)
    long = words(rng, 30_000, 5000)
    base = words(rng, 120)
    out = [
        (1, "", "en", "a", 0, 1, "x"),
        (2, None, None, None, None, None, None),
        (3, " \t\n ", "en", "a", 4, 1, "x"),
        (4, "One", "en", "a", 3, 1, "x"),
        (5, base, "en", "a", 9, 1, "x"),
        (6, base, "fr", "b", 9, 1, "x"),
        (6, base, "fr", "b", 9, 1, "x"),
        (7, base + " more", "fr", "b", 9, 1, "x"),
        (8, long, "de", "b", 9, 1, "x"),
        (9, "é日本 🤦🏽‍♀️ <|endoftext|> don't CAN'T", "de", "b", 9, 1, "x"),
        (10, "x" * 5000, "de", "b", 9, 1, "x"),
        (11, "12 34 !?", None, "b", 9, 1, "x"),
        (-7, words(rng, 50), None, "b", 9, 1, "x"),
    ]
    return spark.createDataFrame(out + list(rows), SCHEMA)


def no_documents(spark):
    return spark.createDataFrame([], SCHEMA)
