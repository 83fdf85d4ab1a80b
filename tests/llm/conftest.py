import random

import pytest

SYLLABLES = ["tha", "re", "on", "ing", "er", "st", "and", "ou", "le", "mi", "ka", "zo"]


def words(draw, n):
    return " ".join("".join(draw.choice(SYLLABLES) for _ in range(draw.randint(1, 3))) for _ in range(n))


@pytest.fixture(scope="module")
def odd_docs(spark):
    """Documents with nulls in every column, repeated rows, ties, empty and long texts, and columns named like those that operators use."""
    draw = random.Random(5)
    base = words(draw, 80)
    rows = [
        (1, "the same text here again", "en"),
        (2, "the same text here again", "en"),
        (2, "the same text here again", "en"),
        (None, "the same text here again", None),
        (None, None, None),
        (3, None, "en"),
        (4, "", None),
        (5, " \t\n ", "en"),
        (6, "one", "de"),
        (7, "one", "de"),
        (8, base, "en"),
        (9, base + " tail", "en"),
        (10, words(draw, 20_000), "en"),
        (11, "x" * 5000, None),
        (12, "12345 67 !!", "fr"),
        (None, "nobody's text, with words of its own", "en"),
    ]
    schema = "doc_id long, text string, lang string, source string, n_chars long, _id string, _text int, gram int, node int, row int, sha int, link int, word int"
    return spark.createDataFrame([(*r, None, None, "x", 1, 2, 3, 4, 5, 6, 7) for r in rows], schema).coalesce(2)


@pytest.fixture(scope="module")
def no_docs(odd_docs):
    return odd_docs.where("doc_id = -1")
