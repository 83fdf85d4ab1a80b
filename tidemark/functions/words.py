"""Column expressions for words and the marks around them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What counts as a letter, and as a mark at the edge of a token (control characters and spaces around
# the token are trimmed before, so they are no marks).
NON_LETTER_EDGES = r"^[^a-zA-Z]*|[^a-zA-Z]*$"
LETTER = r"[a-zA-Z]"
LETTERS = r"^[a-zA-Z]+\z"
MARK_AT_START = r"^[\x00-\x20]*[^a-zA-Z\x00-\x20]"
MARK_AT_END = r"[^a-zA-Z\x00-\x20][\x00-\x20]*$"


def tokens(line: Column | str) -> Column:
    """Split on single spaces; empty tokens inside the line stay, those at its end do not."""
    return F.split(F.rtrim(line), " ", -1)


def strip_edges(token: Column | str) -> Column:
    """Token without leading and trailing non-letters; marks inside stay (``don't``)."""
    return F.regexp_replace(token, NON_LETTER_EDGES, "")


def clean_word(token: Column | str) -> Column:
    """Lower-case token without leading and trailing non-letters."""
    return strip_edges(F.lower(token))


def has_letter(token: Column | str) -> Column:
    """Whether ``strip_edges`` leaves anything."""
    return F.rlike(token, F.lit(LETTER))


def only_letters(token: Column | str) -> Column:
    """Whether ``strip_edges`` leaves all of it and neither edge is marked."""
    return F.rlike(token, F.lit(LETTERS))


def starts_with_mark(token: Column | str) -> Column:
    return F.rlike(token, F.lit(MARK_AT_START))


def ends_with_mark(token: Column | str) -> Column:
    return F.rlike(token, F.lit(MARK_AT_END))


def edge_flags(token: Column | str) -> Column:
    """STRUCT<starts BOOLEAN, ends BOOLEAN>: a non-letter touches that edge of the token."""
    return F.struct(starts_with_mark(token).alias("starts"), ends_with_mark(token).alias("ends"))
