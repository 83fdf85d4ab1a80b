"""Column expressions for film titles like ``Name (2012/I) (V)``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Titles of series start with a quote; films from this year on count.
SERIES_MARK = '"'
MIN_YEAR = 2011


def truncate_title(title: Column) -> Column:
    """The title up to its first ``)``; empty if it has none."""
    return F.when(title.contains(")"), F.concat(F.substring_index(title, ")", 1), F.lit(")"))).otherwise("")


def title_year(title: Column) -> Column:
    """The number in the first four characters after the first ``(``; NULL if they are none."""
    inside = F.substring_index(F.substr(title, F.instr(title, "(") + 1), ")", 1)
    return F.left(inside, F.lit(4)).try_cast("int")
