"""Cast records: an actor, then tab-separated titles over several lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.titles import MIN_YEAR, SERIES_MARK, title_year, truncate_title


def parse_cast_record(records: DataFrame, is_male: bool, min_year: int = MIN_YEAR) -> DataFrame:
    """(actor, is_male, movie): one row per film of the record (``value``), repeats included.

    Series are left out, titles are cut after their first ``)``, and films without a year from ``min_year`` on are
    dropped; so are actors with no film left. A ``)`` before the year hides the year.
    """
    parts = F.filter(F.transform(F.split("value", "\t"), lambda p: F.replace(p, F.lit("\n"), F.lit(""))), lambda p: p != "")
    rows = records.select(parts.alias("parts")).filter(F.size("parts") > 1)
    titles = rows.select(
        F.get("parts", F.lit(0)).alias("actor"),
        F.explode(F.slice("parts", F.lit(2), F.size("parts") - 1)).alias("title"),
    )
    films = titles.filter(~F.col("title").startswith(SERIES_MARK)).select("actor", truncate_title(F.col("title")).alias("movie"))
    return films.filter(title_year(F.col("movie")) >= min_year).select("actor", F.lit(is_male).alias("is_male"), "movie")


def parse_casts(males: DataFrame, females: DataFrame, min_year: int = MIN_YEAR) -> DataFrame:
    """Films of both sexes."""
    return parse_cast_record(males, True, min_year).unionByName(parse_cast_record(females, False, min_year))
