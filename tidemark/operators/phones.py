"""Which pages mention which phone number."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.phones import phone_numbers
from tidemark.operators.ordering import ranked
from tidemark.session import materialise

URLS_PER_ROW = 10_000


def extract_phones(df: DataFrame, text: str, *keep: str, country: str = "31", digits: int = 9) -> DataFrame:
    """(keep.., num): each number once per text."""
    return df.select(*keep, F.explode(phone_numbers(text, country, digits)).alias("num"))


def phone_index(found: DataFrame, url: str = "url", urls_per_row: int = URLS_PER_ROW) -> DataFrame:
    """(num, part, urls): the URLs of each number in order, each followed by a tab.

    A number has one row (part 0) unless it is on more than ``urls_per_row`` pages; then it has as many rows as it
    needs, and its parts read one after the other are its full list. No list grows without bound.

    The hits are written first: ordering looks at its input twice, and the pages or archives should be read once.
    """
    hits = materialise(found.select("num", F.col(url).alias("url")), "hits")
    placed = ranked(hits, ["url"], keys=["num"], name="pos")
    return (
        placed.groupBy("num", F.floor((F.col("pos") - 1) / urls_per_row).alias("part"))
        .agg(F.array_sort(F.collect_list(F.struct("pos", "url"))).alias("hits"))
        .select("num", "part", F.concat(F.array_join("hits.url", "\t"), F.lit("\t")).alias("urls"))
    )
