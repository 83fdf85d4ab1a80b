"""Language of a text by trigram profiles: one trigram around every letter, compared with those of known texts."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.positions import div
from tidemark.functions.social import script_override, strip_social
from tidemark.operators.ordering import ranked
from tidemark.operators.skew import SMALL_BYTES, lookup_join
from tidemark.session import materialise, size_of


BLOCK = 8  # languages whose counts are summed side by side
COUNTS = [f"n{i}" for i in range(BLOCK)]
NO_LETTERS = r"[^\p{L}]+"


def _words(df: DataFrame, text: str | Column, *keep: str | Column) -> DataFrame:
    """One row per run of letters, in lower case, as ``word``."""
    text = F.col(text) if isinstance(text, str) else text
    return df.select(*keep, F.explode(F.split(F.lower(text), NO_LETTERS)).alias("word")).filter(F.col("word") != "")


def _trigrams(words: DataFrame, *keep: str) -> DataFrame:
    """One row per letter of a word: itself with its neighbours as ``trigram``, ``_`` standing for the edge of a word."""
    marked = F.concat(F.lit("_"), "word", F.lit("_"))
    around = F.transform(F.sequence(F.lit(1), F.length("word")), lambda i: F.substring(marked, i, F.lit(3)))
    return words.select(*keep, F.explode(around).alias("trigram"))


def lang_profiles(df: DataFrame, text: str, lang: str = "lang", top: int | None = None) -> DataFrame:
    """(lang, trigram, n): how often each trigram occurs in each language; with ``top`` only its most frequent ones.

    There are as many trigrams as the alphabets allow, whatever the size of the texts. Words are counted first, so only the
    distinct ones of a language are cut into trigrams.
    """
    words = _words(df, text, F.col(lang).alias("lang")).groupBy("lang", "word").agg(F.count("*").alias("times"))
    counts = _trigrams(words, "lang", "times").groupBy("lang", "trigram").agg(F.sum("times").alias("n"))
    if top is None:
        return counts
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "trigram")
    return counts.withColumn("_nth", F.row_number().over(order)).filter(F.col("_nth") <= top).drop("_nth")


@dataclass
class Profiles:
    """Profiles as texts are compared with them, written once: for each trigram the numbers of its languages and its counts
    there, and for each language its number and totals."""

    by_trigram: DataFrame
    totals: DataFrame


def prepare_profiles(profiles: DataFrame) -> Profiles:
    """To be done once for any number of ``detect_lang``, as in a stream."""
    profiles = materialise(profiles.filter(F.col("lang").isNotNull() & F.col("trigram").isNotNull()), "profiles")
    sums = profiles.groupBy("lang").agg(F.sum("n").alias("total"), F.sum(F.col("n") * F.col("n")).alias("squares"))
    totals = materialise(ranked(sums, ["lang"], name="number").withColumn("number", F.col("number") - 1), "totals")
    numbered = _joined(profiles, totals.select("lang", "number"), ["lang"])
    by_trigram = numbered.groupBy("trigram").agg(F.collect_list(F.struct("number", "n")).alias("langs"))
    return Profiles(materialise(by_trigram, "by-trigram"), totals)


def _joined(left: DataFrame, table: DataFrame, on: Sequence[str]) -> DataFrame:
    """With a written table: broadcast if its files are small."""
    return left.join(F.broadcast(table), list(on)) if size_of(table) <= SMALL_BYTES else lookup_join(left, table, on)


def _dots(words: DataFrame, by: str, ready: Profiles) -> DataFrame:
    """(by, block, n0, n1 ..): the counts that languages have for the trigrams of these words, summed; a row for each
    ``BLOCK`` languages in order of their numbers, NULL for those without any."""
    met = _joined(_trigrams(words, by), ready.by_trigram, ["trigram"]).select(by, F.inline("langs").alias("number", "n"))
    place = F.col("number") % BLOCK
    counts = [F.sum(F.when(place == i, F.col("n"))).alias(c) for i, c in enumerate(COUNTS)]
    return met.groupBy(by, div("number", BLOCK).alias("block")).agg(*counts)


def detect_lang(df: DataFrame, key: str, text: str | Column, profiles: DataFrame | Profiles) -> DataFrame:
    """(key, detected, distance): the language whose profile is nearest to the trigram frequencies of the text.

    The squared distance between frequency vectors is |t|^2 + |p|^2 - 2 t.p; |t| does not depend on the language, so
    ``distance`` is |p|^2 - 2 t.p. A language that shares no trigram with the text is at |p|^2; of these only the nearest
    can be the answer, so a text is compared with those it shares trigrams with and with that one. Texts with the same
    key count as one. NULL where the text has no letters.
    """
    once = isinstance(profiles, DataFrame)
    ready = prepare_profiles(profiles) if once else profiles
    text = F.col(text) if isinstance(text, str) else text
    letters = F.coalesce(F.length(F.regexp_replace(F.lower(text), NO_LETTERS, "")), F.lit(0))
    texts = df.groupBy(key).agg(F.sum(letters).alias("letters"))
    words = _words(df, text, key).filter(F.col(key).isNotNull())
    if once:  # t.p of a text is the sum of that of its words, so each distinct word is cut into trigrams once
        scores = materialise(_dots(words.select("word").distinct(), "word", ready), "word-scores")
        blocks = _joined(words, scores, ["word"]).groupBy(key, "block").agg(*[F.sum(c).alias(c) for c in COUNTS])
    else:  # few texts at a time, for which nothing is written
        blocks = _dots(words, key, ready)
    each = blocks.select(key, "block", F.posexplode(F.array(*COUNTS)).alias("place", "dot")).filter(F.col("dot").isNotNull())
    dots = each.select(key, (F.col("block") * BLOCK + F.col("place")).alias("number"), "dot")
    square = F.col("squares") / (F.col("total").cast("double") * F.col("total").cast("double"))
    lone = ready.totals.agg(F.min(F.struct(square.alias("distance"), "lang")).alias("v")).scalar()
    found = _joined(dots.join(texts, key), ready.totals, ["number"])
    distance = square - F.lit(2.0) * F.col("dot") / (F.col("letters").cast("double") * F.col("total").cast("double"))
    nearest = found.groupBy(key).agg(F.min(F.struct(distance.alias("distance"), "lang")).alias("best"))
    best = F.when(F.col("letters") > 0, F.least(F.coalesce("best", lone), lone))
    judged = texts.join(nearest, key, "left").select(key, best.alias("best"))
    return judged.select(key, F.col("best.lang").alias("detected"), F.col("best.distance").alias("distance"))


def posts_in(
    posts: DataFrame, text: str, profiles: DataFrame | Profiles, langs: Sequence[str] = ("en", "no")
) -> DataFrame:
    """Posts in one of these languages, with ``lang``: guessed without mentions and links, corrected by script.

    Each distinct text is judged once and every post with it gets its language, however often it is repeated.
    """
    cleaned = strip_social(text)
    hashed = posts.withColumn("_text", F.sha2(F.coalesce(cleaned, F.lit("")), 256))
    texts = hashed.groupBy("_text").agg(F.any_value(cleaned).alias("cleaned"))
    guessed = detect_lang(texts, "_text", "cleaned", profiles).join(texts, "_text")
    judged = guessed.select("_text", script_override("detected", "cleaned").alias("lang"))
    return hashed.join(keep_languages(judged, langs), "_text").drop("_text")


def keep_languages(df: DataFrame, langs: Sequence[str] = ("en", "no"), lang: str = "lang") -> DataFrame:
    return df.filter(F.col(lang).isin(*langs))
