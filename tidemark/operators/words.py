"""Word frequencies and the words that precede each word."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.words import ends_with_mark, has_letter, only_letters, starts_with_mark, strip_edges, tokens
from tidemark.operators.skew import skew_join


def text_lines(df: DataFrame, text: str) -> DataFrame:
    """One row per line of the text column, as ``value``."""
    return df.select(F.explode(F.split(text, "\n", -1)).alias("value"))


def _neighbours(lines: DataFrame, line: str = "value", marks: bool = True) -> DataFrame:
    """Each lower-case token next to the one before it, as ``left`` and ``right``: its word and (with ``marks``) edge marks,
    worked out once per token. NULL stands for the start and for the end of the line."""

    def judged(token: Column) -> Column:
        edges = [starts_with_mark(token).alias("starts"), ends_with_mark(token).alias("ends")] if marks else []
        whole = [F.lit(False).alias("starts"), F.lit(False).alias("ends")] if marks else []
        # most tokens are letters only: one search says all about them
        return F.when(only_letters(token), F.struct(token.alias("word"), *whole, F.lit(True).alias("valid"))).otherwise(
            F.struct(strip_edges(token).alias("word"), *edges, has_letter(token).alias("valid"))
        )

    each = lines.select(F.transform(tokens(F.lower(line)), judged).alias("t"))
    edge = F.lit(None).cast(each.schema["t"].dataType.elementType)
    both = F.arrays_zip(F.array_prepend("t", edge).alias("left"), F.array_append("t", edge).alias("right"))
    pairs = each.select(F.inline(both).alias("left", "right"))
    # a pair counts if both its tokens hold a word (the ends of the line count as words)
    return pairs.filter(
        F.coalesce("left.valid", F.lit(True))
        & F.coalesce("right.valid", F.lit(True))
        & (F.col("left").isNotNull() | F.col("right").isNotNull())
    )


def bigrams(lines: DataFrame, line: str = "value") -> DataFrame:
    """Valid word pairs of each line with their edge marks; stays inside the row, nothing is shuffled.

    ``first`` is NULL at the start of a line and ``second`` is NULL at its end.
    """
    return _neighbours(lines, line).select(
        F.col("left.word").alias("first"),
        F.col("left.starts").alias("first_starts"),
        F.col("left.ends").alias("first_ends"),
        F.col("right.word").alias("second"),
        F.col("right.starts").alias("second_starts"),
        F.col("right.ends").alias("second_ends"),
    )


def word_counts(lines: DataFrame, line: str = "value") -> DataFrame:
    """(word, n): occurrences that are followed by another word or by the end of the line."""
    return (
        _neighbours(lines, line, marks=False)
        .filter(F.col("left").isNotNull())
        .groupBy(F.col("left.word").alias("word"))
        .agg(F.count("*").alias("n"))
    )


def _predecessor():
    """The left word, or '' where a line start or a mark between the two words hides it."""
    hidden = F.col("left").isNull() | F.col("left.ends") | F.col("right.starts")
    return F.when(hidden, F.lit("")).otherwise(F.col("left.word"))


def word_predecessors(lines: DataFrame, line: str = "value") -> DataFrame:
    """(word, pred, n): how often ``pred`` stands right before ``word`` with no mark between them."""
    return (
        _neighbours(lines, line)
        .filter(F.col("left").isNotNull() & F.col("right").isNotNull())
        .filter(~F.col("left.ends") & ~F.col("right.starts"))
        .groupBy(F.col("right.word").alias("word"), F.col("left.word").alias("pred"))
        .agg(F.count("*").alias("n"))
    )


def word_freq_report(lines: DataFrame, line: str = "value") -> DataFrame:
    """Report lines (n, word, pred_n, pred, line): ``word:count``, then a line ``\\tpred:count`` per predecessor.

    One row is one line of the report, so a word with any number of predecessors is never gathered into one value. A
    word whose predecessors are all hidden keeps one empty predecessor line. Sort by ``report_order`` to print it.
    """
    # each pair says two things: its left word occurred, and its right word had this predecessor
    said = _neighbours(lines, line).select(
        F.explode(
            F.array(
                F.struct(F.col("left.word").alias("word"), F.lit(None).cast("string").alias("pred")),
                F.struct(F.col("right.word").alias("word"), _predecessor().alias("pred")),
            )
        ).alias("s")
    )
    tally = (
        said.select("s.*").filter(F.col("word").isNotNull()).groupBy("word", "pred").agg(F.count("*").alias("pred_n"))
    )
    visible = F.col("pred").isNotNull() & (F.col("pred") != "")
    words = (
        tally.groupBy("word")
        .agg(
            F.sum(F.when(F.col("pred").isNull(), F.col("pred_n"))).alias("n"),
            F.count("pred").alias("preds"),
            F.count_if(visible).alias("visible"),
            F.count("*").alias("rows"),
        )
        .filter(F.col("n").isNotNull() & (F.col("preds") > 0))
    )
    joined = skew_join(tally, words, ["word"], weights=words, weight="rows")
    text = (
        F.when(F.col("pred").isNull(), F.format_string("%s:%d", "word", "n"))
        .when(visible, F.format_string("\t%s:%d", "pred", "pred_n"))
        .otherwise(F.lit("\t"))
    )
    return joined.filter(visible | F.col("pred").isNull() | (F.col("visible") == 0)).select(
        "n",
        "word",
        F.when(visible, F.col("pred_n")).otherwise(0).alias("pred_n"),
        "pred",
        text.alias("line"),
    )


def report_order() -> list:
    """Order of the report: frequent words first, ties by word; below a word its predecessors likewise."""
    return [F.desc("n"), F.asc("word"), F.col("pred").isNotNull().asc(), F.desc("pred_n"), F.asc("pred")]
