"""Word and bigram queries over ``documents.text``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.operators import words
from tidemark.plans.tables import table


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return words.text_lines(table(spark, sf_dir, "documents"), "text")


def word_bigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["first", "first_starts", "first_ends", "second", "second_starts", "second_ends"]
    return words.bigrams(_lines(spark, sf_dir)).groupBy(*columns).count().withColumnRenamed("count", "n")


def word_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return words.word_counts(_lines(spark, sf_dir))


def word_predecessors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return words.word_predecessors(_lines(spark, sf_dir))


def word_freq_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return words.word_freq_report(_lines(spark, sf_dir)).orderBy(*words.report_order())


QUERIES = {f.__name__: f for f in (word_bigrams, word_counts, word_predecessors, word_freq_report)}

# Tokens of each line with a NULL at both ends, zipped into neighbours (a, b), with cleaned words (f, w) and marks.
_PAIRS = r"""
lines AS (SELECT unnest(string_split(text, chr(10))) AS line FROM documents),
toks AS (SELECT string_split(rtrim(lower(line), ' '), ' ') AS t FROM lines),
raw AS (
  SELECT unnest(list_concat([NULL::VARCHAR], t)) AS a, unnest(list_concat(t, [NULL::VARCHAR])) AS b FROM toks
),
pairs AS (
  SELECT a, b,
    regexp_replace(a, '^[^a-zA-Z]*|[^a-zA-Z]*$', '', 'g') AS f,
    regexp_replace(b, '^[^a-zA-Z]*|[^a-zA-Z]*$', '', 'g') AS w,
    regexp_matches(a, '^[\x00-\x20]*[^a-zA-Z\x00-\x20]') AS a_starts,
    regexp_matches(a, '[^a-zA-Z\x00-\x20][\x00-\x20]*$') AS a_ends,
    regexp_matches(b, '^[\x00-\x20]*[^a-zA-Z\x00-\x20]') AS b_starts,
    regexp_matches(b, '[^a-zA-Z\x00-\x20][\x00-\x20]*$') AS b_ends
  FROM raw
),
valid AS (SELECT * FROM pairs WHERE (a IS NULL OR f <> '') AND (b IS NULL OR w <> '') AND (a IS NOT NULL OR b IS NOT NULL))
"""

ORACLES = {
    "word_bigrams": f"""
WITH {_PAIRS}
SELECT f AS first, a_starts AS first_starts, a_ends AS first_ends,
       w AS second, b_starts AS second_starts, b_ends AS second_ends, count(*) AS n
FROM valid GROUP BY ALL
""",
    "word_counts": f"WITH {_PAIRS} SELECT f AS word, count(*) AS n FROM valid WHERE a IS NOT NULL GROUP BY f",
    "word_predecessors": f"""
WITH {_PAIRS}
SELECT w AS word, f AS pred, count(*) AS n FROM valid
WHERE a IS NOT NULL AND b IS NOT NULL AND NOT a_ends AND NOT b_starts GROUP BY w, f
""",
    "word_freq_report": f"""
WITH {_PAIRS},
counts AS (SELECT f AS word, count(*) AS n FROM valid WHERE a IS NOT NULL GROUP BY f),
preds AS (
  SELECT w AS word, CASE WHEN a IS NULL OR a_ends OR b_starts THEN '' ELSE f END AS pred, count(*) AS pn
  FROM valid WHERE b IS NOT NULL GROUP BY ALL
),
seen AS (SELECT word, count(*) FILTER (WHERE pred <> '') AS visible FROM preds GROUP BY word)
SELECT n, word, 0::BIGINT AS pred_n, NULL::VARCHAR AS pred, word || ':' || n AS line
FROM counts JOIN seen USING (word)
UNION ALL
SELECT n, word, pn, pred, chr(9) || pred || ':' || pn FROM counts JOIN preds USING (word) WHERE pred <> ''
UNION ALL
SELECT n, word, 0, '', chr(9) FROM counts JOIN seen USING (word) WHERE visible = 0
""",
}
