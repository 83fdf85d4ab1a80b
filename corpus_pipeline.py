"""Documents made ready for training, stage by stage: toxic ones go, then those without a language, then exact and near
copies; what is left is packed into sequences.

A stage takes the documents that the one before it kept, as a table, and returns those that it keeps, with the same columns;
the last returns the packed pieces. Models are learned on the stage's own input, never from rows that are held out.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import exact_dedup, jaccard_join, language_id, packing, toxicity
from tidemark.llm.common import held_out
from tidemark.session import materialise

TOKENIZER = "word_bpe_49k.json"


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score stays below the threshold. A null text counts as empty; rows with null or repeated ids are judged
    like all others. Without labels of both kinds nothing goes."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held_out(F.col("doc_id")))
    lexicon = toxicity.learn_lexicon(toxicity.labelled_sample(docs, labels))
    score = toxicity.scorer(lexicon)(F.coalesce("text", F.lit("")))["score"]
    return docs.where(score < toxicity.THRESHOLD)


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language: those without a letter go (a null text has none), and those for which two languages are as
    good as even. Rows with null or repeated ids are judged like all others; no documents give none."""
    sample = language_id.labelled_sample(docs.where(~held_out(F.col("doc_id"))))
    found = language_id.predictor(language_id.learn_languages(sample))(F.coalesce("text", F.lit("")))
    return docs.where(~found["ambiguous"])


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest id."""
    return exact_dedup.drop_exact(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by similarity, five-word shingles and 0.8 or more, the one with the smallest id."""
    return jaccard_join.drop_near(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 4096 token ids."""
    return packing.pack(docs, public_tokenizers.path(TOKENIZER)).drop("position")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("language", keep_languages),
    ("exact_dedup", drop_copies),
    ("ngram_jaccard", drop_near_copies),
    ("packing", pack),
]

#: SQL cannot express the stages: see tests/llm/test_pipeline.py.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other, on the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {}
