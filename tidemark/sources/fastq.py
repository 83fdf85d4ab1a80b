"""Paired FASTQ files: four lines per read, the reads of two files paired by their position."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.positions import div
from tidemark.sources.text import read_numbered_lines

LINES_PER_READ = 4
READS_PER_BLOCK = 4_096  # pairs that are shuffled side by side
READS_PER_CHUNK = 70_374  # fixed value: read pairs of one chunk
PAIR_LINES = [f"{part}{side}" for side in (1, 2) for part in ("name", "seq", "plus", "qual")]


def read_fastq_pair(spark: SparkSession, path1: str, path2: str) -> DataFrame:
    """(read, name1, seq1, plus1, qual1, name2, seq2, plus2, qual2); pairs are numbered from 0.

    One shuffle gathers the eight lines of a pair; reads without a full partner (the longer file) are left out. Blocks of
    consecutive reads stay together in it, as their lines are alike and pack well.
    """
    sides = [
        read_numbered_lines(spark, path).select(
            div("line_no", LINES_PER_READ).alias("read"),
            (F.col("line_no") % LINES_PER_READ + side * LINES_PER_READ).alias("slot"),
            "value",
        )
        for side, path in enumerate((path1, path2))
    ]
    lines = sides[0].unionByName(sides[1]).withColumn("_block", div("read", READS_PER_BLOCK))
    each = [F.max(F.when(F.col("slot") == i, F.col("value"))).alias(c) for i, c in enumerate(PAIR_LINES)]
    pairs = lines.repartition("_block").groupBy("_block", "read").agg(F.count("*").alias("_lines"), *each)
    return pairs.filter(F.col("_lines") == len(PAIR_LINES)).select("read", *PAIR_LINES)


def fastq_chunks(pairs: DataFrame, reads_per_chunk: int = READS_PER_CHUNK) -> DataFrame:
    """Add ``chunk``, from 1."""
    return pairs.withColumn("chunk", div("read", reads_per_chunk) + 1)


def write_fastq_chunks(chunks: DataFrame, path: str, compression: str = "none") -> None:
    """One folder ``chunk=N`` with one file per chunk: the four lines of file 1, then those of file 2, pair by pair.

    A chunk has a fixed number of reads, so it fits a task whatever the size of the input.
    """
    lines = F.array_join(F.array(*PAIR_LINES), "\n")
    laid = chunks.repartition("chunk").sortWithinPartitions("chunk", "read")
    laid.select("chunk", lines.alias("value")).write.partitionBy("chunk").text(path, compression=compression)
