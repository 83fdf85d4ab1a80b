"""Counts per fixed-width bin along contigs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.positions import BIN_WIDTH, BINS_PER_BLOCK, bin_of, block_of, div


SLAB = 65_536  # bins that are made from one row


def with_bin(df: DataFrame, pos: str = "pos", width: int = BIN_WIDTH) -> DataFrame:
    return df.withColumn("bin", bin_of(pos, width))


def with_block(df: DataFrame, bins: int = BINS_PER_BLOCK) -> DataFrame:
    return df.withColumn("block", block_of("bin", bins))


def with_bin_number(contigs: DataFrame, width: int = BIN_WIDTH) -> DataFrame:
    """Add ``bins``, how many bins the contig has."""
    return contigs.withColumn("bins", div("length", width) + 1)


def bin_grid(contigs: DataFrame, width: int = BIN_WIDTH) -> DataFrame:
    """(idx, contig, bin): every bin of every contig of the dictionary (idx, contig, length)."""
    numbered = with_bin_number(contigs, width)
    # first a row per slab, dealt out, then its bins: no row holds the bins of a whole contig
    slabs = numbered.withColumn("first", F.explode(F.sequence(F.lit(1).cast("long"), "bins", F.lit(SLAB).cast("long"))))
    dealt = slabs.repartition("idx", "first")
    last = F.least("bins", F.col("first") + (SLAB - 1))
    return dealt.select("idx", "contig", F.explode(F.sequence("first", last)).alias("bin"))


def bin_counts(variants: DataFrame, width: int = BIN_WIDTH) -> DataFrame:
    """(contig, bin, n) from rows with ``contig`` and ``pos``; counted before the shuffle as well as after it."""
    return with_bin(variants, "pos", width).groupBy("contig", "bin").agg(F.count("*").alias("n"))


def bin_density(grid: DataFrame, counts: DataFrame, keep_empty: bool = False) -> DataFrame:
    """(contig, idx, bin, n): counts of the bins of the grid; both sides have one row per bin.

    Bins without a variant are left out unless ``keep_empty``.
    """
    joined = grid.join(counts, ["contig", "bin"], "left" if keep_empty else "inner")
    return joined.select("contig", "idx", "bin", F.coalesce("n", F.lit(0)).alias("n"))
