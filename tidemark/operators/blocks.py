"""Reads cut into blocks of even size, and blocks spread over groups of even weight."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.alignments import fix_quality, bad_quality, quality_encoding
from tidemark.functions.positions import BIN_WIDTH, BINS_PER_BLOCK, block_of, div
from tidemark.operators.density import with_bin_number
from tidemark.operators.ordering import ranked
from tidemark.operators.skew import lookup_join

# Only the first contigs (the chromosomes proper) take part; variants that weigh as much as one read.
LAST_CONTIG = 24
VARIANTS_PER_READ = 100
GROUPS = 64
_UNMAPPED = 4


def mapped_reads(reads: DataFrame, contigs: DataFrame, last_idx: int = LAST_CONTIG) -> DataFrame:
    """Reads that are mapped to one of the first contigs, with its ``idx``."""
    wanted = contigs.filter(F.col("idx") <= last_idx).select("contig", "idx")
    mapped = reads.filter(F.col("flag").bitwiseAND(_UNMAPPED) == 0)
    return lookup_join(mapped, wanted, ["contig"])


def read_counts(reads: DataFrame) -> DataFrame:
    """(idx, reads)"""
    return reads.groupBy("idx").agg(F.count("*").alias("reads"))


def contig_blocks(counts: DataFrame, contigs: DataFrame, width: int = BIN_WIDTH, bins: int = BINS_PER_BLOCK) -> DataFrame:
    """(idx, bins, blocks, avg): size of each contig that has reads, and its average reads per bin."""
    sized = counts.join(with_bin_number(contigs, width).select("idx", "bins"), "idx")
    return sized.select("idx", "bins", block_of("bins", bins).alias("blocks"), div("reads", F.col("bins")).alias("avg"))


def block_weights(
    counts: DataFrame, density: DataFrame, contigs: DataFrame, width: int = BIN_WIDTH, bins: int = BINS_PER_BLOCK
) -> DataFrame:
    """(idx, block, blocks, avg, weight): average reads of the bins of each block that have variants, plus one for
    every hundred of their variants. Blocks without variants have no row, see ``all_block_weights``."""
    known = lookup_join(density.select("idx", "bin", "n"), contig_blocks(counts, contigs, width, bins), ["idx"])
    return (
        known.filter(F.col("bin").between(1, F.col("bins")))
        .groupBy("idx", block_of("bin", bins).alias("block"), "blocks", "avg")
        .agg((F.sum("avg") + div(F.sum("n"), VARIANTS_PER_READ)).alias("weight"))
        .select("idx", "block", "blocks", "avg", "weight")
    )


def all_block_weights(
    counts: DataFrame, density: DataFrame, contigs: DataFrame, width: int = BIN_WIDTH, bins: int = BINS_PER_BLOCK
) -> DataFrame:
    """``block_weights`` with every block of the contigs that have reads: one without variants weighs the average reads
    of its bins, so that its reads are dealt out like the others."""
    sized = contig_blocks(counts, contigs, width, bins)
    every = sized.withColumn("block", F.explode(F.sequence(F.lit(1).cast("long"), F.col("blocks"))))
    own_bins = F.least(F.lit(bins).cast("long"), F.greatest(F.col("bins") - (F.col("block") - 1) * bins, F.lit(1)))
    known = block_weights(counts, density, contigs, width, bins).select("idx", "block", "weight")
    joined = every.join(known, ["idx", "block"], "left")
    return joined.select("idx", "block", "blocks", "avg", F.coalesce("weight", F.col("avg") * own_bins).alias("weight"))


def block_slices(
    reads: DataFrame,
    contigs: DataFrame,
    order: Sequence[Column | str] = ("pos", "qname"),
    width: int = BIN_WIDTH,
    bins: int = BINS_PER_BLOCK,
) -> DataFrame:
    """Add ``rank`` (of the read in its contig, by position) and ``block``: so many reads per block as an average
    block should have, the last block taking what is left. Contigs with less than a read per bin are one block.
    Pass a table: the reads are ordered, and so read twice."""
    numbered = ranked(reads, list(order), keys=["idx"])
    sizes = contig_blocks(read_counts(numbered), contigs, width, bins).select("idx", "blocks", "avg")
    placed = lookup_join(numbered, sizes, ["idx"])
    nth = F.when(F.col("avg") > 0, div(F.col("rank") - 1, F.col("avg") * bins))
    return placed.withColumn("block", F.coalesce(F.least(nth, F.col("blocks") - 1), F.col("blocks") - 1) + 1).drop(
        "blocks", "avg"
    )


def balanced_groups(weights: DataFrame, n: int = GROUPS) -> DataFrame:
    """Add ``group`` (1..n): blocks dealt out by falling weight, each round in the opposite direction to the last."""
    dealt = ranked(weights, [F.desc("weight"), "idx", "block"], name="_nth")
    turn, seat = div(F.col("_nth") - 1, n), (F.col("_nth") - 1) % n
    return dealt.withColumn("group", F.when(turn % 2 == 0, seat + 1).otherwise(n - seat)).drop("_nth")


def fix_group_qualities(reads: DataFrame, group: str, order: Sequence[str] = ("pos", "qname")) -> DataFrame:
    """Qualities of each group in the standard encoding, judged by the group's first read only; ``bad_quality`` marks
    reads that do not fit that judgement."""
    first = reads.groupBy(group).agg(F.min_by("qual", F.struct(*order, "qual")).alias("_qual"))
    judged = lookup_join(reads, first.select(group, quality_encoding("_qual").alias("encoding")), [group], "left")
    shifted = F.col("encoding") == "illumina"
    return judged.withColumns(
        {
            "bad_quality": F.coalesce(shifted & bad_quality("qual"), F.lit(False)),
            "qual": F.when(shifted, fix_quality("qual")).otherwise(F.col("qual")),
        }
    )
