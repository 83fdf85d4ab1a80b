"""Column expressions for positions on contigs: bins, blocks, chromosome numbers, interval text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Bases per bin, bins per block, and the chromosomes that are named by a letter.
BIN_WIDTH = 1_000_000
BINS_PER_BLOCK = 20
LETTER_CHROMOSOMES = {"chrX": 23, "chrY": 24}


def div(a: Column | str, b: Column | int) -> Column:
    """Integer division of whole numbers."""
    return F.call_function("div", F.col(a) if isinstance(a, str) else a, F.lit(b) if isinstance(b, int) else b)


def bin_of(pos: Column | str, width: int = BIN_WIDTH) -> Column:
    """1-based bin of a position; position ``width`` is the first of bin 2."""
    return div(pos, width) + 1


def block_of(bin_: Column | str, bins: int = BINS_PER_BLOCK) -> Column:
    """1-based block of ``bins`` bins."""
    return div((F.col(bin_) if isinstance(bin_, str) else bin_) + (bins - 1), bins)


def chrom_code(name: Column | str) -> Column:
    """Number of a chromosome: its digits, 23 for X, 24 for Y; NULL for other names."""
    name = F.col(name) if isinstance(name, str) else name
    code = F.regexp_replace(name, "[^0-9]", "").try_cast("int")
    for letter, number in LETTER_CHROMOSOMES.items():
        code = F.when(name == letter, number).otherwise(code)
    return code


def region_string(contig: str = "contig", start: str = "start", end: str = "end") -> Column:
    """``contig:start-end``"""
    return F.format_string("%s:%d-%d", F.col(contig), F.col(start), F.col(end))


def bed_string(contig: str = "contig", start: str = "start", end: str = "end", half_open: bool = False) -> Column:
    """``contig<TAB>start<TAB>end`` counted from 0. The end is shifted like the start, as the tools downstream expect
    it; ``half_open`` leaves it, which is what the BED definition says."""
    last = F.col(end) if half_open else F.col(end) - 1
    return F.concat_ws("\t", F.col(contig), (F.col(start) - 1).cast("string"), last.cast("string"))
