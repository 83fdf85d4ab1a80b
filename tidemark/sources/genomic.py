"""Readers for tab-separated genomic text. Each ``parse_*`` takes lines (column ``value``), each ``read_*`` a path."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.alignments import alignment_end, quality_encoding
from tidemark.operators.ordering import ranked
from tidemark.sources.text import read_lines, read_numbered_lines


def _field(i: int, fields: str = "f") -> Column:
    return F.get(fields, F.lit(i))


# No header line, eleven fields at least, numbers where the flag and the position stand.
_SAM_RECORD = r"^(?!@)[^\t]*\t\d+\t[^\t]*\t\d+(?:\t[^\t]*){7}"
_VCF_SKIPPED = r"^(?:#|\s*$)"


def parse_sam(lines: DataFrame) -> DataFrame:
    """Alignment records; header lines and lines that are no record are skipped.

    One test of the whole line decides, so that the fields are split once, after it.
    """
    fields = lines.filter(F.col("value").rlike(_SAM_RECORD)).select(F.split("value", "\t").alias("f"))
    return fields.select(
        _field(0).alias("qname"),
        _field(1).try_cast("int").alias("flag"),
        _field(2).alias("contig"),
        _field(3).try_cast("long").alias("pos"),
        _field(4).try_cast("int").alias("mapq"),
        _field(5).alias("cigar"),
        _field(6).alias("rnext"),
        _field(7).try_cast("long").alias("pnext"),
        _field(8).try_cast("long").alias("tlen"),
        _field(9).alias("seq"),
        _field(10).alias("qual"),
        F.slice("f", F.lit(12), F.size("f")).alias("tags"),
    )


def read_sam(spark: SparkSession, path: str) -> DataFrame:
    return parse_sam(read_lines(spark, path))


def with_extent(reads: DataFrame) -> DataFrame:
    """Add ``end`` (last position covered) and ``encoding`` (of the base qualities)."""
    return reads.withColumns({"end": alignment_end("pos", "cigar"), "encoding": quality_encoding("qual")})


def read_dict(spark: SparkSession, path: str, all_contigs: bool = False) -> DataFrame:
    """(idx, contig, length): contigs in the order of the dictionary, from 0.

    Names with ``_`` (alternate and unplaced sequences) are left out, and so are lines of at most three fields.
    ``all_contigs`` keeps every contig after the header line; a length that is no number is then 0.
    """
    lines = read_numbered_lines(spark, path)
    if all_contigs:
        entries = lines.filter(F.col("line_no") > 0).select("line_no", F.split("value", r"\s+").alias("f"))
        kept = entries.filter(F.size("f") >= 3).select(
            "line_no",
            F.regexp_extract(_field(1), r"^[^:]*:?(.*)$", 1).alias("contig"),
            F.coalesce(F.regexp_extract(_field(2), r"^[^:]*:?(.*)$", 1).try_cast("long"), F.lit(0)).alias("length"),
        )
    else:
        entries = lines.select("line_no", F.split("value", "\t").alias("f"))
        kept = entries.filter((F.size("f") > 3) & ~_field(1).contains("_")).select(
            "line_no",
            F.replace(_field(1), F.lit("SN:"), F.lit("")).alias("contig"),
            F.replace(_field(2), F.lit("LN:"), F.lit("")).try_cast("long").alias("length"),
        )
    return ranked(kept, ["line_no"], name="idx").select((F.col("idx") - 1).alias("idx"), "contig", "length")


def parse_vcf(lines: DataFrame) -> DataFrame:
    """(chrom, pos, id, ref, alt, line): variant lines; comments and blank lines are skipped."""
    body = lines.filter(~F.col("value").rlike(_VCF_SKIPPED))
    return body.select("value", F.split("value", "\t").alias("f")).select(
        _field(0).alias("chrom"),
        _field(1).try_cast("long").alias("pos"),
        _field(2).alias("id"),
        _field(3).alias("ref"),
        _field(4).alias("alt"),
        F.col("value").alias("line"),
    )


def read_vcf(spark: SparkSession, path: str) -> DataFrame:
    return parse_vcf(read_lines(spark, path))


def parse_density(lines: DataFrame) -> DataFrame:
    """(contig, idx, bin, n) from lines ``(contig,idx,bin,n)``."""
    fields = lines.select(F.split(F.regexp_replace("value", "[()]", ""), ",").alias("f"))
    return fields.select(
        _field(0).alias("contig"),
        _field(1).try_cast("long").alias("idx"),
        _field(2).try_cast("long").alias("bin"),
        _field(3).try_cast("long").alias("n"),
    )


def read_density(spark: SparkSession, path: str) -> DataFrame:
    return parse_density(read_lines(spark, path))


_BED_HEADER = r"^(#|track|browser|\s*$)"


def parse_bed(lines: DataFrame) -> DataFrame:
    """(contig, start, end): half-open target intervals counted from 0."""
    fields = lines.filter(~F.col("value").rlike(_BED_HEADER)).select(F.split("value", "\t").alias("f"))
    return fields.select(
        _field(0).alias("contig"), _field(1).try_cast("long").alias("start"), _field(2).try_cast("long").alias("end")
    )


def read_bed(spark: SparkSession, path: str) -> DataFrame:
    return parse_bed(read_lines(spark, path))


def bed_header(spark: SparkSession, path: str) -> DataFrame:
    """(value): the header lines of a BED file, to be put before a result that keeps them."""
    return read_lines(spark, path).filter(F.col("value").rlike(_BED_HEADER) & (F.trim("value") != ""))
