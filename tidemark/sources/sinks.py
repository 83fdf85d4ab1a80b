"""Sinks. Sorted output is range-partitioned: reading the part files in order of their names gives the whole order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.intervals import to_bed, to_region
from tidemark.operators.variants import sorted_variants


def write_lines(df: DataFrame, path: str, line: str = "line", order: list[Column | str] | None = None) -> None:
    """Text, one line per row, sorted if ``order`` is given."""
    (df.orderBy(*order) if order else df).select(F.col(line).alias("value")).write.text(path)


def write_parquet(df: DataFrame, path: str) -> None:
    df.write.parquet(path)


def write_phone_index(index: DataFrame, path: str) -> None:
    """Parquet (num, part, urls): the parts of a number in order are its list."""
    index.select("num", "part", "urls").write.parquet(path)


def density_lines(density: DataFrame) -> DataFrame:
    """Lines ``(contig,idx,bin,n)`` by contig index and bin."""
    line = F.format_string("(%s,%d,%d,%d)", "contig", "idx", "bin", "n")
    return density.orderBy("idx", "bin").select(line.alias("value"))


def write_density(density: DataFrame, path: str) -> None:
    density_lines(density).write.text(path)


def write_vcf_body(variants: DataFrame, path: str) -> None:
    """Variant lines without header, by chromosome and position."""
    sorted_variants(variants).select(F.col("line").alias("value")).write.text(path)


def write_bed(regions: DataFrame, path: str, half_open: bool = False) -> None:
    to_bed(regions.orderBy("contig", "start"), half_open).write.text(path)


def write_bed_with_header(header: DataFrame, regions: DataFrame, path: str) -> None:
    """Header lines (value) in front of half-open regions in order; the regions are written as they stand."""
    line = F.concat_ws("\t", "contig", F.col("start").cast("string"), F.col("end").cast("string"))
    none = F.lit(None)
    head = header.select(F.lit(0).alias("part"), none.cast("string").alias("contig"), none.cast("long").alias("start"), none.cast("long").alias("end"), F.col("value").alias("line"))
    body = regions.select(F.lit(1).alias("part"), "contig", "start", "end", line.alias("line"))
    write_lines(head.unionByName(body), path, order=["part", "contig", "start", "end", "line"])


def write_regions(regions: DataFrame, path: str) -> None:
    to_region(regions.orderBy("contig", "start")).write.text(path)
