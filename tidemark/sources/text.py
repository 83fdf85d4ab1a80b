"""Text sources: lines, numbered lines, records, manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(value): one row per line of a file or folder."""
    return spark.read.text(path)


def read_records(spark: SparkSession, path: str, sep: str = "\n\n") -> DataFrame:
    """(value): one row per record; records are separated by ``sep``."""
    return spark.read.text(path, lineSep=sep)


def read_manifest(spark: SparkSession, path: str, partitions: int | None = None) -> DataFrame:
    """(uri): one row per line, spread evenly: every line stands for a lot of work.

    Without a number the rows go to as many partitions as the cluster has cores by default.
    """
    lines = spark.read.text(path).select(F.trim("value").alias("uri")).filter(F.col("uri") != "")
    return lines.repartition(partitions or spark.sparkContext.defaultParallelism)


def _by_number() -> Column:
    """Order of the paths: part-10001 before part-100000, chunk=9 before chunk=10. Runs of digits are made equally long."""
    runs = F.regexp_extract_all("file", F.lit(r"(\d+|\D+)"), F.lit(1))
    return F.array_join(F.transform(runs, lambda run: F.when(run.rlike(r"^\d"), F.lpad(run, 40, "0")).otherwise(run)), "")


def read_numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(value, line_no): lines with their number from 0, files in order of their paths, numbers in them by value.

    Every split of a file numbers its own lines; a first pass over the splits counts them, and the running sum of
    those counts (one row per split, so one per 128 MB of text) is where each split starts. The lines are not shuffled.
    """
    lines = spark.read.text(path).select(
        "value",
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"),
    )
    splits = lines.groupBy("file", "block").agg(F.min("at").alias("first"), F.count("*").alias("lines"))
    before = Window.orderBy(_by_number(), "file", "block").rowsBetween(Window.unboundedPreceding, -1)
    starts = splits.select("file", "block", (F.coalesce(F.sum("lines").over(before), F.lit(0)) - F.col("first")).alias("shift"))
    return lines.join(F.broadcast(starts), ["file", "block"]).select("value", (F.col("at") + F.col("shift")).alias("line_no"))
