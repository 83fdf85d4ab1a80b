"""Queries that write a result with its sink and read the files back; line numbers make the order count."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import cast, intervals
from tidemark.operators.words import report_order
from tidemark.plans import graph, positions, streams, web, words
from tidemark.plans.tables import table
from tidemark.session import scratch_path
from tidemark.sources import fastq, genomic, sinks
from tidemark.sources.text import read_numbered_lines, read_records


def report_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "report")
    sinks.write_lines(words.word_freq_report(spark, sf_dir), path, order=report_order())
    return read_numbered_lines(spark, path)


def phone_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "phones")
    sinks.write_phone_index(web.phone_index(spark, sf_dir), path)
    return spark.read.parquet(path)


def vcf_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "vcf-file")
    sinks.write_vcf_body(positions.vcf_variants(spark, sf_dir), path)
    return read_numbered_lines(spark, path)


def chunk_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of the chunk folders one after the other."""
    path = scratch_path(spark, "chunk-lines")
    fastq.write_fastq_chunks(streams.fastq_chunks(spark, sf_dir), path, "gzip")
    return read_numbered_lines(spark, path)


def cast_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cast records written as a text with a blank line between them, and read from it."""
    orders = table(spark, sf_dir, "orders")
    sides = []
    for is_male in (True, False):
        path = scratch_path(spark, "casts-file")
        graph.cast_records(orders, is_male).write.option("lineSep", "\n\n").text(path)
        sides.append(read_records(spark, path))
    return cast.parse_casts(*sides)


def bed_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets written as a BED file with a header, cut with the covered regions, and written with that header."""
    source, path = scratch_path(spark, "bed"), scratch_path(spark, "bed-targets")
    targets = positions.targets(spark, sf_dir)
    header = spark.createDataFrame([("#targets",), ("track name=orders",)], "value string").coalesce(1)
    lines = targets.select(F.concat_ws("\t", "contig", F.col("start").cast("string"), F.col("end").cast("string"), F.lit("x")).alias("value"))
    header.write.text(f"{source}/a")
    lines.write.text(f"{source}/b")
    both = [f"{source}/a", f"{source}/b"]
    shared = intervals.interval_intersect(genomic.read_bed(spark, both), positions.merge_intervals(spark, sf_dir))
    sinks.write_bed_with_header(genomic.bed_header(spark, both), shared, path)
    return read_numbered_lines(spark, path)


QUERIES = {f.__name__: f for f in (report_file, phone_file, vcf_file, chunk_lines, cast_file, bed_targets)}


def _numbered(rows: str, order: str, line: str = "line") -> str:
    return f"SELECT row_number() OVER (ORDER BY {order}) - 1 AS line_no, {line} AS value FROM ({rows})"


ORACLES = {
    "report_file": _numbered(words.ORACLES["word_freq_report"], "n DESC, word, pred IS NOT NULL, pred_n DESC, pred"),
    "phone_file": web.ORACLES["phone_index"],
    "vcf_file": _numbered(positions.ORACLES["vcf_sorted"], "code, pos, line"),
    "chunk_lines": f"""
WITH {streams.PAIRS}
SELECT read * 8 + i - 1 AS line_no, [name1, seq1, plus1, qual1, name2, seq2, plus2, qual2][i] AS value
FROM pairs CROSS JOIN (SELECT unnest(generate_series(1, 8)) AS i)
""",
    "cast_file": graph.ORACLES["cast_parse"],
    "bed_targets": f"""
WITH shared AS ({positions.ORACLES["interval_intersect"]}),
lines AS (
  SELECT 0 AS part, NULL AS contig, NULL AS s, NULL AS e, unnest(['#targets', 'track name=orders']) AS line
  UNION ALL SELECT 1, contig, "start", "end", contig || chr(9) || "start" || chr(9) || "end" FROM shared
)
{_numbered("SELECT * FROM lines", "part, contig, s, e, line")}
""",
}
