"""The analyses end to end, from files to files: ``python -m tidemark.programs <name> --help``, or by spark-submit."""

from __future__ import annotations

import argparse
import inspect
import sys
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.positions import bed_string
from tidemark.operators import blocks, cast, density, graph, hashtags, intervals, language, phones, variants, words
from tidemark.session import materialise
from tidemark.sources import archives, fastq, genomic, sinks
from tidemark.sources.text import read_lines, read_manifest, read_records
from tidemark.streaming import arrivals, trends


def word_frequency(spark: SparkSession, text: str, output: str) -> None:
    """Words by frequency, each with the words before it, as text."""
    sinks.write_lines(words.word_freq_report(read_lines(spark, text)), output, order=words.report_order())


def phone_index(spark: SparkSession, manifest: str, output: str, partitions: int = 0) -> None:
    """Phone numbers of the archives listed in the manifest, with the pages they are on, as Parquet."""
    scan, counters = archives.observed_scan(read_manifest(spark, manifest, partitions or None))
    index = phones.phone_index(phones.extract_phones(scan, "payload", "target_uri"), "target_uri")
    sinks.write_phone_index(index, output)
    print("Failed segments: {failed_segments}\nFailed parses: {failed_records}".format(**counters.get), file=sys.stderr)


def separation(spark: SparkSession, males: str, females: str, output: str, root: str) -> None:
    """Report on how many films away from the person named ``root`` everybody is, as text."""
    vertices, members = graph.build_graph(cast.parse_casts(read_records(spark, males), read_records(spark, females)))
    vertices, members = materialise(vertices, "vertices"), materialise(members, "members")
    distances = graph.shortest_hops(members, graph.find_root(vertices, root), graph.MAX_DISTANCE)
    sinks.write_lines(graph.separation_report(distances, vertices, members), output, order=["section", "nth"])


def variant_density(spark: SparkSession, known: str, dictionary: str, output: str) -> None:
    """Known variants per bin of the contigs of the dictionary, as text."""
    counts = density.bin_counts(genomic.read_vcf(spark, known).select(F.col("chrom").alias("contig"), "pos"))
    sinks.write_density(density.bin_density(density.bin_grid(genomic.read_dict(spark, dictionary)), counts), output)


def fastq_chunks(spark: SparkSession, first: str, second: str, output: str, reads: int = fastq.READS_PER_CHUNK) -> None:
    """Read pairs in chunks of equal size, one folder each."""
    fastq.write_fastq_chunks(fastq.fastq_chunks(fastq.read_fastq_pair(spark, first, second), reads), output)


def chunk_arrivals(spark: SparkSession, folder: str, output: str, checkpoint: str) -> None:
    """Lines of every chunk that has arrived in the folder since the last run, as Parquet."""
    stream = arrivals.read_file_arrivals(spark, folder)
    arrivals.write_file_arrivals(stream, output, checkpoint, availableNow=True).awaitTermination()


def read_groups(
    spark: SparkSession, sam: str, dictionary: str, densities: str, output: str, groups: int = blocks.GROUPS
) -> None:
    """Mapped reads in blocks, the blocks in groups of even weight: Parquet, one folder per group."""
    contigs = materialise(genomic.read_dict(spark, dictionary), "contigs")
    reads = materialise(blocks.mapped_reads(genomic.with_extent(genomic.read_sam(spark, sam)), contigs), "reads")
    weights = blocks.all_block_weights(blocks.read_counts(reads), genomic.read_density(spark, densities), contigs)
    dealt = blocks.balanced_groups(weights, groups).select("idx", "block", "group")
    placed = blocks.lookup_join(blocks.block_slices(reads, contigs), dealt, ["idx", "block"])
    placed.write.partitionBy("group").parquet(output)


def group_regions(spark: SparkSession, reads: str, targets: str, output: str) -> None:
    """Regions the reads of each group cover (``output/regions``, BED lines by group), and what they share with the
    target intervals (``output/targets``, BED with the header of the targets)."""
    covered = spark.read.parquet(reads).select("group", "contig", F.col("pos").cast("long").alias("start"), "end")
    regions = materialise(intervals.merge_intervals(covered, by=["group"]), "regions")
    lines = regions.orderBy("group", "contig", "start").select("group", bed_string().alias("value"))
    lines.write.partitionBy("group").text(f"{output}/regions")
    shifted = regions.select("contig", (F.col("start") - 1).alias("start"), (F.col("end") - 1).alias("end"))
    shared = intervals.interval_intersect(genomic.read_bed(spark, targets), shifted)
    sinks.write_bed_with_header(genomic.bed_header(spark, targets), shared, f"{output}/targets")


def sorted_calls(spark: SparkSession, calls: str, output: str) -> None:
    """Called variants of all groups in order of chromosome and position, as text."""
    sinks.write_vcf_body(genomic.read_vcf(spark, calls), output)


def concordance(spark: SparkSession, reference: str, mine: str) -> None:
    """Prints how many reference variants there are, how many the other set has, and the difference."""
    row = variants.variant_concordance(genomic.read_vcf(spark, reference), genomic.read_vcf(spark, mine)).first()
    print(f"total = {row.total}\nmatches = {row.matches}\ndiff = {row.diff}")


def trending(
    spark: SparkSession,
    posts: str,
    profiles: str,
    output: str,
    checkpoint: str,
    length: int = 120,
    slide: int = 2,
    delay: int = 10,
    every: str = "2 seconds",
) -> None:
    """Hashtags of the English posts that arrive as JSON files, window by window, as Parquet.

    ``profiles`` is a Parquet table (lang, trigram, n), see ``language.lang_profiles``. Runs until stopped; with an
    empty ``every`` it ends after the files that are there.
    """
    schema = (
        "id long, user string, rt long, text string, ts timestamp, is_retweet boolean, "
        "rt_id long, rt_user string, rt_rt long, rt_text string"
    )
    stream = hashtags.flatten_retweets(trends.read_posts_stream(spark, posts, schema))
    growth = trends.retweet_growth_stream(stream, length, slide, delay)
    known = language.prepare_profiles(spark.read.parquet(profiles))  # once, not for every batch

    def report(tagged: DataFrame) -> DataFrame:
        # each distinct text of the closed windows is judged once
        return hashtags.trend_of_tags(language.posts_in(tagged, "text", known).select(*tagged.columns))

    trigger = {"processingTime": every} if every else {"availableNow": True}
    trends.write_trends_stream(growth, output, checkpoint, report, **trigger).awaitTermination()


PROGRAMS: dict[str, Callable] = {
    f.__name__.replace("_", "-"): f
    for f in (
        word_frequency,
        phone_index,
        separation,
        variant_density,
        fastq_chunks,
        chunk_arrivals,
        read_groups,
        group_regions,
        sorted_calls,
        concordance,
        trending,
    )
}


def parser() -> argparse.ArgumentParser:
    """One subcommand per program; its arguments are the function's, those with defaults are options."""
    top = argparse.ArgumentParser(prog="tidemark.programs", description=__doc__)
    commands = top.add_subparsers(dest="program", required=True)
    for name, program in PROGRAMS.items():
        command = commands.add_parser(name, help=(program.__doc__ or "").split("\n")[0])
        for arg in list(inspect.signature(program).parameters.values())[1:]:
            if arg.default is inspect.Parameter.empty:
                command.add_argument(arg.name)
            else:
                command.add_argument(f"--{arg.name}", type=type(arg.default), default=arg.default)
    return top


def main(argv: list[str] | None = None) -> None:
    options = vars(parser().parse_args(argv))
    name = options.pop("program")
    spark = SparkSession.builder.appName(f"tidemark {name}").getOrCreate()
    PROGRAMS[name](spark, **options)


if __name__ == "__main__":
    main()
