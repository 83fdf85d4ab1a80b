"""Bins, blocks, intervals and variants; positions are made from ``lineitem`` (contig from the supplier)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.alignments import bad_quality, fix_quality
from tidemark.operators import blocks, density, intervals, variants
from tidemark.plans.tables import table
from tidemark.session import materialise, scratch_path
from tidemark.sources import genomic, sinks

CONTIGS = 25
NARROW = 20_000
GROUPS = 8


def _lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _placed(table(spark, sf_dir, "lineitem"))


def _placed(items: DataFrame) -> DataFrame:
    idx = F.col("l_suppkey") % CONTIGS
    return items.withColumns(
        {
            "idx": idx,
            "contig": F.concat(F.lit("chr"), idx.cast("string")),
            "pos": F.col("l_orderkey") * 10000 + F.col("l_linenumber"),
        }
    )


def _contigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dictionary (idx, contig, length): each contig ends with its last position."""
    return _lineitem(spark, sf_dir).groupBy("idx", "contig").agg(F.max("pos").alias("length"))


def _str(name: str):
    return F.col(name).cast("string")


def _qname():
    return F.concat_ws("-", F.lit("r"), _str("l_orderkey"), _str("l_linenumber"), _str("l_partkey"), _str("l_suppkey"))


def _sam_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One alignment line per line item; returned ones are unmapped, qualities are of both encodings."""
    quality = F.when(F.col("l_linestatus") == "F", F.lit("I")).when(F.col("l_linenumber") == 1, F.lit("5h")).otherwise("hU")
    return _placed(table(spark, sf_dir, "lineitem")).select(
        F.concat_ws(
            "\t",
            _qname(),
            F.when(F.col("l_returnflag") == "R", F.lit("4")).otherwise("99"),
            "contig",
            _str("pos"),
            F.lit("60"),
            F.concat(_str("l_linenumber"), F.lit("S"), F.col("l_quantity").cast("long").cast("string"), F.lit("M2D10N1I5=")),
            F.lit("="),
            _str("pos"),
            F.lit("0"),
            F.repeat(F.lit("ACGT"), F.col("l_linenumber")),
            F.repeat(quality, F.col("l_linenumber")),
            F.lit("NM:i:1"),
            F.concat(F.lit("RG:Z:"), "l_linestatus"),
        ).alias("value")
    )


def _reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mapped reads of an alignment text written from the table."""
    path = scratch_path(spark, "sam")
    _sam_lines(spark, sf_dir).write.text(path)
    return blocks.mapped_reads(genomic.read_sam(spark, path), _contigs(spark, sf_dir))


def _vcf_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One variant line per line item; three suppliers' contigs are named X, Y and M."""
    number = F.col("l_suppkey") % CONTIGS
    chrom = F.concat(
        F.lit("chr"),
        F.when(number == 22, F.lit("X")).when(number == 23, F.lit("Y")).when(number == 24, F.lit("M")).otherwise(_str("idx")),
    )
    return _placed(table(spark, sf_dir, "lineitem")).select(
        F.concat_ws("\t", chrom, _str("pos"), F.lit("."), "l_returnflag", "l_linestatus", _str("l_partkey")).alias("value"),
        "l_discount",
        "l_tax",
    )


def dict_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes a dictionary with a contig per supplier, some of them with ``_``, and reads it back."""
    path = scratch_path(spark, "dict")
    name = F.concat(
        F.lit("@SQ\tSN:s"), _str("s_suppkey"), F.when(F.col("s_nationkey") == 7, F.lit("_alt")).otherwise(""), F.lit("\tLN:")
    )
    line = F.concat(name, (F.col("s_suppkey") * 1000 + F.col("s_nationkey")).cast("string"), F.lit("\tUR:x\tM5:y"))
    table(spark, sf_dir, "supplier").orderBy("s_suppkey").select(line.alias("value")).write.text(path)
    return genomic.read_dict(spark, path)


def bin_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return density.bin_grid(_contigs(spark, sf_dir))


def bin_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return density.bin_counts(_lineitem(spark, sf_dir))


def _density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return density.bin_density(bin_grid(spark, sf_dir), bin_counts(spark, sf_dir))


def bin_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _density(spark, sf_dir).orderBy("idx", "bin")


def bin_density_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = density.bin_grid(_contigs(spark, sf_dir), NARROW)
    counts = density.bin_counts(_lineitem(spark, sf_dir), NARROW)
    return density.bin_density(grid, counts, keep_empty=True).orderBy("idx", "bin")


def density_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "density")
    sinks.write_density(_density(spark, sf_dir), path)
    return genomic.read_density(spark, path)


def sam_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    reads = genomic.with_extent(_reads(spark, sf_dir))
    old = F.col("encoding") == "illumina"
    return reads.select(
        "qname",
        "contig",
        "idx",
        F.col("pos").cast("long").alias("pos"),
        "end",
        "encoding",
        F.when(old, fix_quality("qual")).otherwise(F.col("qual")).alias("qual"),
        F.coalesce(old & bad_quality("qual"), F.lit(False)).alias("bad_quality"),
        F.array_join("tags", ";").alias("tags"),
    )


def contig_qualities(spark: SparkSession, sf_dir: str) -> DataFrame:
    fixed = blocks.fix_group_qualities(_reads(spark, sf_dir), "idx")
    return fixed.select("qname", "idx", "encoding", "qual", "bad_quality")


def read_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks.read_counts(_reads(spark, sf_dir))


def block_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    weights = blocks.block_weights(read_counts(spark, sf_dir), _density(spark, sf_dir), _contigs(spark, sf_dir))
    return weights.orderBy("idx", "block")


def block_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    reads = materialise(_reads(spark, sf_dir), "reads")
    sliced = blocks.block_slices(reads, _contigs(spark, sf_dir), order=("pos", "qname", "flag", "qual"))
    return sliced.groupBy("idx", "block").agg(
        F.count("*").alias("reads"),
        F.min("rank").alias("first_rank"),
        F.min("pos").cast("long").alias("first_pos"),
        F.max("pos").cast("long").alias("last_pos"),
    )


def balanced_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    weights = blocks.block_weights(read_counts(spark, sf_dir), _density(spark, sf_dir), _contigs(spark, sf_dir))
    return blocks.balanced_groups(weights, GROUPS).select("idx", "block", "weight", "group")


def _day(ts: str):
    return F.unix_date(F.to_date(ts)).cast("long")


def _spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intervals per supplier: shipping days, a hundred positions each, as long as the quantity."""
    start = _day("l_shipdate") * 100
    return table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("s"), (F.col("l_suppkey") % CONTIGS).cast("string")).alias("contig"),
        (start + F.col("l_linenumber")).alias("start"),
        (start + F.col("l_linenumber") + F.col("l_quantity").cast("long")).alias("end"),
    )


def targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = _day("o_orderdate") * 100 + F.col("o_custkey") % 100
    return table(spark, sf_dir, "orders").select(
        F.concat(F.lit("s"), (F.col("o_custkey") % CONTIGS).cast("string")).alias("contig"),
        start.alias("start"),
        (start + F.col("o_orderkey") % 300).alias("end"),
    )


def merge_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.merge_intervals(_spans(spark, sf_dir))


def merge_intervals_padded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.merge_intervals_padded(_spans(spark, sf_dir), pad=20)


def interval_intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.interval_intersect(targets(spark, sf_dir), merge_intervals(spark, sf_dir))


def bed_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.to_bed(merge_intervals(spark, sf_dir))


def region_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.to_region(merge_intervals(spark, sf_dir))


def region_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.region_envelope(merge_intervals(spark, sf_dir), F.col("contig").alias("name"))


def vcf_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variants read from a file of them."""
    path = scratch_path(spark, "vcf")
    _vcf_lines(spark, sf_dir).select("value").write.text(path)
    return genomic.read_vcf(spark, path)


def vcf_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.sorted_variants(vcf_variants(spark, sf_dir))


def _two_callers(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two overlapping sets of variants: all but the most taxed, all but the undiscounted."""
    lines = _vcf_lines(spark, sf_dir)
    return (
        genomic.parse_vcf(lines.filter(F.col("l_tax") < 0.08)),
        genomic.parse_vcf(lines.filter(F.col("l_discount") > 0.0)),
    )


def variant_concordance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.variant_concordance(*_two_callers(spark, sf_dir))


def missed_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.missed_variants(*_two_callers(spark, sf_dir))


QUERIES = {
    f.__name__: f
    for f in (
        dict_scan,
        bin_grid,
        bin_counts,
        bin_density,
        bin_density_all,
        density_roundtrip,
        sam_reads,
        contig_qualities,
        read_counts,
        block_weights,
        block_slices,
        balanced_groups,
        merge_intervals,
        merge_intervals_padded,
        interval_intersect,
        bed_format,
        region_format,
        region_envelope,
        vcf_sorted,
        variant_concordance,
        missed_variants,
    )
}

_ITEMS = """
items AS (
  SELECT *, l_suppkey % 25 AS idx, 'chr' || l_suppkey % 25 AS contig, l_orderkey * 10000 + l_linenumber AS pos FROM lineitem
),
contigs AS (SELECT idx, contig, max(pos) AS length FROM items GROUP BY ALL),
sizes AS (SELECT *, length // 1000000 + 1 AS bins FROM contigs)
"""

_DENSITY = f"""{_ITEMS},
counts AS (SELECT contig, pos // 1000000 + 1 AS bin, count(*) AS n FROM items GROUP BY ALL),
grid AS (SELECT idx, contig, unnest(generate_series(1, bins)) AS bin FROM sizes),
density AS (SELECT contig, idx, bin, n FROM grid JOIN counts USING (contig, bin))
"""

_QUAL = "repeat(CASE WHEN l_linestatus = 'F' THEN 'I' WHEN l_linenumber = 1 THEN '5h' ELSE 'hU' END, l_linenumber)"
# 'h' and 'U' moved down by 31 are 'I' and '6'; '5' has no such place and stays.
_READS = f"""{_DENSITY},
reads AS (
  SELECT concat_ws('-', 'r', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS qname, contig, idx, pos, {_QUAL} AS qual,
    pos + CAST(l_quantity AS BIGINT) + 16 AS "end", CASE WHEN l_linestatus = 'F' THEN 'sanger' ELSE 'illumina' END AS encoding,
    'NM:i:1;RG:Z:' || l_linestatus AS tags
  FROM items WHERE l_returnflag <> 'R' AND idx <= 24
),
read_counts AS (SELECT idx, count(*) AS reads FROM reads GROUP BY idx),
per_contig AS (
  SELECT idx, bins, (bins + 19) // 20 AS blocks, reads // bins AS avg FROM read_counts JOIN sizes USING (idx)
),
weights AS (
  SELECT idx, (bin + 19) // 20 AS block, blocks, avg,
    CAST(sum(avg) AS BIGINT) + CAST(sum(n) AS BIGINT) // 100 AS weight
  FROM density JOIN per_contig USING (idx) WHERE bin <= bins GROUP BY ALL
)
"""

_MERGED = """
spans AS (
  SELECT 's' || l_suppkey % 25 AS contig, (CAST(l_shipdate AS DATE) - DATE '1970-01-01') * 100 + l_linenumber AS s,
    (CAST(l_shipdate AS DATE) - DATE '1970-01-01') * 100 + l_linenumber + CAST(l_quantity AS BIGINT) AS e FROM lineitem
),
reach AS (
  SELECT *, max(e) OVER (PARTITION BY contig ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before
  FROM spans
),
numbered AS (
  SELECT *, sum(CASE WHEN before IS NULL OR {opens} THEN 1 ELSE 0 END)
    OVER (PARTITION BY contig ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM reach
),
merged AS (SELECT contig, min(s) AS "start", max(e) AS "end" FROM numbered GROUP BY contig, island)
"""

_ISLANDS = _MERGED.format(opens="s > before + 51")

_VCF = """
called AS (
  SELECT 'chr' || CASE l_suppkey % 25 WHEN 22 THEN 'X' WHEN 23 THEN 'Y' WHEN 24 THEN 'M'
      ELSE CAST(l_suppkey % 25 AS VARCHAR) END AS chrom,
    l_orderkey * 10000 + l_linenumber AS pos, l_returnflag AS ref, l_linestatus AS alt, l_partkey, l_tax, l_discount
  FROM lineitem
)
"""

_CALLERS = f"""{_VCF},
one AS (SELECT DISTINCT chrom, pos, ref, alt FROM called WHERE l_tax < 0.08),
two AS (SELECT DISTINCT chrom, pos, ref, alt FROM called WHERE l_discount > 0.0)
"""

ORACLES = {
    "dict_scan": """
SELECT row_number() OVER (ORDER BY s_suppkey) - 1 AS idx, 's' || s_suppkey AS contig, s_suppkey * 1000 + s_nationkey AS length
FROM supplier WHERE s_nationkey <> 7
""",
    "bin_grid": f"WITH {_DENSITY} SELECT idx, contig, bin FROM grid",
    "bin_counts": f"WITH {_DENSITY} SELECT contig, bin, n FROM counts",
    "bin_density": f"WITH {_DENSITY} SELECT contig, idx, bin, n FROM density",
    "bin_density_all": f"""
WITH {_ITEMS},
narrow AS (SELECT idx, contig, unnest(generate_series(1, length // {NARROW} + 1)) AS bin FROM contigs),
counts AS (SELECT contig, pos // {NARROW} + 1 AS bin, count(*) AS n FROM items GROUP BY ALL)
SELECT contig, idx, bin, coalesce(n, 0) AS n FROM narrow LEFT JOIN counts USING (contig, bin)
""",
    "density_roundtrip": f"WITH {_DENSITY} SELECT contig, idx, bin, n FROM density",
    "sam_reads": f"""
WITH {_READS}
SELECT qname, contig, idx, pos, "end", encoding, tags,
  CASE WHEN encoding = 'illumina' THEN translate(qual, 'hU', 'I6') ELSE qual END AS qual,
  encoding = 'illumina' AND contains(qual, '5') AS bad_quality FROM reads
""",
    "contig_qualities": f"""
WITH {_READS},
firsts AS (SELECT idx, arg_min(encoding, {{'p': pos, 'q': qname, 'u': qual}}) AS encoding FROM reads GROUP BY idx)
SELECT r.qname, r.idx, f.encoding,
  CASE WHEN f.encoding = 'illumina' THEN translate(qual, 'hUI', 'I6*') ELSE qual END AS qual,
  f.encoding = 'illumina' AND contains(qual, '5') AS bad_quality
FROM reads r JOIN firsts f USING (idx)
""",
    "read_counts": f"WITH {_READS} SELECT idx, reads FROM read_counts",
    "block_weights": f"WITH {_READS} SELECT idx, block, blocks, avg, weight FROM weights",
    "block_slices": f"""
WITH {_READS},
ranks AS (SELECT *, row_number() OVER (PARTITION BY idx ORDER BY pos, qname, qual) AS rank FROM reads),
placed AS (
  SELECT r.*, 1 + CASE WHEN avg = 0 THEN blocks - 1 ELSE least((rank - 1) // (avg * 20), blocks - 1) END AS block
  FROM ranks r JOIN per_contig USING (idx)
)
SELECT idx, block, count(*) AS reads, min(rank) AS first_rank, min(pos) AS first_pos, max(pos) AS last_pos
FROM placed GROUP BY idx, block
""",
    "balanced_groups": f"""
WITH {_READS},
dealt AS (SELECT *, row_number() OVER (ORDER BY weight DESC, idx, block) - 1 AS nth FROM weights)
SELECT idx, block, weight, CASE WHEN nth // {GROUPS} % 2 = 0 THEN nth % {GROUPS} + 1 ELSE {GROUPS} - nth % {GROUPS} END AS "group"
FROM dealt
""",
    "merge_intervals": f'WITH {_ISLANDS} SELECT contig, "start", "end" FROM merged',
    "merge_intervals_padded": f"""
WITH {_MERGED.format(opens="s - 20 >= before")} SELECT contig, greatest("start" - 20, 1) AS "start", "end" FROM merged
""",
    "interval_intersect": f"""
WITH {_ISLANDS},
targets AS (
  SELECT 's' || o_custkey % 25 AS contig, (CAST(o_orderdate AS DATE) - DATE '1970-01-01') * 100 + o_custkey % 100 AS s,
    (CAST(o_orderdate AS DATE) - DATE '1970-01-01') * 100 + o_custkey % 100 + o_orderkey % 300 AS e FROM orders
)
SELECT t.contig, greatest(s, "start") AS "start", least(e, "end") AS "end", s AS a_start, e AS a_end,
  "start" AS b_start, "end" AS b_end
FROM targets t JOIN merged m ON t.contig = m.contig AND s < "end" AND "start" < e AND s < e
""",
    "bed_format": f"""
WITH {_ISLANDS} SELECT contig || chr(9) || ("start" - 1) || chr(9) || ("end" - 1) AS value FROM merged
""",
    "region_format": f"""WITH {_ISLANDS} SELECT contig || ':' || "start" || '-' || "end" AS value FROM merged""",
    "region_envelope": f"""
WITH {_ISLANDS}
SELECT contig AS name, min("start") AS "start", arg_max("end", "start") AS "end", count(*) AS regions,
  count(*) || 'regions_' || contig || '-' || min("start") AS label FROM merged GROUP BY contig
""",
    "vcf_sorted": f"""
WITH {_VCF},
coded AS (
  SELECT CASE chrom WHEN 'chrX' THEN 23 WHEN 'chrY' THEN 24
      ELSE TRY_CAST(regexp_replace(chrom, '[^0-9]', '', 'g') AS INT) END AS code,
    pos, concat_ws(chr(9), chrom, pos, '.', ref, alt, l_partkey) AS line FROM called
)
SELECT code, pos, line FROM coded WHERE code BETWEEN 1 AND 24
""",
    "variant_concordance": f"""
WITH {_CALLERS}, counted AS (
  SELECT (SELECT count(*) FROM one) AS total, (SELECT count(*) FROM one SEMI JOIN two USING (chrom, pos, ref, alt)) AS matches
)
SELECT total, matches, total - matches AS diff FROM counted
""",
    "missed_variants": f"WITH {_CALLERS} SELECT * FROM one ANTI JOIN two USING (chrom, pos, ref, alt)",
}
