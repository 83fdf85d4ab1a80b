import random

from pyspark.sql import functions as F

from tests.helpers import lines_of, rows
from tidemark.functions.alignments import alignment_end, bad_quality, fix_quality, quality_encoding
from tidemark.functions.positions import chrom_code
from tidemark.operators import blocks, density, intervals, variants
from tidemark.sources import genomic, sinks
from tidemark.sources.text import read_lines, read_numbered_lines, read_records


def contigs(spark, *lengths):
    return spark.createDataFrame([(i, f"chr{i}", n) for i, n in enumerate(lengths)], "idx long, contig string, length long")


def spans(spark, *values, contig="c"):
    return spark.createDataFrame([(contig, s, e) for s, e in values], "contig string, start long, end long")


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "v string").select(column).first()[0]


# bins


def test_bins_blocks_and_grid(spark):
    at = spark.createDataFrame([("chr0", 999_999), ("chr0", 1_000_000), ("chr0", 1_000_001), ("alt", 5)], "contig string, pos long")
    assert rows(density.bin_counts(at), "contig", "bin") == [("alt", 1, 1), ("chr0", 1, 1), ("chr0", 2, 2)]
    grid = density.bin_grid(contigs(spark, 2_500_000, 10))
    assert rows(grid, "idx", "bin") == [(0, "chr0", 1), (0, "chr0", 2), (0, "chr0", 3), (1, "chr1", 1)]
    counts = density.bin_counts(at)
    assert rows(density.bin_density(grid, counts), "idx", "bin") == [("chr0", 0, 1, 1), ("chr0", 0, 2, 2)]
    full = rows(density.bin_density(grid, counts, keep_empty=True), "idx", "bin")
    assert full == [("chr0", 0, 1, 1), ("chr0", 0, 2, 2), ("chr0", 0, 3, 0), ("chr1", 1, 1, 0)]
    bins = spark.createDataFrame([(1,), (20,), (21,), (40,), (41,)], "bin long")
    assert [r.block for r in density.with_block(bins).collect()] == [1, 1, 2, 2, 3]


def test_human_dictionary_sizes(spark):
    # lengths of the 25 primary contigs of the public human assembly hg19, in its order
    lengths = [
        16571, 249250621, 243199373, 198022430, 191154276, 180915260, 171115067, 159138663, 146364022, 141213431, 135534747,
        135006516, 133851895, 115169878, 107349540, 102531392, 90354753, 81195210, 78077248, 59128983, 63025520, 48129895,
        51304566, 155270560, 59373566,
    ]
    sized = density.with_bin_number(contigs(spark, *lengths))
    blocks_ = sized.select(F.sum("bins"), F.sum(F.floor((F.col("bins") + 19) / 20)))
    assert rows(blocks_) == [(3114, 167)]


def test_density_file(spark, tmp_path):
    table = spark.createDataFrame([("chr1", 1, 5, 10534), ("chrM", 0, 1, 3)], "contig string, idx long, bin long, n long")
    sinks.write_density(table, str(tmp_path / "d"))
    assert sorted(r.value for r in read_lines(spark, str(tmp_path / "d")).collect()) == ["(chr1,1,5,10534)", "(chrM,0,1,3)"]
    assert rows(genomic.read_density(spark, str(tmp_path / "d")), "idx") == rows(table, "idx")


# readers


def test_dictionary(spark, tmp_path):
    path = tmp_path / "x.dict"
    path.write_text(
        "@HD\tVN:1.0\tSO:unsorted\n@SQ\tSN:chrM\tLN:16571\tUR:x\tM5:y\n@SQ\tSN:chr1_alt\tLN:7\tUR:x\tM5:y\n"
        "@SQ\tSN:chr1\tLN:249\tUR:x\tM5:y\n@SQ\tSN:odd\tLN:n\tUR:x\tM5:y\n"
    )
    assert rows(genomic.read_dict(spark, str(path)), "idx") == [(0, "chrM", 16571), (1, "chr1", 249), (2, "odd", None)]
    every = rows(genomic.read_dict(spark, str(path), all_contigs=True), "idx")
    assert every == [(0, "chrM", 16571), (1, "chr1_alt", 7), (2, "chr1", 249), (3, "odd", 0)]


def test_numbered_lines_over_many_splits(spark, tmp_path):
    for part in range(3):
        (tmp_path / f"part-{part}.txt").write_text("".join(f"{part}:{i}\n" for i in range(2000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        got = rows(read_numbered_lines(spark, str(tmp_path)), "line_no")
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == [(f"{n // 2000}:{n % 2000}", n) for n in range(6000)]


def test_records(spark, tmp_path):
    (tmp_path / "r.txt").write_text("a\nb\n\nc\n")
    assert sorted(r.value.strip() for r in read_records(spark, str(tmp_path / "r.txt")).collect()) == ["a\nb", "c"]


SAM = "r1\t99\tchr1\t100\t60\t3S10M2I5D4M\t=\t200\t0\tACGT\tIIII\tNM:i:1\tRG:Z:x"


def test_sam(spark, tmp_path):
    path = tmp_path / "x.sam"
    path.write_text(f"@HD\tVN:1\n{SAM}\nbad line\nr2\tx\tchr1\t5\t1\t*\t*\t0\t0\tA\tI\nr3\t4\t*\t0\t0\t*\t*\t0\t0\tA\t*\n")
    got = rows(genomic.with_extent(genomic.read_sam(spark, str(path))).select("qname", "flag", "pos", "tags", "end", "encoding"), "qname")
    assert got == [("r1", 99, 100, ["NM:i:1", "RG:Z:x"], 118, "sanger"), ("r3", 4, 0, [], -1, None)]
    mapped = blocks.mapped_reads(genomic.read_sam(spark, str(path)), contigs(spark, 10, 1000))
    assert rows(mapped.select("qname", "idx")) == [("r1", 1)]


def test_mapped_reads_leave_out_later_contigs(spark):
    table = spark.createDataFrame([(24, "a", 1), (25, "b", 1)], "idx long, contig string, length long")
    reads = spark.createDataFrame([("x", 0, "a"), ("y", 0, "b"), ("z", 4, "a")], "qname string, flag int, contig string")
    assert [r.qname for r in blocks.mapped_reads(reads, table).collect()] == ["x"]


def test_alignment_end(spark):
    for cigar, end in (("10M", 109), ("5S10M", 109), ("5M5I5M", 109), ("5M3D2N5M", 114), ("4=1X", 104)):
        assert one(spark, cigar, alignment_end(F.lit(100), F.col("v"))) == end


def test_qualities(spark):
    assert one(spark, "!I" + chr(33 + 60), quality_encoding("v")) == "sanger"
    assert one(spark, "!I" + chr(33 + 61), quality_encoding("v")) == "illumina"
    assert one(spark, "*", quality_encoding("v")) is None
    assert one(spark, "@hU", fix_quality("v")) == "!I6"
    assert one(spark, "@h", bad_quality("v")) is False
    assert one(spark, "?h", bad_quality("v")) is True


def test_group_quality_is_judged_by_first_read(spark):
    reads = spark.createDataFrame(
        [("g", 2, "b", "II"), ("g", 1, "a", "hh"), ("g", 3, "c", "5h"), ("k", 1, "a", "II"), ("k", 2, "b", "hh")],
        "grp string, pos int, qname string, qual string",
    )
    got = rows(blocks.fix_group_qualities(reads, "grp").select("grp", "qname", "encoding", "qual", "bad_quality"), "grp", "qname")
    assert got == [
        ("g", "a", "illumina", "II", False), ("g", "b", "illumina", "**", False), ("g", "c", "illumina", "5I", True),
        ("k", "a", "sanger", "II", False), ("k", "b", "sanger", "hh", False),
    ]


def test_bed(spark, tmp_path):
    (tmp_path / "x.bed").write_text("track name=x\nchr1\t9\t20\tname\n#c\nchr2\t0\t1\n")
    assert rows(genomic.read_bed(spark, str(tmp_path / "x.bed")), "contig") == [("chr1", 9, 20), ("chr2", 0, 1)]
    assert [r.value for r in genomic.bed_header(spark, str(tmp_path / "x.bed")).collect()] == ["track name=x", "#c"]


# blocks


def reads_on(spark, n):
    return spark.range(n).select(F.lit(0).cast("long").alias("idx"), F.col("id").alias("pos"), F.col("id").cast("string").alias("qname"))


def test_block_slices(spark):
    sliced = blocks.block_slices(reads_on(spark, 100), contigs(spark, 44_500_000))  # 45 bins: 2 reads each, 3 blocks
    assert rows(sliced.groupBy("block").count(), "block") == [(1, 40), (2, 40), (3, 20)]
    few = blocks.block_slices(reads_on(spark, 10), contigs(spark, 44_500_000))
    assert rows(few.groupBy("block").count()) == [(3, 10)]
    assert blocks.block_slices(reads_on(spark, 1000), contigs(spark, 19_500_000)).count() == 1000


def test_block_weights(spark):
    counts = spark.createDataFrame([(0, 100)], "idx long, reads long")
    table = spark.createDataFrame([("chr0", 0, 1, 150), ("chr0", 0, 2, 60), ("chr0", 0, 45, 99)], "contig string, idx long, bin long, n long")
    got = rows(blocks.block_weights(counts, table, contigs(spark, 44_500_000)), "block")
    assert got == [(0, 1, 3, 2, 6), (0, 3, 3, 2, 2)]


def test_balanced_groups(spark):
    weights = spark.range(64).select((F.lit(0)).alias("idx"), F.col("id").alias("block"), (F.col("id") + 1).alias("weight"))
    loads = rows(blocks.balanced_groups(weights, 8).groupBy("group").agg(F.sum("weight"), F.count("*")), "group")
    assert loads == [(g, 260, 8) for g in range(1, 9)]


# intervals


def merged(spark, *values, **options):
    return rows(intervals.merge_intervals(spans(spark, *values), **options).select("start", "end"), "start")


def test_merge_gap(spark):
    assert merged(spark, (1, 100), (151, 160)) == [(1, 160)]
    assert merged(spark, (1, 100), (152, 160)) == [(1, 100), (152, 160)]
    assert merged(spark, (1, 100), (5, 20), (140, 150)) == [(1, 150)]
    assert merged(spark, (5, 6)) == [(5, 6)]


def test_merge_padded(spark):
    def padded(*values):
        return rows(intervals.merge_intervals_padded(spans(spark, *values), pad=10).select("start", "end"), "start")

    assert padded((5, 50), (60, 70)) == [(1, 50), (50, 70)]
    assert padded((50, 80), (89, 99)) == [(40, 99)]
    mixed = spans(spark, (1, 9), contig="chrA").unionByName(spans(spark, (12, 20), contig="CHRa"))
    assert rows(intervals.merge_intervals_padded(mixed, pad=10)) == [("chrA", 1, 20)]


def simple_merge(values, gap):
    out = []
    for s, e in sorted(values):
        if out and s <= out[-1][1] + gap:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [tuple(x) for x in out]


def test_merge_across_slabs_equals_simple_merge(spark):
    rng = random.Random(7)
    values = [(s, s + rng.choice((0, 3, 40, 900))) for s in (rng.randrange(20_000) for _ in range(400))]
    for slab in (1, 16, 1000, 65_536):
        assert merged(spark, *values, gap=2, slab=slab) == simple_merge(values, 2), slab


def test_islands_are_apart_and_cover_everything(spark):
    rng = random.Random(3)
    values = [(s, s + rng.randrange(60)) for s in (rng.randrange(50_000) for _ in range(500))]
    got = merged(spark, *values)
    assert all(b[0] > a[1] + 51 for a, b in zip(got, got[1:]))
    assert all(any(s <= v[0] and v[1] <= e for s, e in got) for v in values)


def test_intersect(spark):
    def overlap(a, b, **options):
        return rows(intervals.interval_intersect(spans(spark, *a), spans(spark, *b), **options).select("start", "end"), "start", "end")

    assert overlap([(0, 10)], [(10, 20)]) == []
    assert overlap([(0, 5000)], [(100, 4000)], bin_width=64) == [(100, 4000)]
    assert overlap([(0, 10), (20, 30)], [(5, 25)]) == [(5, 10), (20, 25)]
    assert overlap([(5, 5)], [(0, 10)]) == []
    rng = random.Random(5)
    a = [(s, s + rng.randrange(1, 300)) for s in (rng.randrange(5000) for _ in range(120))]
    b = [(s, s + rng.randrange(1, 300)) for s in (rng.randrange(5000) for _ in range(120))]
    want = sorted((max(x[0], y[0]), min(x[1], y[1])) for x in a for y in b if x[0] < y[1] and y[0] < x[1])
    assert overlap(a, b, bin_width=100) == want


def test_crowded_bins_on_both_sides(spark, monkeypatch):
    """All bins swept by strips, against all pairs; equal starts, equal intervals, intervals over many bins."""
    monkeypatch.setattr(intervals, "CROWDED", 0)
    monkeypatch.setattr(intervals, "STRIP", 3)
    rng = random.Random(6)
    for width, spread in ((40, 300), (1000, 40)):
        a, b = ([(s, s + rng.randrange(1, 90)) for s in (rng.randrange(spread) for _ in range(70))] for _ in range(2))
        want = sorted((max(x[0], y[0]), min(x[1], y[1]), *x, *y) for x in a for y in b if x[0] < y[1] and y[0] < x[1])
        got = intervals.interval_intersect(spans(spark, *a), spans(spark, *b), bin_width=width).drop("contig")
        assert sorted(map(tuple, got.collect())) == want


def test_a_crowded_bin_costs_what_overlaps(spark):
    """A hundred thousand intervals a side in one bin, ten thousand million pairs, of which one in 10^5 overlaps."""
    n = 100_000
    a = spark.range(n).selectExpr("'c' as contig", "id * 4 as start", "id * 4 + 2 as end")
    b = spark.range(n).selectExpr("'c' as contig", "id * 4 + if(id % 10 = 0, 1, 2) as start", "id * 4 + 4 as end")
    got = intervals.interval_intersect(a, b, bin_width=1 << 30)
    assert got.agg(F.count("*"), F.sum(F.col("end") - F.col("start"))).first() == (n // 10, n // 10)


def test_interval_text(spark, tmp_path):
    df = spans(spark, (1, 100), (200, 300), contig="chr1")
    assert [r.value for r in intervals.to_bed(df).collect()] == ["chr1\t0\t99", "chr1\t199\t299"]
    assert intervals.to_bed(df, half_open=True).first().value == "chr1\t0\t100"
    assert [r.value for r in intervals.to_region(df).collect()] == ["chr1:1-100", "chr1:200-300"]
    assert rows(intervals.region_envelope(df, F.lit(1).alias("g"))) == [(1, 1, 300, 2, "2regions_chr1-1")]
    sinks.write_bed(df, str(tmp_path / "bed"))
    assert rows(genomic.read_bed(spark, str(tmp_path / "bed")), "start") == [("chr1", 0, 99), ("chr1", 199, 299)]
    sinks.write_regions(df, str(tmp_path / "regions"))
    assert read_lines(spark, str(tmp_path / "regions")).count() == 2


# variants


def test_chromosome_numbers(spark):
    for name, code in (("chr7", 7), ("chrX", 23), ("chrY", 24), ("chrM", None)):
        assert one(spark, name, chrom_code("v")) == code


def vcf(spark, *keys):
    return genomic.parse_vcf(lines_of(spark, "##header", "#CHROM chr", "", *["\t".join((c, p, ".", r, a, "x")) for c, p, r, a in keys]))


def test_concordance(spark):
    reference = vcf(spark, ("chr1", "5", "A", "C"), ("chr1", "5", "A", "C"), ("chr2", "7", "A", "G"), ("chr3", "1", "T", "C"))
    mine = vcf(spark, ("chr1", "5", "A", "C"), ("chr2", "7", "A", "G"), ("chr2", "7", "A", "T"), ("7", "1", "A", "T"))
    assert rows(variants.variant_concordance(reference, mine)) == [(3, 2, 1)]
    assert rows(variants.missed_variants(reference, mine)) == [("chr3", 1, "T", "C")]


def test_variant_body(spark, tmp_path):
    table = vcf(spark, ("chrY", "1", "A", "C"), ("chr10", "2", "A", "C"), ("chr2", "30", "A", "C"), ("chr2", "4", "A", "C"), ("chrM", "1", "A", "C"))
    sinks.write_vcf_body(table, str(tmp_path / "v"))
    written = genomic.read_vcf(spark, str(tmp_path / "v"))
    assert sorted(rows(written.select("chrom", "pos"))) == [("chr10", 2), ("chr2", 4), ("chr2", 30), ("chrY", 1)]
    assert [r.line.split("\t")[0] for r in variants.sorted_variants(table).collect()] == ["chr2", "chr2", "chr10", "chrY"]
