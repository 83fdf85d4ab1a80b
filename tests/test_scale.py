"""What only shows beyond the size of the test tables: large numbers, many keys, equal rows, blocks without variants."""

import datetime

from pyspark.sql import functions as F

from tests.helpers import lines_of, rows
from tidemark.operators import blocks, graph, hashtags, intervals, language
from tidemark.sources import archives, genomic
from tidemark.sources.text import read_numbered_lines


def test_positions_beyond_two_billion(spark):
    line = "\t".join(["r", "0", "chr1", "15000000001", "60", "4M", "=", "15000000009", "-5000000000", "ACGT", "IIII"])
    read = genomic.parse_sam(lines_of(spark, line)).first()
    assert (read.pos, read.pnext, read.tlen) == (15000000001, 15000000009, -5000000000)


def test_file_order_is_by_number(spark, tmp_path):
    for name, text in (("part-100000-x.txt", "third"), ("part-10001-x.txt", "second"), ("part-9-x.txt", "first")):
        (tmp_path / name).write_text(text + "\n")
    assert rows(read_numbered_lines(spark, str(tmp_path)), "line_no") == [("first", 0), ("second", 1), ("third", 2)]


def test_posts_without_text_have_no_tags(spark):
    posts = spark.createDataFrame([(1, None), (2, "a #b")], "id long, text string")
    assert sorted((r.key, r.is_tag) for r in hashtags.explode_tags(posts).collect()) == [("#b", 1), ("1", 0)]


def test_piles_of_equal_intervals(spark, monkeypatch):
    monkeypatch.setattr(intervals, "EQUAL_ROWS", 10)
    a = spark.createDataFrame([("c", 5, 9)] * 45 + [("c", 7, 30)], "contig string, start long, end long")
    b = spark.createDataFrame([("c", 6, 8)] * 12, "contig string, start long, end long")
    got = intervals.interval_intersect(a, b, bin_width=4)
    assert got.count() == 46 * 12 and got.filter("a_end = 9").count() == 45 * 12
    assert intervals._counted(a, "a").agg(F.max("a_times")).first()[0] == 10


def test_blocks_without_variants_are_dealt_too(spark):
    contigs = spark.createDataFrame([(0, "a", 90_000_000_000), (1, "b", 90_000_000_000)], "idx long, contig string, length long")
    counts = spark.createDataFrame([(0, 900_000_000), (1, 900_000_000)], "idx long, reads long")
    density = spark.createDataFrame([("a", 0, n, 50) for n in range(1, 5)], "contig string, idx long, bin long, n long")
    weights = blocks.all_block_weights(counts, density, contigs)
    known = blocks.block_weights(counts, density, contigs)
    assert weights.count() == sum(r.blocks for r in blocks.contig_blocks(counts, contigs).collect()) > 2 * known.count()
    groups = blocks.balanced_groups(weights, 4).groupBy("group").agg(F.sum("weight").alias("w"), F.count("*").alias("n")).collect()
    largest = max(r.weight for r in weights.collect())
    assert max(r.w for r in groups) - min(r.w for r in groups) <= largest


def test_repeated_posts_are_judged_once(spark):
    known = spark.createDataFrame([("en", "the this that then there"), ("de", "der die das und oder")], "lang string, text string")
    posts = spark.createDataFrame([(1, "this and that")] * 3 + [(1, "das und der")], "id long, text string")
    ready = language.prepare_profiles(language.lang_profiles(known, "text"))
    assert rows(language.posts_in(posts, "text", ready)) == [(1, "this and that", "en")] * 3
    assert language.lang_profiles(known, "text", top=2).count() == 4


def test_more_languages_than_columns(spark):
    known = spark.range(1500).selectExpr("concat('l', id) as lang", "translate(cast(id as string), '0123456789', 'abcdefghij') as text")
    texts = spark.createDataFrame([(1, "bcd"), (2, "")], "id long, text string")
    got = dict(rows(language.detect_lang(texts, "id", "text", language.lang_profiles(known, "text")).select("id", "detected")))
    assert got == {1: "l123", 2: None}


def test_hops_read_only_the_last_round(spark, monkeypatch):
    read = []
    materialise = graph.materialise
    monkeypatch.setattr(graph, "materialise", lambda df, label: read.append((label, df.inputFiles())) or materialise(df, label))
    members = spark.createDataFrame([(i + j, f"g{i}") for i in range(9) for j in (0, 1)], "id long, grp string")
    assert dict(rows(graph.shortest_hops(members, 0))) == {i: i for i in range(10)}
    rounds = [{int(f.split("distance=")[1].split("/")[0]) for f in files if "distance=" in f} for label, files in read if label == "groups"]
    assert len(rounds) == 10 and all(r <= {n} for n, r in enumerate(rounds))
    assert dict(rows(graph.shortest_hops(members, 0, max_hops=2))) == {0: 0, 1: 1, 2: 2}


def test_archives_opened_by_spark(spark, tmp_path):
    block = b"hello"
    (tmp_path / "a.warc").write_bytes(b"WARC/1.0\r\nWARC-Target-URI: u\r\nContent-Length: 5\r\n\r\n" + block + b"\r\n\r\n")
    (tmp_path / "b.warc").write_bytes(b"damaged")
    got = archives.scan_archive_files(spark, str(tmp_path)).select("target_uri", "payload", "failure")
    assert sorted(map(str, rows(got))) == ["('u', 'hello', None)", "(None, None, 'segment')"]


def test_windows_keep_posts_without_an_id(spark):
    at = datetime.datetime(2024, 1, 1, 0, 0, 1)
    posts = spark.createDataFrame([(None, "u", 3, "t", at), (1, "v", 5, "s", at)], "id long, user string, rt long, text string, ts timestamp")
    got = hashtags.retweet_growth(posts, 4, 2)
    assert sorted(str((r.id, r.user, r.growth)) for r in got.collect()) == ["(1, 'v', 1)"] * 2 + ["(None, 'u', 1)"] * 2
