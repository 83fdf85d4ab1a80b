"""Each program from files to files."""

import glob
import json

import pytest

from tests.test_streams import read_text
from tests.test_web import record
from tidemark import programs
from tidemark.operators import language

DICT = "@HD\tVN:1.0\tSO:x\n@SQ\tSN:chr1\tLN:44500000\tUR:x\tM5:y\n@SQ\tSN:chr2\tLN:900\tUR:x\tM5:y\n"


def put(tmp_path, name, text):
    path = tmp_path / name
    path.write_bytes(text) if isinstance(text, bytes) else path.write_text(text)
    return str(path)


def text_of(path):
    """All lines of a sorted text output, in the order of its part files."""
    return "".join(open(p).read() for p in sorted(glob.glob(f"{path}/part-*"))).splitlines()


def test_word_frequency(spark, tmp_path):
    programs.word_frequency(spark, put(tmp_path, "in.txt", "a b\nb a b\n"), str(tmp_path / "out"))
    assert text_of(tmp_path / "out") == ["b:3", "\ta:2", "a:2", "\tb:1"]


def test_phone_index(spark, tmp_path, capsys):
    archive = put(tmp_path, "a.warc", record("u1", b"x +31 20 1234567") + record("u2", b"\xff"))
    manifest = put(tmp_path, "list", f"file:{archive}\nfile:/nowhere\n")
    programs.phone_index(spark, manifest, str(tmp_path / "out"))
    assert [tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [("+31201234567", 0, "u1\t")]
    assert "Failed segments: 1\nFailed parses: 1" in capsys.readouterr().err


def test_separation(spark, tmp_path):
    males = put(tmp_path, "m", "Root\t\tX (2012)\n\nAbe\t\tX (2012)\n\t\t\tY (2013)\n\nOld\t\tZ (1999)\n")
    females = put(tmp_path, "f", "Eve\t\tY (2013)\n")
    programs.separation(spark, males, females, str(tmp_path / "out"), root="Root")
    lines = text_of(tmp_path / "out")
    assert lines[0].startswith("Total number of actors = 3, out of which 2 (66%) are males")
    assert lines[2:4] == [
        "There are 1 (50.0%) actors and 0 (0.0%) actresses at distance 1",
        "There are 0 (0.0%) actors and 1 (100.0%) actresses at distance 2",
    ]


def test_genome_programs(spark, tmp_path):
    known = put(tmp_path, "known.vcf", "#h\n" + "".join(f"chr1\t{p}\t.\tA\tC\n" for p in (5, 6, 1_000_000, 44_000_000)))
    dictionary = put(tmp_path, "x.dict", DICT)
    densities, reads = str(tmp_path / "density"), str(tmp_path / "reads")
    programs.variant_density(spark, known, dictionary, densities)
    assert text_of(densities) == ["(chr1,0,1,2)", "(chr1,0,2,1)", "(chr1,0,45,1)"]

    lines = [f"r{i}\t0\tchr1\t{i * 400_000 + 1}\t9\t100M\t*\t0\t0\tA\tI" for i in range(100)] + ["u\t4\t*\t0\t0\t*\t*\t0\t0\tA\tI"]
    (tmp_path / "sam").mkdir()
    put(tmp_path / "sam", "x.sam", "@HD\n" + "\n".join(lines) + "\n")
    programs.read_groups(spark, str(tmp_path / "sam"), dictionary, densities, reads, groups=2)
    placed = spark.read.parquet(reads)
    assert placed.count() == 100
    assert sorted(r["count"] for r in placed.groupBy("block").count().collect()) == [20, 40, 40]

    targets = put(tmp_path, "t.bed", "track x\nchr1\t50\t400050\nchr2\t0\t9\n")
    programs.group_regions(spark, reads, targets, str(tmp_path / "regions"))
    assert text_of(tmp_path / "regions" / "targets") == ["track x", "chr1\t50\t99", "chr1\t400000\t400050"]
    assert sum(len(text_of(p)) for p in glob.glob(str(tmp_path / "regions" / "regions" / "group=*"))) == 100


def test_calls(spark, tmp_path, capsys):
    calls = put(tmp_path, "a.vcf", "#x\nchr2\t9\t.\tA\tC\nchr2\t1\t.\tA\tC\nchrX\t1\t.\tA\tC\n")
    programs.sorted_calls(spark, calls, str(tmp_path / "out"))
    assert [line.split("\t")[:2] for line in text_of(tmp_path / "out")] == [["chr2", "1"], ["chr2", "9"], ["chrX", "1"]]
    programs.concordance(spark, calls, put(tmp_path, "b.vcf", "chr2\t1\t.\tA\tC\n"))
    assert capsys.readouterr().out == "total = 3\nmatches = 1\ndiff = 2\n"


def test_chunks_and_arrivals(spark, tmp_path):
    pair = [put(tmp_path, f"{s}.fq", "".join(read_text(s, i) for i in range(5))) for s in (1, 2)]
    chunks, out = str(tmp_path / "chunks"), str(tmp_path / "out")
    programs.fastq_chunks(spark, *pair, chunks, reads=2)
    programs.chunk_arrivals(spark, chunks, out, str(tmp_path / "state"))
    assert sorted(r.lines for r in spark.read.parquet(out).collect()) == [8, 16, 16]


def test_trending(spark, tmp_path):
    known = spark.createDataFrame(
        [("the cat and the dog and the house", "en"), ("der hund und die katze und das haus", "de")], "text string, lang string"
    )
    language.lang_profiles(known, "text").write.parquet(str(tmp_path / "profiles"))
    (tmp_path / "in").mkdir()
    posts = [(1, 5, "the dog #a", 0), (1, 9, "the dog #a", 1), (2, 1, "the cat #a", 1), (3, 9, "und der hund #a", 1), (4, 1, "the cat", 99)]
    lines = [{"id": i, "user": "u", "rt": rt, "text": t, "ts": f"2024-01-01T00:{s // 60:02}:{s % 60:02}Z"} for i, rt, t, s in posts]
    lines.append({**lines[2], "id": 7, "is_retweet": True, "rt_id": 2, "rt_user": "v", "rt_rt": 4, "rt_text": "the cat #a"})
    put(tmp_path / "in", "1.json", "\n".join(json.dumps({"is_retweet": False, **line}) for line in lines))
    out = str(tmp_path / "out")
    programs.trending(spark, str(tmp_path / "in"), str(tmp_path / "profiles"), out, str(tmp_path / "state"), 4, 4, 2, every="")
    got = spark.read.parquet(out).select("key", "id", "growth", "n").collect()
    assert sorted(map(tuple, got)) == [("#a", 1, 5, 2), ("#a", 2, 4, 2)]


def test_command_line():
    options = programs.parser().parse_args(["separation", "m", "f", "o", "R"])
    assert (options.program, options.males, options.root) == ("separation", "m", "R")
    with pytest.raises(SystemExit):
        programs.parser().parse_args(["concordance", "only-one"])
