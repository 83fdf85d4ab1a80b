import gzip
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.helpers import rows
from tidemark.operators import phones
from tidemark.sources import archives, sinks
from tidemark.sources.text import read_manifest


def found(spark, text, **options):
    df = spark.createDataFrame([(text,)], "text string")
    return sorted(r.num for r in phones.extract_phones(df, "text", **options).collect())


def test_phone_forms(spark):
    assert found(spark, "tel +31 (0)6-1234 5678") == ["+31612345678"]
    assert found(spark, "x0031 20 1234567") == ["+31201234567"]
    assert found(spark, "0031201234567") == []
    assert found(spark, "+31201234567 and +31 20 1234567, +3120123456") == ["+31201234567"]
    assert found(spark, "+1 (212) 555-0199", country="1", digits=10) == ["+12125550199"]


def test_index_parts_hold_all_urls(spark, tmp_path):
    pages = [("+31", f"u{i:02}") for i in range(25)] + [("+32", "a"), ("+32", "a")]
    index = phones.phone_index(spark.createDataFrame(pages, "num string, url string"), urls_per_row=10)
    got = rows(index, "num", "part")
    assert [(n, p, u.count("\t")) for n, p, u in got] == [("+31", 0, 10), ("+31", 1, 10), ("+31", 2, 5), ("+32", 0, 2)]
    assert "".join(u for n, _, u in got if n == "+31") == "".join(f"u{i:02}\t" for i in range(25))
    assert got[-1][2] == "a\ta\t"
    sinks.write_phone_index(index, str(tmp_path / "index"))
    assert spark.read.parquet(str(tmp_path / "index")).dtypes == [("num", "string"), ("part", "bigint"), ("urls", "string")]


def record(uri, block, kind="resource", content="text/html"):
    target = f"WARC-Target-URI: {uri}\r\n" if uri else ""
    head = f"WARC/1.0\r\nWARC-Type: {kind}\r\n{target}Content-Type: {content}\r\nContent-Length: {len(block)}\r\n\r\n"
    return head.encode() + block + b"\r\n\r\n"


def http(body, *headers):
    return b"HTTP/1.1 200 OK\r\n" + b"".join(h + b"\r\n" for h in headers) + b"\r\n" + body


@pytest.fixture
def manifest(spark, tmp_path):
    def build(*archives_, extra=()):
        names = []
        for i, data in enumerate(archives_):
            path = tmp_path / f"a{i}.warc"
            path.write_bytes(data)
            names.append(f"file:{path}")
        listing = tmp_path / "manifest.txt"
        listing.write_text("\n".join([*names, *extra]) + "\n")
        return read_manifest(spark, str(listing), partitions=3)

    return build


def test_scan_plain_and_packed(spark, manifest):
    plain = record(None, b"about", "warcinfo") + record("u1", b"one") + record("u2", "zwölf".encode())
    packed = b"".join(gzip.compress(r) for r in (record("u3", b"three"), record("u4", b"four")))
    got = archives.scan_warc(manifest(plain, packed))
    assert rows(got.select("target_uri", "payload"), "target_uri") == [
        ("u1", "one"), ("u2", "zwölf"), ("u3", "three"), ("u4", "four"),
    ]


def test_http_payloads(spark, manifest):
    kind = {"kind": "response", "content": "application/http; msgtype=response"}
    data = (
        record("a", http(b"plain"), **kind)
        + record("b", http(b"4\r\nchun\r\n3\r\nked\r\n0\r\n\r\n", b"Transfer-Encoding: chunked"), **kind)
        + record("c", http(gzip.compress(b"packed"), b"Content-Encoding: gzip"), **kind)
        + record("d", http(b"not packed", b"Content-Encoding: gzip"), **kind)
    )
    got = archives.scan_warc(manifest(data)).select("target_uri", "payload")
    assert rows(got, "target_uri") == [("a", "plain"), ("b", "chunked"), ("c", "packed"), ("d", "not packed")]


def test_failures_are_counted_and_good_records_kept(spark, manifest):
    cut = record("u1", b"good") + record("u2", b"lost" * 50)[:-100]
    wrong = record("u3", b"\xff\xfe") + record("u4", b"fine")
    listing = manifest(cut, wrong, b"no archive", extra=["file:/nowhere", "s3:/bad", "http://other/x"])
    scan, counters = archives.observed_scan(listing)
    assert sorted(r.target_uri for r in scan.collect()) == ["u1", "u4"]
    assert counters.get == {"failed_segments": 4, "failed_records": 1, "skipped_archives": 1}


def everything(df):
    return sorted(map(str, df.collect()))


def ranges_of(listing, split_bytes):
    return sorted((r.uri[-6:], r.start, r.end) for r in archives.archive_ranges(listing, split_bytes).collect())


def split_locally(uri, split_bytes):
    """The rows of an archive by its ranges, without Spark."""
    listing = pd.DataFrame({"number": [0], "uri": [uri]})
    pieces = pd.concat(archives._cut(split_bytes)(iter([listing])))
    if (pieces.end < 0).all():
        return list(archives._archive_rows(uri))
    traced = pd.concat(archives._trace(iter([pieces])))
    while True:
        chained = archives._chained(traced)
        wrong = chained[~chained.right.astype(bool)]
        if not len(wrong):
            break
        again = pd.concat(archives._trace(iter([wrong.drop(columns="right")])))
        traced = pd.concat([traced[~traced.end.isin(wrong.end)], again])
    return [row for r in chained.itertuples() for row in archives._archive_rows(uri, r.start, r.end)]


def odd_archives():
    """Members of one record, of several, with a record over two members; plain archives; pages that hold archives; damage."""
    inner = gzip.compress(record("inner", b"not a record of its own" * 3))
    records = [record(f"u{i}", f"text {i} ".encode() * (i % 20)) for i in range(30)]
    cut = b"".join(records)
    packed = [gzip.compress(r) for r in records]
    # not packed at all within its member, so the member inside looks like one of the archive
    holders = (records[5], record("holder", inner * 3), records[6], record("h2", b"\r\n\r\n" + records[7]), record("bad", b"\xff"))
    return {
        "ones": b"".join(packed),
        "joined": b"".join(gzip.compress(b"".join(records[i : i + 7])) for i in range(0, 30, 7)),
        "spread": b"".join(gzip.compress(cut[i : i + 500]) for i in range(0, len(cut), 500)),
        "hidden": b"".join(gzip.compress(r, compresslevel=0) for r in holders),
        "plain": records[1] + record("p", b"\r\n\r\n" + records[2] * 3) + cut,
        "one member": gzip.compress(cut),
        "empty": b"",
        "padded": b"".join(packed) + b"\0" * 100,
        "cut": cut[:-100],
        "cut member": b"".join(packed)[:-30],
        "damaged": b"".join(packed[:9]) + packed[9][:-20] + b"".join(packed[10:]),
        "gap": cut[:3000] + b"nothing" + cut[3000:],
    }


@pytest.mark.parametrize("name", list(odd_archives()))
def test_ranges_of_any_size_give_the_same_rows(tmp_path, name):
    path = tmp_path / "a.warc"
    path.write_bytes(odd_archives()[name])
    want = list(archives._archive_rows(f"file:{path}"))
    for split_bytes in (1, 13, 150, 700, 4000):
        assert split_locally(f"file:{path}", split_bytes) == want, split_bytes


def test_rounds_do_not_grow_with_the_ranges(tmp_path):
    """Every page holds a record, so that most ranges are first traced from a wrong place."""
    path = tmp_path / "a.warc"
    path.write_bytes(b"".join(record(f"u{i}", bytes(97) * (i % 7) + record("inside", b"old") + bytes(100 * (i % 2))) for i in range(300)))
    listing = pd.DataFrame({"number": [0], "uri": [f"file:{path}"]})
    traced = pd.concat(archives._trace(archives._cut(700)(iter([listing]))))
    rounds = 0
    while len(wrong := (chained := archives._chained(traced))[~chained.right.astype(bool)]):
        rounds += 1
        traced = pd.concat([traced[~traced.end.isin(wrong.end)], *archives._trace(iter([wrong.drop(columns="right")]))])
    assert rounds <= 3 and len(chained) > 100
    got = [row for r in chained.itertuples() for row in archives._archive_rows(f"file:{path}", r.start, r.end)]
    assert got == list(archives._archive_rows(f"file:{path}"))


def test_split_archives_in_tasks(spark, manifest):
    listing = manifest(*odd_archives().values(), extra=["file:/nowhere", "s3:/bad", "nowhere://x"])
    assert everything(archives.scan_archives(listing, 2000)) == everything(archives.scan_archives(listing))


def test_large_archive_is_read_by_ranges(spark, manifest):
    packed = b"".join(gzip.compress(record(f"u{i}", random.Random(i).randbytes(300).hex().encode())) for i in range(2000))
    listing = manifest(packed)
    cuts = ranges_of(listing, len(packed) // 10)
    assert len(cuts) >= 10 and cuts[0][1] == 0 and all(a[2] <= b[1] for a, b in zip(cuts, cuts[1:]))
    got = archives.scan_warc(listing, len(packed) // 10)
    assert got.select(F.spark_partition_id().alias("p")).distinct().count() >= 5
    assert got.count() == got.select("target_uri").distinct().count() == 2000
    # an archive of one member stays whole: the later ranges have no record to begin with
    assert len(ranges_of(manifest(gzip.compress(b"".join(record(f"u{i}", bytes(range(200))) for i in range(500)))), 500)) == 1


def test_scan_to_index(spark, manifest):
    data = record("u1", b"call +31 20 1234567") + record("u2", b"or 0031201234567, x0031201234567")
    found_ = phones.extract_phones(archives.scan_warc(manifest(data)), "payload", "target_uri")
    index = phones.phone_index(found_, "target_uri")
    assert rows(index.select("num", "urls")) == [("+31201234567", "u1\tu2\t")]


def test_manifest_is_spread(spark, manifest):
    listing = manifest(extra=[f"file:/x{i}" for i in range(50)])
    assert listing.select(F.spark_partition_id().alias("p")).distinct().count() == 3
