import json
import os

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from tests.helpers import rows
from tidemark import session
from tidemark.operators import language
from tidemark.sources import fastq
from tidemark.streaming import arrivals, trends


def read_text(name, n):
    return f"@r{n}/{name}\nAC{n}\n+\nII\n"


def write_pair(tmp_path, first, second):
    paths = []
    for side, n in ((1, first), (2, second)):
        path = tmp_path / f"fastq{side}.fq"
        path.write_text("".join(read_text(side, i) for i in range(n)))
        paths.append(str(path))
    return paths


def test_pairs_stop_at_the_shorter_file(spark, tmp_path):
    pairs = fastq.read_fastq_pair(spark, *write_pair(tmp_path, 5, 7))
    got = rows(pairs.select("read", "name1", "seq1", "name2"), "read")
    assert got == [(i, f"@r{i}/1", f"AC{i}", f"@r{i}/2") for i in range(5)]


def test_neighbouring_reads_are_shuffled_together(spark, tmp_path):
    plan = fastq.read_fastq_pair(spark, *write_pair(tmp_path, 5, 5))._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(_block" in plan and "hashpartitioning(read" not in plan and "ObjectHashAggregate" not in plan
    assert plan.count("BroadcastHashJoin") == 2 and "SortMergeJoin" not in plan  # lines get their numbers without a shuffle


def test_chunks(spark, tmp_path):
    chunks = fastq.fastq_chunks(fastq.read_fastq_pair(spark, *write_pair(tmp_path, 5, 5)), reads_per_chunk=2)
    assert [r.chunk for r in chunks.orderBy("read").collect()] == [1, 1, 2, 2, 3]
    out = tmp_path / "chunks"
    fastq.write_fastq_chunks(chunks, str(out))
    files = {p.name: list(p.glob("part-*")) for p in out.glob("chunk=*")}
    assert {k: len(v) for k, v in files.items()} == {"chunk=1": 1, "chunk=2": 1, "chunk=3": 1}
    assert files["chunk=2"][0].read_text() == "".join(read_text(s, n) for n in (2, 3) for s in (1, 2))


def test_arrivals_are_seen_once(spark, tmp_path):
    inbox, out, state = (tmp_path / n for n in ("in", "out", "state"))
    inbox.mkdir()

    def run():
        stream = arrivals.read_file_arrivals(spark, str(inbox))
        arrivals.write_file_arrivals(stream, str(out), str(state), availableNow=True).awaitTermination()
        done = spark.read.parquet(str(out))
        return sorted((r.file.rsplit("/", 1)[1], r.lines) for r in done.select("file", "lines").collect())

    (inbox / "chunk_1.fq").write_text("a\nb\n")
    assert run() == [("chunk_1.fq", 2)]
    (inbox / "chunk_10.fq").write_text("c\n")
    assert run() == [("chunk_1.fq", 2), ("chunk_10.fq", 1)]


def test_stream_gives_closed_windows_only_and_survives_a_restart(spark, tmp_path):
    inbox, out, state = (tmp_path / n for n in ("in", "out", "state"))
    inbox.mkdir()
    schema = "id long, user string, rt long, text string, ts timestamp"

    def run(name, *posts):
        lines = [{"id": i, "user": "u", "rt": rt, "text": text, "ts": f"2024-01-01T00:00:{s:02}Z"} for i, rt, text, s in posts]
        (inbox / name).write_text("\n".join(map(json.dumps, lines)))
        stream = trends.retweet_growth_stream(trends.read_posts_stream(spark, str(inbox), schema), 4, 4, 2)
        trends.write_trends_stream(stream, str(out), str(state), availableNow=True).awaitTermination()
        got = spark.read.parquet(str(out)).select(F.second("window_start"), "key", "id", "growth", "n")
        return sorted(rows(got))

    first = run("1.json", (1, 5, "#a", 0), (1, 8, "#a", 1), (2, 1, "#a", 2), (3, 1, "#b", 3), (4, 1, "#c", 9))
    # growth 4 and 1 with two uses of #a; #b is used once and does not grow; the window from 8 on is still open
    assert first == [(0, "#a", 1, 4, 2), (0, "#a", 2, 1, 2)]
    second = run("2.json", (9, 2, "late #a", 1), (5, 1, "#c", 10), (6, 1, "x", 20))
    assert second == [*first, (8, "#c", 4, 1, 2), (8, "#c", 5, 1, 2)]


def test_batches_leave_nothing_behind(spark, tmp_path):
    """Language model once, twenty batches: as many scratch folders after the last batch as after the first."""
    known = spark.createDataFrame([("en", "the this that then there"), ("de", "der die das und oder")], "lang string, text string")
    ready = language.prepare_profiles(language.lang_profiles(known, "text"))
    scratch = session._run_folder(spark).removeprefix("file:")
    inbox, out, state = (tmp_path / n for n in ("in", "out", "state"))
    inbox.mkdir()
    for i in range(20):
        posts = [{"id": k, "user": "u", "rt": i, "text": f"this and that #t{i}", "ts": f"2024-01-01T00:{i:02}:00Z"} for k in (i, i + 100)]
        (inbox / f"{i:02}.json").write_text("\n".join(map(json.dumps, posts)))
    seen = []

    def report(tagged):
        seen.append(len(os.listdir(scratch)))
        return trends.trend_of_tags(language.posts_in(tagged, "text", ready).select(*tagged.columns))

    posts = trends.read_posts_stream(spark, str(inbox), "id long, user string, rt long, text string, ts timestamp", maxFilesPerTrigger="1")
    growth = trends.retweet_growth_stream(posts, 120, 60, 10)
    plan = growth._jdf.queryExecution().analyzed().toString()
    assert plan.count("Aggregate [") == 2
    trends.write_trends_stream(growth, str(out), str(state), report, availableNow=True).awaitTermination()
    assert len(seen) >= 20 and len(set(seen)) == 1
    assert spark.read.parquet(str(out)).count() > 0


def test_state_partitions_follow_the_posts_and_the_state_is_on_disk(spark, tmp_path, monkeypatch):
    """Twelve partitions where the session has eight; results are those of a session's own store, and the session keeps its settings."""
    monkeypatch.setattr(trends, "ROWS_PER_PARTITION", 5)
    assert trends.state_partitions(spark, 58) == 12 and trends.state_partitions(spark, 0) == 8
    inbox = tmp_path / "in"
    inbox.mkdir()
    posts = [{"id": i % 7, "user": "u", "rt": i, "text": f"#t{i % 3}", "ts": f"2024-01-01T00:00:{i:02}Z"} for i in range(58)]
    (inbox / "1.json").write_text("\n".join(map(json.dumps, posts)))
    names = [trends.PARTITIONS, trends.STATE_STORE, "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage"]
    before = [spark.conf.get(name, None) for name in names]

    def run(name, partitions):
        stream = trends.read_posts_stream(spark, str(inbox), "id long, user string, rt long, text string, ts timestamp")
        growth = trends.retweet_growth_stream(stream, 4, 2, 2)
        out, state = tmp_path / f"{name}-out", tmp_path / f"{name}-state"
        trends.write_trends_stream(growth, str(out), str(state), partitions=partitions, availableNow=True).awaitTermination()
        folders = [p for p in (state / "state" / "0").iterdir() if p.name.isdigit()]
        return len(folders), (state / "offsets" / "0").read_text(), sorted(rows(spark.read.parquet(str(out)).drop("batch")))

    count, offsets, found = run("disk", trends.state_partitions(spark, 58))
    assert count == 12 and "RocksDBStateStoreProvider" in offsets
    assert [spark.conf.get(name, None) for name in names] == before
    own = "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider"
    assert found and found == run("memory", None)[2] and own not in offsets


def test_report_reads_files_and_not_the_state(spark, tmp_path):
    """A task of the report has no store in its lineage, as each would send the metrics of all partitions to the driver. The
    files are there while the report runs, nothing is cached, and they go with the batch, also if it fails."""
    scratch = session._run_folder(spark).removeprefix("file:")
    inbox = tmp_path / "in"
    inbox.mkdir()
    posts = [{"id": i % 7, "user": "u", "rt": i, "text": f"#t{i % 3}", "ts": f"2024-01-01T00:00:{i:02}Z"} for i in range(58)]
    (inbox / "1.json").write_text("\n".join(map(json.dumps, posts)))
    before, cached, seen = set(os.listdir(scratch)), spark.sparkContext._jsc.getPersistentRDDs().size(), []

    def report(tagged):
        lineage = tagged._jdf.queryExecution().toRdd().toDebugString()
        seen.append(("StateStore" in lineage, all(f.startswith("file:") for f in tagged.inputFiles()) and len(tagged.inputFiles()) > 0))
        seen[-1] += (len(set(os.listdir(scratch)) - before), spark.sparkContext._jsc.getPersistentRDDs().size() - cached)
        return trends.trend_of_tags(tagged)

    def fails(tagged):
        seen.append(None)
        raise ValueError("no report")

    def run(name, what):
        stream = trends.read_posts_stream(spark, str(inbox), "id long, user string, rt long, text string, ts timestamp")
        growth = trends.retweet_growth_stream(stream, 4, 2, 2)
        query = trends.write_trends_stream(growth, str(tmp_path / f"{name}-out"), str(tmp_path / f"{name}-state"), what, availableNow=True)
        query.awaitTermination()

    run("whole", report)
    assert len(seen) >= 2 and set(seen) == {(False, True, 1, 0)}
    assert set(os.listdir(scratch)) == before
    assert spark.read.parquet(str(tmp_path / "whole-out")).count() > 0
    with pytest.raises(StreamingQueryException):
        run("broken", fails)
    assert seen[-1] is None and set(os.listdir(scratch)) == before


def test_state_partitions_follow_the_posts_where_the_session_has_many(spark):
    """Every task of a stateful stage sends the driver a metric for every partition."""
    before = spark.conf.get(trends.PARTITIONS)
    spark.conf.set(trends.PARTITIONS, "5000")
    try:
        assert [trends.state_partitions(spark, rows) for rows in (0, 1_000_000, 36_000_000)] == [200, 200, 360]
    finally:
        spark.conf.set(trends.PARTITIONS, before)
