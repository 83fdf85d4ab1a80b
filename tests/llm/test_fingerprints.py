"""Sketch fingerprints against sets of paragraphs."""

import hashlib
import random
import re

from pyspark.sql import functions as F

from tests.llm.conftest import words
from tidemark.llm import fingerprints


def key_of(paragraph):
    digest = int(hashlib.md5(paragraph.encode()).hexdigest()[:10], 16)
    return (digest * fingerprints.FACTOR % fingerprints.PRIME << 40) + digest


def keys_of(text):
    return {key_of(p) for p in re.findall(r"[^\n]{1,256}\n*|\n+", text)}


def printed(text):
    keys, cells = keys_of(text), [0] * 32
    for k in keys:
        for t in range(4):
            cells[t * 8 + (k >> 3 * t) % 8] ^= k
    return f"{len(keys)}:" + "".join(f"{c:016x}" for c in cells)


def alike(a, b):
    a, b = keys_of(a), keys_of(b)
    return 2 * len(a & b) / (len(a) + len(b)) if a or b else 1.0


def brute(rows):
    rows = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is None, -(r[0] or 0), hashlib.md5(r[1].encode()).hexdigest()))
    found = []
    for (i, text), (_, after) in zip(rows, rows[1:] + rows[:1]):
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        sha = hashlib.sha256(edited.encode()).hexdigest()
        found.append((i, len(text), sha, printed(text), printed(edited), round(alike(text, edited), 9), round(alike(text, after), 9)))
    return sorted(map(str, found))


def result(df):
    return sorted(str((*tuple(r)[:5], round(r.near_edited, 9), round(r.near_next, 9))) for r in df.collect())


def test_against_sets(spark, odd_docs, no_docs):
    assert result(fingerprints.fingerprint_edits(odd_docs)) == brute([(r.doc_id, r.text) for r in odd_docs.collect()])
    assert fingerprints.fingerprint_edits(no_docs).count() == 0
    alone = spark.createDataFrame([(7, "a line\nand one more\n")], "doc_id long, text string")
    assert result(fingerprints.fingerprint_edits(alone)) == brute([(7, "a line\nand one more\n")])


def test_all_small_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert result(fingerprints.fingerprint_edits(docs)) == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_long_texts_and_copies(spark):
    """Texts of thousands of paragraphs, a third of all rows with one id and text, letters outside the first plane."""
    draw = random.Random(3)
    long = ["\n".join(words(draw, 3) for _ in range(n)) for n in (3000, 5000, 1)]
    rows = [(i, t) for i, t in enumerate(long)] + [(50, "\U0001f600 same\n" * 3)] * 30 + [(100 + i, f"text {i}") for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert result(fingerprints.fingerprint_edits(docs)) == brute(rows)


def test_retries(spark):
    """Sets that the first sketch cannot give back are counted with larger ones, and a sum of keys is not taken for one."""
    draw = random.Random(1)
    sets = []
    for n, shared in ((0, 0), (1, 0), (3, 2), (40, 5), (300, 100), (2000, 50)):
        a = {key_of(str(draw.random())) for _ in range(n)}
        b = {key_of(str(draw.random())) for _ in range(n // 2)} | set(sorted(a)[:shared])
        sets.append((sorted(a), sorted(b)))
    df = spark.createDataFrame(sets, "a array<long>, b array<long>")
    got = df.select("a", "b", fingerprints.keys_apart(F.col("a"), F.col("b"), F.lit(12)).alias("n")).collect()
    assert all(r.n == len(set(r.a) ^ set(r.b)) for r in got)
