"""Periodic runs against a search over all periods."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest

from tidemark.llm import runs
from tidemark.llm.queries import op13_runs


def brute_runs(words):
    n, best = len(words), {}
    for p in range(1, n // 3 + 1):
        i = 0
        while i + p < n:
            if words[i] != words[i + p]:
                i += 1
                continue
            s = i
            while i + p < n and words[i] == words[i + p]:
                i += 1
            length = i + p - s
            if length >= max(24, 3 * p):
                best.setdefault((s, length), p)
    return sorted((s, n_, p) for (s, n_), p in best.items())


def brute_row(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    if doc_id is not None:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = brute_runs(words)
    dropped = {i for s, m, p in found for i in range(s + p, s + m)}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    sums = sha("".join(f"{s},{m},{p}\n" for s, m, p in found)), sha(" ".join(w for i, w in enumerate(words) if i not in dropped))
    if not found:
        return (doc_id, 0, None, None, None, None, *sums)
    s, m, p = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]))
    return (doc_id, len(found), s, m, p, 1000 * m // p, *sums)


def sequences():
    draw = random.Random(11)
    yield []
    yield [1] * 23
    yield [1] * 24
    yield [1] * 500
    yield [0, 1] * 40
    for _ in range(150):
        parts = []
        for _ in range(draw.randint(1, 6)):
            unit = [draw.randint(0, 2) for _ in range(draw.choice([1, 2, 3, 7, 8, 9, 15, 16, 17, 31, 33, 40]))]
            whole = unit * draw.randint(1, 6)
            parts += whole[: draw.randint(1, len(whole))] if draw.random() < 0.5 else whole
        yield parts
    a, b = [0], [0, 1]
    while len(b) < 900:
        a, b = b, b + a
    yield b
    yield [bin(i).count("1") % 2 for i in range(1024)]
    yield [draw.randint(0, 1) for _ in range(1500)]


@pytest.mark.parametrize("piece", [1, 7, 1 << 16])
def test_against_all_periods(piece):
    for words in sequences():
        if piece == 1 and len(words) > 600:
            continue
        assert runs.find_runs(np.array(words, np.int64), piece) == brute_runs(words), words[:50]


def test_equal_names_are_not_taken_for_equal_words(monkeypatch):
    monkeypatch.setattr(runs, "_mixed", lambda x: x % np.uint64(3))
    for words in list(sequences())[:40]:
        assert runs.find_runs(np.array(words, np.int64)) == brute_runs(words)


def test_odd_rows(spark, odd_docs, no_docs):
    got = runs.periodic_runs(odd_docs, planted=True)
    assert got.columns == [*odd_docs.columns, "runs"]
    rows = [(r.doc_id, *r.runs) for r in got.collect()]
    assert sorted(map(str, rows)) == sorted(str(brute_row(r.doc_id, r.text)) for r in odd_docs.collect())
    assert runs.periodic_runs(no_docs).count() == 0
    assert all(r.runs.n_runs == 0 for r in runs.periodic_runs(odd_docs.where("doc_id < 12")).collect())


def test_long_text():
    words = np.concatenate([np.arange(50_000), np.tile(np.arange(1000), 40), np.zeros(60_000, np.int64)])
    # the first zero goes on with the period of 1000
    assert runs.find_runs(words) == [(50_000, 40_001, 1000), (90_000, 60_000, 1)]


def test_all_small_documents(spark):
    sf = "/root/testdata/sf0.001"
    got = [tuple(r) for r in op13_runs(spark, sf).select(
        "doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256").collect()]
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert sorted(map(str, got)) == sorted(str(brute_row(r.doc_id, r.text)) for r in docs)
    assert any(r[1] for r in got)
