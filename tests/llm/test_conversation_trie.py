"""The conversation trie against a dictionary of prefixes."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from tidemark.llm import conversation_trie


def brute(rows):
    turns = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            mark = hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()
            turns[conv].append((turn is not None, turn or 0, mark, role, text))
    turns = {c: [t[3:] for t in sorted(ts)] for c, ts in turns.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 4
        path = tuple(turns.get(c - c % 20, [])[:h] + own[h:])
        ends[path].append(c)
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
    children = defaultdict(list)
    for path in members:
        if path:
            children[path[:-1]].append(path)
    leaves, saved = {}, {}
    for path in sorted(members, key=len, reverse=True):
        words = len(re.findall(r"[^\x20\x09-\x0D]+", path[-1][1])) if path else 0
        leaves[path] = sum(leaves[p] for p in children[path]) or 1
        saved[path] = (len(members[path]) - 1) * words + sum(saved[p] for p in children[path])
    sha = lambda ids: hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest()
    return sorted(
        str((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(children[p]), leaves[p], saved[p], sha(ends[p])))
        for p, m in members.items()
    )


def result(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    return sorted(str(tuple(r)) for r in conversation_trie.prefix_trie(df).collect())


def some_conversations(seed, n, texts, longest):
    draw = random.Random(seed)
    rows = []
    for c in range(n):
        for t in range(draw.randint(1, longest)):
            rows.append((c, t, draw.choice(["user", "assistant"]), draw.choice(texts)))
    return rows


@pytest.mark.parametrize("shard_bytes", [1, 300, 16 << 20])
def test_against_prefixes(spark, monkeypatch, shard_bytes):
    """Few texts, so that prefixes are shared and run over many borders; from a shard a conversation on."""
    monkeypatch.setattr(conversation_trie, "SHARD_BYTES", shard_bytes)
    monkeypatch.setattr(conversation_trie, "IDS_PER_ROW", 3)
    rows = some_conversations(1, 60, ["a b", "c"], 4)
    assert result(spark, rows) == brute(rows)


def test_copies_and_long_conversations(spark, monkeypatch):
    """A third of all conversations is the same one, another has hundreds of turns."""
    monkeypatch.setattr(conversation_trie, "SHARD_BYTES", 2000)
    rows = [(1000 + c, t, "user", f"turn {t}") for c in range(100) for t in range(3)]
    rows += [(3000 + c, t, "user", f"turn {t % 7}") for c in range(3) for t in range(300)]
    rows += some_conversations(2, 150, ["x", "y z", "turn 0"], 3)
    assert result(spark, rows) == brute(rows)


def test_odd_rows(spark):
    rows = [
        (None, 1, "user", "nobody"),
        (1, None, None, None),
        (1, None, None, None),
        (1, 2, "user", "b"),
        (1, 2, "user", "a"),
        (2, 0, "", ""),
        (2, 1, "us", "er"),
        (22, 1, "use", "r"),
        (23, 5, "user", "one  two\tthree\n"),
        (-3, 0, "user", "below zero"),
        (20, 0, "user", "base"),
    ]
    assert result(spark, rows) == brute(rows)
    assert result(spark, rows[:1]) == [] and result(spark, rows[1:2]) == brute(rows[1:2])
    clash = spark.createDataFrame([(1, 0, "u", "t", 1, 2, 3)], "conv_id long, turn long, role string, text string, path int, shard int, node int")
    assert conversation_trie.prefix_trie(clash).count() == len(brute([(1, 0, "u", "t")]))
