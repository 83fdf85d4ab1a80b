import random
from collections import defaultdict

import numpy as np

from tests.llm.conftest import words
from tidemark.llm import exact_dedup, jaccard_join
from tidemark.llm.common import components


def owners_of(strings, most):
    trie = exact_dedup.Patricia(lambda a, b: (max(a[0], b[0]), a[1] + b[1]), most)
    for i, s in enumerate(strings):
        trie.insert(s, (i, 1))
    return sorted(trie.owners()), trie.moved


def test_trie_with_and_without_files():
    draw = random.Random(2)
    strings = [bytes(draw.choice(b"ab") for _ in range(draw.randint(0, 12))) for _ in range(3000)] + [b"abc" * 400, b"abc" * 400 + b"d"]
    want = defaultdict(lambda: [0, 0])
    for i, s in enumerate(strings):
        want[s] = [max(want[s][0], i), want[s][1] + 1]
    want = sorted(map(tuple, want.values()))
    assert owners_of(strings, 1 << 30) == (want, 0)
    got, moved = owners_of(strings, 500)
    assert got == want and moved > 0


def resident(trie):
    """Bytes of the nodes in memory, counted anew."""
    total, stack = 0, [trie.root]
    while stack:
        node = stack.pop()
        total += len(node.label) + exact_dedup.NODE_BYTES
        stack.extend(node.children.values())
    return total


def test_trie_of_distinct_lengths_stays_within_its_memory():
    draw, most = random.Random(3), 1 << 20
    trie = exact_dedup.Patricia(lambda a, b: a + b, most)
    keys = [n.to_bytes(4, "big") + draw.randbytes(n) for n in (2000 + 3 * i for i in range(2500))] * 2
    peak = 0
    for i, key in enumerate(keys):
        trie.insert(key, 1)
        assert trie.size <= most + exact_dedup.NODE_BYTES
        if i % 500 == 0:
            peak = max(peak, resident(trie))
            assert abs(resident(trie) - exact_dedup.NODE_BYTES - trie.size) < 1000
    assert 0 < peak < 2 * most and trie.moved < 600
    assert list(trie.owners()) == [2] * 2500


def test_trie_of_one_long_beginning():
    draw, most = random.Random(4), 1 << 16
    start = draw.randbytes(most * 2)
    keys = [start[: most + i] + draw.randbytes(40) for i in range(0, most, 600)] + [start]
    trie = exact_dedup.Patricia(lambda a, b: a + b, most)
    for key in keys * 3:
        trie.insert(key, 1)
    assert list(trie.owners()) == [3] * len(keys)


def test_exact_groups(spark, odd_docs, no_docs):
    got = exact_dedup.exact_groups(odd_docs).collect()
    rows = [(r.doc_id, r.text or "") for r in odd_docs.collect()]
    groups = defaultdict(list)
    for i, t in rows:
        groups[t].append(i)
    assert len(got) == len(rows)
    best = lambda ids: max((i for i in ids if i is not None), default=None)
    assert sorted(str((r.doc_id, r.keep_id, r.group_size)) for r in got) == sorted(str((i, best(groups[t]), len(groups[t]))) for i, t in rows)
    kept = [r for r in got if r.kept]
    assert len(kept) == len(groups) and all(r.doc_id == r.keep_id for r in kept)
    assert exact_dedup.exact_groups(no_docs).count() == 0
    left = exact_dedup.drop_exact(odd_docs)
    assert left.columns == odd_docs.columns and left.count() == len(groups)


def test_hot_text_and_small_buffers(spark, monkeypatch):
    docs = spark.range(6000).selectExpr("id as doc_id", "if(id % 3 = 0, repeat('hot ', 50), concat('text ', id % 1500)) as text").repartition(7)
    docs.write.mode("overwrite").parquet(path := str(spark.conf.get("spark.sql.warehouse.dir")).removeprefix("file:") + "/hot_texts")
    docs = spark.read.parquet(path)
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_groups(docs, heavy_rows=100).collect()}
    assert len(got) == 6000
    hot = [i for i in range(6000) if i % 3 == 0]
    assert all(got[i] == (max(hot), len(hot), i == max(hot)) for i in hot)
    assert sum(k for _, _, k in got.values()) == 1 + len({i % 1500 for i in range(6000) if i % 3})


def sets_of(text, n):
    w = ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x) for x in text.replace("\t", " ").replace("\n", " ").split(" ") if x]
    k = min(n, len(w))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if k else set()


def brute_components(rows, n, percent):
    sets = [sets_of(t or "", n) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    groups = defaultdict(list)
    for i in range(len(rows)):
        groups[find(i)].append(rows[i][0])
    least = {k: min((x for x in v if x is not None), default=None) for k, v in groups.items()}
    return [(rows[i][0], len(sets[i]), least[find(i)]) for i in range(len(rows))], len(groups)


def near_copies(draw):
    rows, passage = [], words(draw, 30)
    for g in range(12):
        base = words(draw, draw.randint(3, 120)).split()
        for _ in range(draw.choice([1, 2, 25])):
            copy = list(base)
            for _ in range(draw.randint(0, 4)):
                copy[draw.randrange(len(copy))] = words(draw, 1)
            rows.append(" ".join(copy))
    rows += [words(draw, 20) + " " + passage + " " + words(draw, 10) for _ in range(40)] + [passage] * 3 + ["A b", "a B", "a", "", " "]
    draw.shuffle(rows)
    return list(enumerate(rows))


def test_near_duplicates_as_brute_force(spark, tmp_path):
    for seed, (n, percent) in enumerate([(4, 85), (5, 80), (2, 50)]):
        rows = near_copies(random.Random(seed))
        spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(path := f"{tmp_path}/{seed}")
        got = jaccard_join.near_duplicates(spark.read.parquet(path), n, percent).collect()
        want, groups = brute_components(rows, n, percent)
        assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == sorted(want)
        assert sum(r.kept for r in got) == groups


def test_one_boilerplate_in_all_texts(spark, tmp_path):
    """Sets that share most of what they have, some of them enough for a link: only kinds that can be linked are paired."""
    draw = random.Random(11)
    shared, sets = [draw.getrandbits(62) for _ in range(120)], []
    for _ in range(400):
        own = [draw.getrandbits(62) for _ in range(draw.randint(18, 60))]
        sets.append(set(shared) | set(own))
        for _ in range(draw.choice([0, 0, 0, 1, 2])):  # a few copies with some of their own part changed
            kept = own[draw.randint(0, 30) :] + [draw.getrandbits(62) for _ in range(draw.randint(0, 9))]
            sets.append(set(shared) | set(kept))
    data = [(i, len(x), bytearray(np.array(sorted(x), np.int64).tobytes())) for i, x in enumerate(sets)]
    spark.createDataFrame(data, "node long, n long, grams binary").repartition(4).write.parquet(path := f"{tmp_path}/sets")
    found = {r.node: r.component for r in components(jaccard_join.linked_classes(spark.read.parquet(path), 85)).collect()}
    parent = list(range(len(sets)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if 100 * len(a & b) >= 85 * len(a | b):
                parent[max(find(i), find(j))] = min(find(i), find(j))
    want = [find(i) for i in range(len(sets))]
    assert [found.get(i, i) for i in range(len(sets))] == want and 10 < len(set(want)) < len(sets)
    open_rows = [(1, i % 2, i, (100 + i % 3, 2, i % 5, True)) for i in range(3000)]
    rows = spark.createDataFrame(open_rows, "gram long, part long, node long, kind struct<n:long,place:long,own:long,to_late:boolean>")
    assert jaccard_join._kinds(rows.selectExpr("*", "0L as main"), 85).count() <= 15 * 15


def test_near_duplicates_of_odd_rows(spark, odd_docs, no_docs):
    got = jaccard_join.near_duplicates(odd_docs).collect()
    want, groups = brute_components([(r.doc_id, r.text) for r in odd_docs.collect()], jaccard_join.WORDS, jaccard_join.PERCENT)
    assert sorted(str((r.doc_id, r.n_shingles, r.component_id)) for r in got) == sorted(map(str, want))
    assert sum(r.kept for r in got) == groups
    left = jaccard_join.drop_near(odd_docs)
    assert left.columns == odd_docs.columns and left.count() == groups
    assert jaccard_join.near_duplicates(no_docs).count() == 0


def test_components(spark):
    draw = random.Random(4)
    pairs = [(i, i + 1) for i in range(100)] + [(draw.randint(200, 400), draw.randint(200, 400)) for _ in range(120)] + [(500, 500), (None, 3), (600, 601), (601, 600)]
    got = {r.node: r.component for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    parent = {}

    def find(i):
        parent.setdefault(i, i)
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in pairs:
        if a is not None and a != b:
            a, b = sorted((find(a), find(b)))
            parent[b] = a
    assert got == {i: find(i) for i in parent}
