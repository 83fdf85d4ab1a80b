import math
import random

from tidemark.llm.top_k import exact_top_k


def brute(rows, queries, k):
    def q(v):
        return None if v is None or any(x is None or not math.isfinite(x) for x in v) else [math.floor(256 * x) for x in v]

    rows = [(i, q(v)) for i, v in rows if i is not None and q(v) is not None]
    out = []
    for i, v in {i: q(v) for i, v in queries if i is not None and q(v) is not None}.items():
        scored = sorted((-sum(a * b for a, b in zip(v, w)), j) for j, w in rows if j != i and len(w) == len(v))
        out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(scored[:k])]
    return sorted(out)


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, block int, rank string").repartition(3)


def test_matches_brute_force_with_ties(spark):
    draw = random.Random(3)
    rows = [(i, [draw.choice([-1.0, -0.25, 0.0, 0.5]) for _ in range(4)]) for i in range(400)]
    rows += [(1000 + i, [0.5, 0.5, 0.5, 0.5]) for i in range(300)]
    df = vectors(spark, [(*r, 1, "x") for r in rows])
    found = exact_top_k(df, df.where("vec_id % 20 = 0"), k=7, block_rows=64)
    assert sorted(tuple(r) for r in found.collect()) == brute(rows, [r for r in rows if r[0] % 20 == 0], 7)


def test_odd_vectors(spark):
    rows = [(0, [1.0, 2.0]), (1, None), (2, [None, 1.0]), (3, [float("nan"), 1.0]), (4, [float("inf"), 1.0]), (None, [1.0, 1.0])]
    rows += [(5, [-3.0, 0.1]), (5, [-3.0, 0.1]), (6, [1e9, -1e9]), (7, [1.0]), (8, [])]
    df = vectors(spark, [(*r, None, None) for r in rows])
    found = exact_top_k(df, df.where("vec_id in (0, 1, 3, 7, 8)"), k=3)
    assert sorted(tuple(r) for r in found.collect()) == brute(rows, [r for r in rows if r[0] in (0, 1, 3, 7, 8)], 3)


def test_empty(spark):
    df = vectors(spark, [(1, [1.0], None, None)]).where("vec_id = 2")
    assert exact_top_k(df, df).count() == 0
