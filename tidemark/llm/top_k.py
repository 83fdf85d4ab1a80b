"""Exact top-k search by distributed histogram selection.

Every query is scored against every candidate, in blocks. The scores are not gathered: a pass adds up a histogram of each
query's scores over the range that still holds its k-th best score, and the bin with that score is the next, narrower
range, until a bin is one score wide. A last pass keeps what scores above the k-th score, and of the ties the smallest ids.
A block needs to report only the bins of its own k best scores of a query: what is below cannot be among the k best, so
counts stay small whatever the number of candidates, and ties with thousands of equal vectors stay in their block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import first_row_number
from tidemark.session import materialise

K = 5
SCALE = 256
BINS = 1024
BLOCK_ROWS = 4096  # vectors of a block: 2 MB at 64 components
TILE = 256  # queries scored at once: 8 MB of scores
EXACT = 1 << 53  # whole numbers below this are exact in a double

BLOCK = "block long, dim int, ids binary, data binary, norm double, n int"


def quantised(vector) -> np.ndarray | None:
    """floor(256 x) of each component, or None if one is null or not finite."""
    if vector is None:
        return None
    vector = np.array([np.nan if x is None else x for x in vector], np.float64)
    return np.floor(vector * SCALE) if np.isfinite(vector).all() else None


def _blocks(rows_per_block: int):
    """Vectors of a task -> blocks of vectors of equal length, as bytes: ids int64, components float64."""

    def blocked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number = first_row_number()
        held: dict[int, tuple[list[int], list[np.ndarray]]] = {}

        def block(dim: int) -> pd.DataFrame:
            nonlocal number
            ids, vectors = held.pop(dim)
            data = np.array(vectors).reshape(len(ids), dim)
            norm = float(np.sqrt((data**2).sum(axis=1).max())) if dim else 0.0
            number += 1
            columns = {"block": [number], "dim": [dim], "ids": [np.array(ids, "<i8").tobytes()], "data": [data.astype("<f8").tobytes()]}
            return pd.DataFrame(columns | {"norm": [norm], "n": [len(ids)]})

        for batch in batches:
            for vec_id, vector in zip(batch["_id"], batch["_vector"]):
                vector = quantised(vector)
                if vector is None:
                    continue
                ids, vectors = held.setdefault(len(vector), ([], []))
                ids.append(int(vec_id))
                vectors.append(vector)
                if len(ids) == rows_per_block:
                    yield block(len(vector))
        for dim in list(held):
            yield block(dim)

    return blocked


def _scores(row, at: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids of a tile of the block's queries, of its candidates, and their scores; the query's own rows score least."""
    queries, candidates = np.frombuffer(row.q_ids, "<i8")[at : at + TILE], np.frombuffer(row.ids, "<i8")
    q = np.frombuffer(row.q_data, "<f8").reshape(row.q_n, row.dim)[at : at + TILE]
    c = np.frombuffer(row.data, "<f8").reshape(row.n, row.dim)
    if row.norm * row.q_norm < EXACT / 4:
        scores = (q @ c.T).astype(np.int64)
    else:  # numbers too large for doubles; what does not fit into 64 bits is cut to their range
        exact = q.astype(object).dot(c.T.astype(object)) if row.dim else np.zeros((len(q), len(c)), object)
        scores = np.array([[max(-LARGEST, min(LARGEST, int(x))) for x in line] for line in exact], np.int64)
    scores[queries[:, None] == candidates[None, :]] = NEVER
    return queries, candidates, scores


NEVER, LARGEST = -(1 << 63), (1 << 63) - (1 << 20)


def _histogram(k: int, span: int, width: int):
    """Counts (query_id, bin, n) of a block's k best scores, those in ``span`` from each query's ``lo`` on, in bins of ``width``."""

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                low = np.frombuffer(row.q_low, "<i8")
                for at in range(0, len(low), TILE):
                    queries, _, scores = _scores(row, at)
                    few = min(k, scores.shape[1])
                    best = np.partition(scores, scores.shape[1] - few, axis=1)[:, -few:]
                    above = best - low[at : at + TILE, None]
                    real = (best != NEVER) & (above >= 0) & (above < span)
                    bins = above // width
                    who = np.repeat(queries, real.sum(axis=1))
                    pairs, n = np.unique(np.column_stack([who, bins[real]]), axis=0, return_counts=True)
                    yield pd.DataFrame({"query_id": pairs[:, 0], "bin": pairs[:, 1], "n": n})

    return counted


def _above(k: int):
    """Rows (query_id, vec_id, score) above each query's ``lo``, and the k smallest ids of those that equal it."""

    def kept(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                low = np.frombuffer(row.q_low, "<i8")
                for at in range(0, len(low), TILE):
                    queries, candidates, scores = _scores(row, at)
                    found = []
                    hits = (scores >= low[at : at + TILE, None]) & (scores != NEVER)
                    for i in np.flatnonzero(hits.any(axis=1)):
                        there = np.flatnonzero(hits[i])
                        best = there[np.lexsort((candidates[there], -scores[i, there]))][:k]
                        found.append(pd.DataFrame({"query_id": queries[i], "vec_id": candidates[best], "score": scores[i, best]}))
                    if found:
                        yield pd.concat(found)

    return kept


def exact_top_k(
    candidates: DataFrame, queries: DataFrame, k: int = K, key: str = "vec_id", vector: str = "embedding", block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Each query's k best candidates: query_id, rank (from 1), vec_id, score.

    The score is the inner product of floor(256 x); ties go to the smaller id. Rows without an id, or whose vector is null
    or holds a null or non-finite component, take no part; vectors are compared with those of their length. A candidate
    with the query's id is the query's own row. Rows that repeat an id are candidates each; of queries that repeat one, one
    is answered. Fewer candidates than k give fewer rows, an empty table none. Other columns may have any name.
    """

    def blocks(df: DataFrame, label: str) -> DataFrame:
        rows = df.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("_id"), F.col(vector).alias("_vector"))
        return materialise(rows.mapInPandas(_blocks(block_rows), BLOCK), label)

    spark = candidates.sparkSession
    held, asked = blocks(candidates, "candidates"), blocks(queries.dropDuplicates([key]), "queries")
    q_names = {"block": "q_block", "ids": "q_ids", "data": "q_data", "norm": "q_norm", "n": "q_n"}
    asked = asked.withColumnsRenamed(q_names)
    ends = held.agg(F.max("norm").alias("c"), F.count("*").alias("blocks")).first(), asked.agg(F.max("q_norm").alias("q"), F.count("*").alias("blocks")).first()
    most = int(min((ends[0]["c"] or 0.0) * (ends[1]["q"] or 0.0), float(LARGEST))) + 1  # no score is beyond it
    # which block meets which: numbers only, and as many as there are pairs of blocks
    pairs = held.select("block", "dim").join(asked.select("q_block", "dim"), "dim").drop("dim")
    parts = max(1, min(ends[0]["blocks"] * ends[1]["blocks"], 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))))

    def scored(state: DataFrame, step, schema: str) -> DataFrame:
        right = asked.drop("dim").join(state, "q_block").join(pairs, "q_block")
        left = held.join(pairs, "block")
        met = left.repartition(parts, "block", "q_block").join(right.repartition(parts, "block", "q_block"), ["block", "q_block"])
        return met.mapInPandas(step, schema)

    def packed(low: DataFrame) -> DataFrame:
        """Each query block's lowest scores in the order of its ids, as bytes; ``low`` has query_id, lo."""

        def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                yield pd.DataFrame({"q_block": batch["q_block"], "q_low": [np.array(x, "<i8").tobytes() for x in batch["los"]]})

        by_place = low.groupBy("q_block").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "lo"))), lambda x: x["lo"]).alias("los"))
        return by_place.mapInPandas(pack, "q_block long, q_low binary")

    def places(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                ids = np.frombuffer(row.q_ids, "<i8")
                yield pd.DataFrame({"q_block": row.q_block, "place": np.arange(len(ids)), "query_id": ids})

    who = materialise(asked.select("q_block", "q_ids").mapInPandas(places, "q_block long, place int, query_id long"), "places")
    low = who.select("q_block", "place", "query_id", F.lit(-most).alias("lo"), F.lit(k).cast("long").alias("need"))
    span = 2 * most + 1
    width = -(-span // BINS)
    while True:
        counts = scored(packed(low), _histogram(k, span, width), "query_id long, bin long, n long").groupBy("query_id", "bin").agg(F.sum("n").alias("n"))
        from_top = Window.partitionBy("query_id").orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, 0)
        upto = counts.withColumn("upto", F.sum("n").over(from_top)).join(low.select("query_id", "need"), "query_id")
        kth = upto.where("upto >= need").groupBy("query_id").agg(F.max(F.struct("bin", (F.col("need") - F.col("upto") + F.col("n")).alias("left"))).alias("x"))
        narrowed = low.join(kth, "query_id", "left")
        # without a k-th score every score counts
        new_low = F.when(F.col("x").isNotNull(), F.col("lo") + F.col("x.bin") * width).otherwise(F.lit(-LARGEST))
        low = materialise(
            narrowed.select("q_block", "place", "query_id", new_low.alias("lo"), F.coalesce("x.left", "need").alias("need")), "lows"
        )
        if width == 1:
            break
        span, width = width, -(-width // BINS)
    found = scored(packed(low), _above(k), "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
