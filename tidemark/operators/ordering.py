"""Row numbers over an explicit order without putting a group, or the table, into one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import materialise

_CHUNK_BITS = 33  # monotonically_increasing_id keeps the partition number above bit 33


def ranked(df: DataFrame, order: Sequence[Column | str], keys: Sequence[str] = (), name: str = "rank") -> DataFrame:
    """Add ``name``: 1, 2, 3 .. in ``order``, per ``keys`` or over the whole table.

    Rows are range-partitioned on (keys, order), so a key of any size is cut into as many chunks as it needs. Each
    chunk numbers its own rows; only the chunk sizes (a few per key) go through a window to give each its offset.
    Rows that tie on ``order`` are numbered in no particular order: give enough columns to separate them. Range
    partitioning samples its input before it reads it, so pass a table, not a costly plan.
    """
    keys = list(keys)
    order = [F.col(c) if isinstance(c, str) else c for c in order]
    layout = [*[F.col(k).asc() for k in keys], *order]
    laid = materialise(
        df.repartitionByRange(*layout)
        .sortWithinPartitions(*layout)
        .withColumn("_at", F.monotonically_increasing_id())
        .withColumn("_chunk", F.shiftright("_at", _CHUNK_BITS)),
        "ranked",
    )
    # one row per (key, chunk): grows with the number of keys and chunks, not with the rows
    chunks = laid.groupBy(*keys, "_chunk").agg(F.min("_at").alias("_first"), F.count("*").alias("_rows"))
    before = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = chunks.select(
        *[F.col(k).alias(f"_k_{k}") for k in keys],
        F.col("_chunk").alias("_c"),
        (F.coalesce(F.sum("_rows").over(before), F.lit(0)) - F.col("_first") + 1).alias("_offset"),
    )
    same = F.col("_chunk") == F.col("_c")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    return laid.join(offsets, same).select(*df.columns, (F.col("_at") + F.col("_offset")).alias(name))
