"""Equi-joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import materialise, size_of

SALT = "_salt"
MIN_HEAVY_ROWS = 200_000  # smaller groups are no burden for one task
SMALL_BYTES = 16 << 20  # largest lookup table that is broadcast, by the bytes of its written (compressed) files


def heavy_keys(weights: DataFrame, on: Sequence[str], weight: str, min_rows: int = MIN_HEAVY_ROWS) -> DataFrame:
    """The keys of ``weights`` (one row per key) that have more rows than a task should, and how many parts each is cut
    into, as ``_salts``.

    A key is heavy if it has ``min_rows`` rows and at least what a partition of the shuffle has on average. So there are
    never more heavy keys than partitions: they are safe to broadcast at any size, and none above the threshold is missed.
    A key is cut into parts of that size, as many as its rows ask for.
    """
    partitions = int(weights.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    total = weights.agg(F.coalesce(F.sum(weight), F.lit(0)).alias("v")).scalar()
    share = F.greatest(F.lit(min_rows).cast("double"), total / F.lit(float(partitions)))
    return weights.filter(F.col(weight) >= share).select(*on, F.ceil(F.col(weight) / share).cast("int").alias("_salts"))


def _flagged(df: DataFrame, on: Sequence[str], heavy: DataFrame) -> DataFrame:
    """Add ``_salts``, NULL on rows of keys that are not heavy: a join with as many rows as partitions at most."""
    return df.join(F.broadcast(heavy), list(on), "left")


def spread_heavy(df: DataFrame, on: Sequence[str], heavy: DataFrame) -> DataFrame:
    """Add the salt column: a hash of the row for heavy keys, 0 for all others."""
    salt = F.pmod(F.xxhash64(*df.columns), F.col("_salts")).cast("int")
    return _flagged(df, on, heavy).withColumn(SALT, F.coalesce(salt, F.lit(0))).drop("_salts")


def copy_heavy(df: DataFrame, on: Sequence[str], heavy: DataFrame) -> DataFrame:
    """Add the salt column to the other side of the join: a row of a heavy key once for every salt."""
    last = F.coalesce(F.col("_salts") - 1, F.lit(0))
    return _flagged(df, on, heavy).withColumn(SALT, F.explode(F.sequence(F.lit(0), last))).drop("_salts")


def skew_join(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    how: str = "inner",
    weights: DataFrame | None = None,
    weight: str = "count",
    heavy: DataFrame | None = None,
    min_rows: int = MIN_HEAVY_ROWS,
) -> DataFrame:
    """Join on equal keys; rows of a heavy left key are cut into parts (see ``heavy_keys``), its right rows are copied to
    each part. Meant for a right side with few rows per key, best one.

    ``weights`` (keys plus left row count) saves the counting pass over ``left`` when the caller has it already, and
    ``heavy`` is the result of ``heavy_keys`` itself. The salt is a hash of the row, so a task that is run again puts
    every row where it was before. Equal rows get equal salts: count them first where a key may consist of them.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"unsupported join type: {how}")
    on = list(on)
    if heavy is None:
        if weights is None:
            weights, weight = left.groupBy(*on).count(), "count"
        heavy = heavy_keys(weights, on, weight, min_rows)
    spread, copied = spread_heavy(left, on, heavy), copy_heavy(right, on, heavy)
    return spread.join(copied, [*on, SALT], how).drop(SALT)


def lookup_join(
    left: DataFrame, table: DataFrame, on: Sequence[str], how: str = "inner", small_bytes: int = SMALL_BYTES
) -> DataFrame:
    """Join a large side with a lookup table: broadcast if its files are small, else ``skew_join``.

    The table is written first, so it is computed once and its bytes are known.
    """
    table = materialise(table, "lookup")
    if size_of(table) <= small_bytes:
        return left.join(F.broadcast(table), list(on), how)
    return skew_join(left, table, on, how)
