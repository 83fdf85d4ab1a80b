"""What the operators of this subpackage share: the train/held-out split, row numbers, components of links."""

from __future__ import annotations

from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import materialise

#: Rows whose CRC-32 of the id, as text, leaves this remainder are never learned from.
FOLDS, HELD_OUT = 4, 2
#: Row numbers made in tasks: the partition in the high bits.
ROWS_PER_TASK = 33
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def held_out(doc_id: Column) -> Column:
    """True for rows kept for testing. A null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % FOLDS == HELD_OUT


def whole_text(text: Column) -> Column:
    """The text; null counts as empty."""
    return F.coalesce(text, F.lit(""))


def bounded_batches(spark: SparkSession) -> None:
    """Have Spark hand rows to Python in batches of 4 MB at most for the rest of the session, unless the session says
    otherwise: the usual 10,000 rows know no bound when texts are long."""
    if spark.conf.get(BATCH_BYTES, None) in (None, str((1 << 31) - 1), str((1 << 63) - 1), "-1"):
        spark.conf.set(BATCH_BYTES, str(4 << 20))


def draw(*columns: Column | str) -> Column:
    """A number in [0, 1) from a hash of the columns."""
    return F.pmod(F.xxhash64(*columns), F.lit(1 << 30)) / float(1 << 30)


def first_row_number() -> int:
    """Number of a task's first row: unique over the tasks of a stage, the same when a task is run again."""
    return TaskContext.get().partitionId() << ROWS_PER_TASK


def components(links: DataFrame) -> DataFrame:
    """Connected components of ``links`` (a, b: long): one row (node, component) per linked node, component the smallest.

    Alternating large and small stars: a node's larger neighbours are linked to its smallest neighbour, then its
    smaller ones; both keep components as they are, and the result is a star for each. No node is gathered in one
    task: the smallest neighbour is an aggregate and every edge stays a row. Links of a node to itself and repeated
    links are allowed; null ends are dropped. Every pass is written to the shared folder.
    """
    edges = links.where("a is not null and b is not null and a <> b")
    edges = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = materialise(edges, "links")
    before = None
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        smaller = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(smaller, "a")
        small = small.select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        edges = materialise(small.where("a <> b").distinct(), "links")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    roots = edges.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)
