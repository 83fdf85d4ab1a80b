"""Trending hashtags as a stream: one stateful aggregate, then the batch operators on each set of closed windows."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from tidemark.operators.hashtags import growth_column, tag_growth, trend_of_tags
from tidemark.session import written

ROWS_PER_PARTITION = 100_000  # posts whose state one task holds at once, when all are read in one batch
SESSION_PARTITIONS = 200  # taken over from the session at most: each task sends the driver a metric for every partition
PARTITIONS = "spark.sql.shuffle.partitions"
STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
_STORES = "org.apache.spark.sql.execution.streaming.state"
#: State on local disk, with one bound on memory for all partitions of an executor.
_ON_DISK = {STATE_STORE: f"{_STORES}.RocksDBStateStoreProvider", "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true"}


def state_partitions(spark: SparkSession, rows: int) -> int:
    """Partitions for a stream that may meet ``rows`` posts in one batch: as many as the session has, more when they are many.
    What the session has beyond ``SESSION_PARTITIONS`` counts only if the posts ask for it. A stream keeps its number for good."""
    return max(min(int(spark.conf.get(PARTITIONS)), SESSION_PARTITIONS), -(-rows // ROWS_PER_PARTITION))


@contextmanager
def _stream_conf(spark: SparkSession, partitions: int | None) -> Iterator[None]:
    """What a stream that is started inside takes over from the session; the session itself is left as it was."""
    wanted = {PARTITIONS: str(partitions)} if partitions else {}
    if spark.conf.get(STATE_STORE, None) in (None, f"{_STORES}.HDFSBackedStateStoreProvider"):
        wanted |= _ON_DISK
    before = {name: spark.conf.get(name, None) for name in wanted}
    try:
        for name, value in wanted.items():
            spark.conf.set(name, value)
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def read_posts_stream(spark: SparkSession, path: str, schema: StructType | str, fmt: str = "json", **options) -> DataFrame:
    """Posts as files arrive; a Kafka or socket source with the same columns can take its place."""
    return spark.readStream.format(fmt).schema(schema).options(**options).load(path)


def retweet_growth_stream(
    posts: DataFrame, length: int = 120, slide: int = 2, delay: int = 10, latest_by: Sequence[str] = ("ts",)
) -> DataFrame:
    """``retweet_growth`` over event time. A post may be up to ``delay`` seconds late; a window is given out once,
    when no post can reach it any more, and all its rows together.

    Two aggregates in a row: posts are first reduced to one row per id and slide, and only what a closed slide leaves is
    copied into the windows that it is part of."""
    slots = (
        posts.withWatermark("ts", f"{delay} seconds")
        .groupBy(F.window("ts", f"{slide} seconds").alias("slot"), "id")
        .agg(
            F.max("rt").alias("max_rt"),
            F.min("rt").alias("min_rt"),
            F.max(F.struct(*latest_by, "user", "text")).alias("latest"),
        )
    )
    window = F.window(F.window_time("slot"), f"{length} seconds", f"{slide} seconds")
    grown = slots.groupBy(window.alias("window"), "id").agg(
        F.max("max_rt").alias("max_rt"), F.min("min_rt").alias("min_rt"), F.max("latest").alias("latest")
    )
    return grown.select(
        F.col("window.start").alias("window_start"),
        F.col("window.end").alias("window_end"),
        "id",
        "latest.user",
        "max_rt",
        "min_rt",
        growth_column().alias("growth"),
        "latest.text",
    )


def write_trends_stream(
    growth: DataFrame,
    path: str,
    checkpoint: str,
    report: Callable[[DataFrame], DataFrame] = trend_of_tags,
    partitions: int | None = None,
    **trigger,
) -> StreamingQuery:
    """Start the query: the tagged posts of each batch's closed windows go through ``report`` to ``path/batch=N``.

    They are written first, and the files go after the batch: what reads the batch itself, be it cached, sends the driver the
    metrics of every partition's state with every task, and those grow with the square of the partitions.

    A batch that is run again after a failure overwrites its own folder, so no row is written twice. Pass
    ``availableNow=True`` to stop at the end of the input, or ``processingTime="2 seconds"`` to go on.

    The state is on disk unless the session names a store of its own. ``partitions`` (see ``state_partitions``) bounds what a
    task holds of a batch; a stream that goes on from its checkpoint keeps the store and the number it began with.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        with written(tag_growth(batch), "batch") as tagged:
            report(tagged).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    with _stream_conf(growth.sparkSession, partitions):
        return (
            growth.writeStream.outputMode("append")
            .option("checkpointLocation", checkpoint)
            .trigger(**trigger)
            .foreachBatch(write)
            .start()
        )
