"""A folder as a stream: each new file is a piece of work, known by its name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def read_file_arrivals(spark: SparkSession, path: str, **options) -> DataFrame:
    """(value, file): the lines of files as they appear. Write files elsewhere and move them in when complete."""
    lines = spark.readStream.options(**options).text(path)
    return lines.select("value", F.col("_metadata.file_path").alias("file"))


def file_arrivals(batch: DataFrame) -> DataFrame:
    """(file, lines): what arrived."""
    return batch.groupBy("file").agg(F.count("*").alias("lines"))


def write_file_arrivals(
    arrivals: DataFrame,
    path: str,
    checkpoint: str,
    work: Callable[[DataFrame], DataFrame] = file_arrivals,
    **trigger,
) -> StreamingQuery:
    """Start the query: ``work`` gets the whole files of each batch, its result goes to ``path/batch=N``.

    ``availableNow=True`` ends after the files that are there; a batch run again overwrites its folder.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        work(batch).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return (
        arrivals.writeStream.option("checkpointLocation", checkpoint).trigger(**trigger).foreachBatch(write).start()
    )
