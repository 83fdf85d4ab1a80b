"""Shared-storage scratch space for operators that need more than one pass.

Everything an operator keeps between jobs is written to the folder named by ``spark.checkpoint.dir``, so a lost
executor costs a re-read and never the data, and no plan grows a long lineage.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

BUCKET_BYTES = 64 << 20
CHECKPOINT_DIR = "spark.checkpoint.dir"

_local_root: str | None = None
_run_folders: dict[str, str] = {}


def checkpoint_root(spark: SparkSession) -> str:
    """Folder for intermediate tables: the cluster's ``spark.checkpoint.dir``.

    Only a local master may leave it unset (tests, notebooks): it then gets a temporary folder that goes away with
    the process. On a cluster a machine-local folder would not be visible to the other executors.
    """
    global _local_root
    named = spark.conf.get(CHECKPOINT_DIR, None)
    if named:
        return named.rstrip("/")
    if not spark.conf.get("spark.master", "").startswith("local"):
        raise RuntimeError(f"set {CHECKPOINT_DIR} to a folder that every executor can reach")
    if _local_root is None:
        _local_root = tempfile.mkdtemp(prefix="tidemark-")
        atexit.register(shutil.rmtree, _local_root, ignore_errors=True)
    return _local_root


def _run_folder(spark: SparkSession) -> str:
    """Folder of this application under the checkpoint root; its file system removes it when the driver ends."""
    app = spark.sparkContext.applicationId
    if app not in _run_folders:
        folder = f"{checkpoint_root(spark)}/tidemark-{app}-{uuid.uuid4().hex}"
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        files.mkdirs(path)
        files.deleteOnExit(path)
        _run_folders[app] = folder
    return _run_folders[app]


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new, unused folder for this application."""
    return f"{_run_folder(spark)}/{label}-{uuid.uuid4().hex}"


def size_of(df: DataFrame) -> int:
    """Bytes of the table as the planner estimates them; for files, what they take."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


@contextmanager
def bucketed(df: DataFrame, label: str, *columns: str) -> Iterator[DataFrame]:
    """``df`` written in buckets of these columns, one task per bucket: joins on them do not shuffle it again.

    There are as many buckets as the size asks for, at least one per core.

    The table is known to the session catalogue while the context is open; its files stay in the scratch folder.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    name = "tidemark_" + path.rsplit("/", 1)[1].replace("-", "_")
    buckets = max(spark.sparkContext.defaultParallelism, -(-size_of(df) // BUCKET_BYTES))
    laid = df.repartition(buckets, *columns).write.format("parquet").option("path", path)
    laid.bucketBy(buckets, *columns).sortBy(*columns).saveAsTable(name)
    try:
        yield spark.table(name)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to shared storage and return the written table (columnar, with sizes the planner can use)."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def written(df: DataFrame, label: str) -> Iterator[DataFrame]:
    """As ``materialise``, for work that is done again and again: the files go when the context ends."""
    spark = df.sparkSession
    folder = scratch_path(spark, label)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    try:
        df.write.parquet(folder)
        yield spark.read.schema(df.schema).parquet(folder)
    finally:
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
