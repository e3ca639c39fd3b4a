"""Session set-up and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession


# For writes of very many files into a fresh folder: otherwise the driver moves them one by one.
TASKS_MOVE_FILES = {"mapreduce.fileoutputcommitter.algorithm.version": "2"}
_LISTING = "spark.sql.sources.parallelPartitionDiscovery.parallelism"


def build_session(app: str = "runledger", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the library is tuned for.

    On a cluster leave ``master`` unset; shuffle partitions then stay with the
    submitter and AQE coalesces them.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


@lru_cache(maxsize=None)
def _local_scratch(application_id: str) -> str:
    return tempfile.mkdtemp(prefix="run-", dir="/tmp")


def scratch_base(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``, which driver and executors share.

    Only a local master may leave it unset and gets a folder of its own; on a cluster
    executors would write to disks nobody else reads, so there it is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.conf.get("spark.master", "local").startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return _local_scratch(spark.sparkContext.applicationId)


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder name below the shared scratch folder."""
    return f"{scratch_base(spark)}/{name}-{uuid.uuid4().hex}"


def file_tasks(spark: SparkSession) -> int:
    """Tasks for work that files cost, not bytes: Spark would join small parts into one task."""
    return 4 * spark.sparkContext.defaultParallelism


def local_path(spark: SparkSession, path: str) -> str | None:
    """``path`` as the operating system names it, None where it lies in another store."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = at.getFileSystem(spark._jsc.hadoopConfiguration()).getUri().getScheme()
    return at.toUri().getPath() if store == "file" else None


def part_bytes(spark: SparkSession) -> int:
    """Bytes of files that Spark puts into one part."""
    return spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()


def in_few_tasks(rows: DataFrame, listed: DataFrame) -> DataFrame:
    """``rows`` of the files ``listed``, read in as many tasks as their bytes ask for.

    Spark reckons 4 MB for opening a file, so that it takes a task for every few files,
    however short they are.
    """
    spark = listed.sparkSession
    length = int(str(listed._jdf.queryExecution().analyzed().stats().sizeInBytes()))
    return rows.coalesce(max(file_tasks(spark), -(-length // part_bytes(spark))))


@contextmanager
def listing_in_few_tasks(spark: SparkSession) -> Iterator[None]:
    """Folders are listed by a few tasks per core, each many of them, not by a task each."""
    before = spark.conf.get(_LISTING)
    spark.conf.set(_LISTING, str(min(int(before), file_tasks(spark))))
    try:
        yield
    finally:
        spark.conf.set(_LISTING, before)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Used where several outputs hang on one costly plan: the files survive lost
    executors and the scan of the sources is not repeated.
    """
    path = scratch_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
