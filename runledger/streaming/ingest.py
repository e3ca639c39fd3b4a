"""Incremental ingestion: new reports flow into the ledger, each file once."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from runledger.sinks.ledger import Ledger

BINARY_FILE_SCHEMA = (
    "path string, modificationTime timestamp, length bigint, content binary"
)


def stream_tree(spark: SparkSession, root: str, glob: str, files_per_batch: int = 10_000) -> DataFrame:
    """New files below ``root`` as a stream of ``(path, modificationTime, length, content)``."""
    return (
        spark.readStream.format("binaryFile")
        .schema(BINARY_FILE_SCHEMA)
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", glob)
        .option("maxFilesPerTrigger", files_per_batch)
        .load(root)
    )


def stream_packed(
    spark: SparkSession, root: str, schema, files_per_batch: int = 1000
) -> DataFrame:
    """New Parquet files below ``root`` as a stream."""
    return (
        spark.readStream.schema(schema)
        .option("maxFilesPerTrigger", files_per_batch)
        .parquet(root)
    )


def ingest(
    stream: DataFrame,
    to_rows: Callable[[DataFrame, int], DataFrame],
    ledger: Ledger,
    checkpoint: str,
    source: str | None = None,
) -> None:
    """Merge everything the stream has now, then stop.

    ``to_rows`` turns a batch and its number into ledger rows. A batch is merged under its
    number and ``source``, by default the checkpoint folder, so one that is repeated after
    a failure replaces itself, and several streams can fill one ledger.
    """

    def merge_batch(batch: DataFrame, batch_id: int) -> None:
        ledger.merge(to_rows(batch, batch_id), batch_id, name)

    name = source or "stream-" + hashlib.md5(checkpoint.encode()).hexdigest()
    query = (
        stream.writeStream.foreachBatch(merge_batch)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
