"""Report trees and packed report tables."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterable, Iterator
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from runledger import constants as K
from runledger.functions.paths import has_suffix, is_named, relative_to
from runledger.functions.text import (
    latin1_text,
    may_hold,
    path_selected,
    utf8_text,
    utf8_text_dropping,
    valid_utf8,
)
from runledger.session import in_few_tasks, listing_in_few_tasks

MAX_FILE_BYTES = 256 * 1024 * 1024


def list_tree(spark: SparkSession, root: str, glob: str | None = None) -> DataFrame:
    """The files below ``root``, listed once for all scans that are given them as ``listed``."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    with listing_in_few_tasks(spark):
        return reader.load(root)


def _selected(listed: DataFrame, needles: Iterable[str], length: Column) -> DataFrame:
    """Files of that length whose path may hold all ``needles``; others are not opened."""
    files = listed.where(length & may_hold(F.col("_metadata.file_path"), needles))
    return in_few_tasks(files, listed)


def scan_tree(
    spark: SparkSession,
    root: str,
    needles: Iterable[str] = (),
    ignore: Iterable[str] = (),
    glob: str | None = None,
    limit: int = MAX_FILE_BYTES,
    listed: DataFrame | None = None,
) -> DataFrame:
    """``(path, length, content)`` of the files below ``root`` whose path is selected.

    ``glob`` and ``needles`` prune while listing; ``ignore`` prunes before ``content`` is used.
    Files longer than ``limit`` are left out before they are opened, so one of them fails
    no run; ``oversized`` names them. The others are dealt to tasks by length. Paths
    are relative to ``root``, so a folder above it never takes part in a match.
    """
    needles = list(needles)
    listed = list_tree(spark, root, glob) if listed is None else listed
    files = _selected(listed, needles, F.col("length") <= limit)
    path = relative_to(F.col("path"), root)
    return files.select(path.alias("path"), "length", "content").where(
        path_selected(F.col("path"), needles, ignore)
    )


def oversized(
    spark: SparkSession,
    root: str,
    needles: Iterable[str] = (),
    ignore: Iterable[str] = (),
    glob: str | None = None,
    limit: int = MAX_FILE_BYTES,
) -> DataFrame:
    """``(path, length)`` of the files ``scan_tree`` leaves out for their length."""
    needles = list(needles)
    files = _selected(list_tree(spark, root, glob), needles, F.col("length") > limit)
    path = relative_to(F.col("path"), root)
    return files.select(path.alias("path"), "length").where(
        path_selected(F.col("path"), needles, ignore)
    )


def reports_of(files: DataFrame) -> DataFrame:
    """Report files as ``(path, text, match_text)``."""
    return files.where(path_selected(F.col("path"), [K.REPORT_FILE], K.REPORT_IGNORE)).select(
        "path",
        latin1_text(F.col("content")).alias("text"),
        utf8_text_dropping(F.col("content")).alias("match_text"),
    )


def logs_of(files: DataFrame) -> DataFrame:
    """Build log files as ``(path, text, match_text, text_valid)``; other suffixes are left out."""
    return files.where(
        path_selected(F.col("path"), [K.LOG_FILE], K.LOG_IGNORE) & has_suffix(F.col("path"))
    ).select(
        "path",
        utf8_text(F.col("content")).alias("text"),
        utf8_text_dropping(F.col("content")).alias("match_text"),
        valid_utf8(F.col("content")).alias("text_valid"),
    )


def report_tree(spark: SparkSession, root: str) -> DataFrame:
    return reports_of(scan_tree(spark, root, glob=f"*{K.REPORT_FILE}*"))


def log_tree(spark: SparkSession, root: str) -> DataFrame:
    return logs_of(scan_tree(spark, root, glob=f"*{K.LOG_FILE}*"))


def in_path_order(files: DataFrame) -> DataFrame:
    """Each path once, sorted."""
    return files.dropDuplicates(["path"]).orderBy("path")


def named_files(files: DataFrame, name: str = K.REPORT_FILE) -> DataFrame:
    """Files of that name in any letter case, as the older text report looks for them."""
    return files.where(is_named(F.col("path"), name))


def pack(files: DataFrame, target: str) -> None:
    """Copy a tree of small files into Parquet ``(path, length, content)``.

    A tree of billions of 15 kB files is bound by listing and opening; packed once, every
    later run reads large splits. Each task writes the files it was dealt by length, sorted
    by path: contents are read once and not shuffled.
    """
    files.sortWithinPartitions("path").write.mode("overwrite").parquet(target)


def packed(spark: SparkSession, target: str) -> DataFrame:
    return spark.read.parquet(target).select("path", "length", "content")


def write_files(files: DataFrame, folder: str) -> None:
    """Write ``(path, content)`` as files below ``folder`` of a local or mounted disk, one a path.

    Hadoop starts a process for every file it makes there, to set its permissions, and adds a
    file of check sums; here tasks make the files themselves. Rows of one path stand together
    in one task and follow one another in its file. A file gets its name when it is whole, so
    a task that is repeated leaves the same files.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for b in batches for row in zip(*(b[c].to_pylist() for c in ("path", "content"))))
        done = 0
        for path, own in groupby(rows, itemgetter(0)):
            place = os.path.join(folder, path)
            unfinished = os.path.join(os.path.dirname(place), f".{uuid.uuid4().hex}")
            os.makedirs(os.path.dirname(place), exist_ok=True)
            with open(unfinished, "wb") as f:
                f.writelines(content for _, content in own)
            os.replace(unfinished, place)
            done += 1
        yield pa.record_batch({"files": pa.array([done], pa.int64())})

    rows = files.select("path", "content")
    rows.mapInArrow(write, "files long").write.format("noop").mode("overwrite").save()
