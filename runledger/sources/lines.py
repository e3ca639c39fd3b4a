"""Long logs read line by line, so that no row holds a file."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from runledger import constants as K
from runledger.functions.paths import has_suffix, relative_to
from runledger.functions.text import bind, may_hold, path_selected, split_lines, utf8_text
from runledger.session import in_few_tasks, listing_in_few_tasks, part_bytes
from runledger.sources.files import list_tree, scan_tree

# A log up to this long is read whole and cut into lines; longer ones are read in blocks.
SHORT_BYTES = 1024 * 1024


def scan_lines(
    spark: SparkSession,
    root: str,
    needles: Iterable[str] = (),
    ignore: Iterable[str] = (),
    glob: str | None = None,
    above: int = 0,
) -> DataFrame:
    """``(path, block, place, line)`` of the files below ``root`` whose path is selected.

    A long file is read in blocks by several tasks. ``block`` is where a block starts in
    its file and ``place`` counts up within it, so both together order a file's lines;
    ``place`` has no meaning beyond its block. Lines end as universal newlines do; invalid
    UTF-8 becomes U+FFFD. Paths are relative to ``root``. Files of up to ``above`` bytes are
    left out.
    """
    reader = spark.read.option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    # Written as a URI; a plus sign stands for itself there.
    named = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    with listing_in_few_tasks(spark):
        listed = reader.text(root)
    # Before lines are counted, as no filter is carried below that: other files are not opened.
    needles = list(needles)
    wanted = (F.col("_metadata.file_size") > above) & may_hold(F.col("_metadata.file_path"), needles)
    lines = listed.where(wanted).select(
        relative_to(named, root).alias("path"),
        F.col("_metadata.file_block_start").alias("block"),
        "value",
    )
    lines = in_few_tasks(lines.where(path_selected(F.col("path"), needles, ignore)), listed)
    return lines.select(
        "path",
        "block",
        F.monotonically_increasing_id().alias("place"),
        F.make_valid_utf8("value").alias("line"),
    )


def log_lines(spark: SparkSession, root: str, listed: DataFrame | None = None) -> DataFrame:
    """Lines of the build logs below ``root``, as ``scan_lines`` gives them; other suffixes are left out.

    Hadoop's reader of lines is set up anew for every file, at many times the cost of a short
    file's lines, so short logs are read whole. ``listed`` spares a listing.
    """
    listed = list_tree(spark, root) if listed is None else listed
    short = min(SHORT_BYTES, part_bytes(spark))
    wanted = ([K.LOG_FILE], K.LOG_IGNORE)
    named = has_suffix(F.col("_metadata.file_path"))
    logs = scan_tree(spark, root, *wanted, limit=short, listed=listed.where(named))
    # A byte order mark is no part of the first line.
    text = bind(utf8_text(F.col("content")), lambda t: F.regexp_replace(t, r"\A\x{feff}", ""))
    lines = logs.where(has_suffix(F.col("path"))).select(
        "path", F.lit(0).cast("bigint").alias("block"), F.posexplode(split_lines(text)).alias("place", "line")
    )
    lines = lines.withColumn("place", F.col("place").cast("bigint"))
    long = listed.where(named & (F.col("_metadata.file_size") > short))
    if long.select("length").isEmpty():
        return lines
    long = scan_lines(spark, root, *wanted, glob="*.log", above=short)
    return lines.unionByName(long.where(has_suffix(F.col("path"))))


def _topmost(mark: str) -> Column:
    """Version on the first line that holds ``mark`` in any case, ``''`` without one."""
    holds = F.contains(F.lower("line"), F.lit(mark.lower()))
    version = F.regexp_extract("line", K.VERSION_PATTERN, 0)
    first = F.min_by(version, F.when(holds, F.struct("block", "place")))
    return F.coalesce(F.when(F.bool_or(holds), first), F.lit(""))


def fold_logs(lines: DataFrame, tail_lines: int | None = None) -> DataFrame:
    """One row per log of ``lines``: ``path, build_passed, netcdf_c, netcdf_f``.

    Equals ``parse_logs`` over whole texts. Every field folds in the map tasks, so what is
    shuffled is a row per file and task. With ``tail_lines`` the result has
    ``tail_passed``, too: whether the success message is among that many last lines.
    """
    success = F.contains("line", F.lit(K.SUCCESS_MESSAGE))
    found = lines.groupBy("path").agg(
        F.bool_or(success).alias("build_passed"),
        _topmost(K.NETCDF_C_MARK).alias("netcdf_c"),
        _topmost(K.NETCDF_F_MARK).alias("netcdf_f"),
    )
    if tail_lines is None:
        return found
    blocks = lines.groupBy("path", "block").agg(
        F.count("*").alias("n"),
        (F.max("place") - F.max(F.when(success, F.col("place")))).alias("after"),
    )
    behind = W.partitionBy("path").orderBy(F.desc("block")).rowsBetween(W.unboundedPreceding, -1)
    after = F.col("after") + F.coalesce(F.sum("n").over(behind), F.lit(0))
    passed = F.coalesce(F.min("after") < tail_lines, F.lit(False)).alias("tail_passed")
    tails = blocks.withColumn("after", after).groupBy("path").agg(passed)
    return found.join(tails, "path")
