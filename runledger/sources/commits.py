"""Commit logs and reference listings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runledger.functions.text import split_lines, strip


def commit_lines(commits: DataFrame) -> DataFrame:
    """Body lines of ``commits(machine, pos, message)`` with their place in the log.

    ``pos`` rises from newest to oldest; it need not be dense. ``at`` orders all lines.
    """
    return commits.select(
        "machine", "pos", F.posexplode(split_lines(F.col("message"))).alias("line_no", "raw")
    ).select(
        "machine",
        F.struct("pos", "line_no").alias("at"),
        strip(F.col("raw")).alias("line"),
    )


def listed_branches(listing: DataFrame) -> DataFrame:
    """Branch names of a heads listing ``(pos, line)``, ``sha<TAB>refs/heads/<name>`` a line."""
    name = F.replace(
        F.element_at(F.split("line", "\t"), 2), F.lit("refs/heads/"), F.lit("")
    )
    return listing.where(F.length("line") > 0).select(F.col("pos"), name.alias("branch"))
