"""The older, space-aligned text report of one branch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runledger import constants as K
from runledger.functions.parsing import text_report_fields
from runledger.functions.paths import path_parts
from runledger.functions.versions import message_hash
from runledger.operators.lookup import least_by
from runledger.operators.matching import containing_mark
from runledger.operators.ordering import ordered_positions
from runledger.session import stage
from runledger.sinks.reports import aligned_lines, write_text
from runledger.sources.commits import commit_lines
from runledger.sources.files import named_files

_COLUMNS = (
    "os",
    "host",
    "compiler",
    "c_version",
    "mpi",
    "m_version",
    "o_g",
    *[f"{kind}_{side}" for kind in K.KINDS for side in ("pass", "fail")],
)


def newest_hashes(commits: DataFrame, branch: str) -> DataFrame:
    """Per machine the version in the newest commit line that mentions ``branch``."""
    lines = commit_lines(commits).where(F.regexp_like("line", F.lit(branch)))
    newest = least_by(lines, ["machine"], ["at"], ["line"])
    hashes = newest.select("machine", message_hash(F.col("line")).alias("branch_hash"))
    return hashes.where(F.col("branch_hash") != "")


def text_report_rows(reports: DataFrame, hashes: DataFrame, branch: str) -> DataFrame:
    """Rows of ``reports(path, text)`` under the branch's folder whose text names a version.

    Layout: branch, host, compiler, its version, o_g, mpi, its version, file. The serial
    mpi has no version level and shows ``none``. All fields of a row come from its own
    file, so a missing line cannot shift another row.
    """
    parts = path_parts(F.col("path"))
    inside = named_files(reports).where(F.try_element_at(parts, F.lit(2)) == branch)
    place = {"host": 3, "compiler": 4, "c_version": 5, "o_g": 6, "mpi": 7, "m_version": 8}
    columns = {name: F.try_element_at(parts, F.lit(at)) for name, at in place.items()}
    columns["m_version"] = F.when(columns["mpi"] == "mpiuni", K.NO_ATTRIBUTE).otherwise(
        columns["m_version"]
    )
    columns.update(text_report_fields(F.col("text")))
    rows = inside.select("path", "text", *[columns[c].alias(c) for c in _COLUMNS])
    wanted = hashes.select("branch_hash").distinct()
    return containing_mark(rows, wanted, K.HASH_MARK).select("branch_hash", "path", *_COLUMNS)


def text_report(reports: DataFrame, commits: DataFrame, branch: str) -> DataFrame:
    """``(branch_hash, line_no, line)`` of each report, header sorted along with the rows."""
    hashes = newest_hashes(commits, branch)
    rows = stage(text_report_rows(reports, hashes, branch), "text_rows")
    header = rows.select("branch_hash").distinct()
    header = header.select(
        "branch_hash",
        F.lit("").alias("path"),
        *[F.lit(h).alias(c) for h, c in zip(K.ALIGNED_HEADER, _COLUMNS)],
    )
    rows = rows.unionByName(header).withColumn("_line", F.concat_ws(" ", *_COLUMNS))
    placed = ordered_positions(rows, ["branch_hash"], ["host", "_line", "path"])
    return aligned_lines(placed, _COLUMNS, ["branch_hash"])


def write_text_report(
    reports: DataFrame, commits: DataFrame, branch: str, target: str
) -> None:
    """One folder per version below ``target``."""
    write_text(text_report(reports, commits, branch), ["branch_hash"], target)
