"""Markdown, CSV and aligned text, one report per version, all in one pass."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from runledger import constants as K
from runledger.functions.formatting import RECORD_COLUMNS, report_rows
from runledger.functions.versions import sanitize_branch
from runledger.operators.lookup import greatest_by
from runledger.operators.merge import latest_per_key
from runledger.operators.ordering import ordered_positions
from runledger.session import stage

_MIN_PADDING = 2
_INTEGER = r"\A[+-]?[0-9]+\z"


def numbered_rows(
    ledger: DataFrame, base_url: str, groups: Sequence[str] = ("branch_hash",)
) -> DataFrame:
    """Report rows of every group with ``position`` in report order."""
    order = [*K.REPORT_ORDER, "os"]
    keyed = ledger.withColumns({f"_o{i}": F.col(c) for i, c in enumerate(order)})
    names = [f"_o{i}" for i in range(len(order))]
    rows = report_rows(keyed, base_url, (*groups, *names))
    return ordered_positions(rows, list(groups), names).drop(*names)


def column_widths(rows: DataFrame, groups: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Per group the longest text of each column and whether all its texts are integers."""
    aggs = [F.count("*").alias("_rows")]
    for i, c in enumerate(columns):
        aggs.append(F.max(F.length(c)).alias(f"_w{i}"))
        aggs.append(F.bool_and(F.regexp_like(c, F.lit(_INTEGER))).alias(f"_n{i}"))
    return rows.groupBy(*groups).agg(*aggs)


def _cell(text: Column, width: Column, numeric: Column) -> Column:
    return F.when(numeric, F.lpad(text, width, F.lit(" "))).otherwise(
        F.rpad(text, width, F.lit(" "))
    )


def markdown_lines(
    rows: DataFrame,
    columns: Sequence[str] = K.REPORT_COLUMNS,
    groups: Sequence[str] = ("branch_hash",),
) -> DataFrame:
    """``(groups, line_no, line)`` of a pipe table with a leading row number.

    Columns of integers only are set to the right, all others to the left; a column is at
    least two wider than its heading.
    """
    sizes = stage(column_widths(rows, groups, columns), "widths")
    index_width = F.greatest(F.lit(_MIN_PADDING), F.length((F.col("_rows") - 1).cast("string")))
    widths = [index_width] + [
        F.greatest(F.lit(len(c) + _MIN_PADDING), F.col(f"_w{i}")) for i, c in enumerate(columns)
    ]
    numeric = [F.lit(True)] + [F.col(f"_n{i}") for i in range(len(columns))]
    headings = [F.lit("")] + [F.lit(c) for c in columns]
    cells = [F.col("position").cast("string")] + [F.col(c) for c in columns]

    def table_line(texts: Sequence[Column]) -> Column:
        padded = [_cell(t, w, n) for t, w, n in zip(texts, widths, numeric)]
        return F.concat(F.lit("| "), F.concat_ws(" | ", *padded), F.lit(" |"))

    rule = F.concat(
        F.lit("|"),
        F.concat_ws("|", *[F.repeat(F.lit("-"), w + 2) for w in widths]),
        F.lit("|"),
    )
    head = sizes.select(
        *groups,
        F.posexplode(F.array(table_line(headings), rule)).alias("line_no", "line"),
    ).withColumn("line_no", F.col("line_no").cast("bigint"))
    body = rows.join(sizes, list(groups)).select(
        *groups, (F.col("position") + 2).alias("line_no"), table_line(cells).alias("line")
    )
    return head.unionByName(body)


def batch_at() -> Column:
    """When a job's version was merged: job by job, newest version first."""
    return F.struct("machine_pos", "branch_pos", "hash_rank")


def report_targets(results: DataFrame) -> DataFrame:
    """Reports a run writes, with the batch ``at`` which each is written last.

    Every branch that processed a version has a report of it.
    """
    branch_dir = sanitize_branch(F.col("job_branch")).alias("branch_dir")
    return results.groupBy(branch_dir, "branch_hash").agg(F.max(batch_at()).alias("at"))


def latest_targets(results: DataFrame) -> DataFrame:
    """The version each folder's latest report shows, and the batch it is written after.

    Only a job's newest version counts; of several machines the last one decides.
    """
    newest = results.where(F.col("hash_rank") == 1).withColumns(
        {"branch_dir": sanitize_branch(F.col("job_branch")), "at": batch_at()}
    )
    return greatest_by(newest, ["branch_dir"], ["at", "branch_hash"], ["branch_hash", "at"])


def row_versions(
    results: DataFrame, stored: DataFrame | None, keys: Sequence[str]
) -> DataFrame:
    """Every row a run merged with its batch ``at`` and the batch ``until`` which it stood.

    Rows stored before the run have no ``at``. A batch keeps the last row of a key, so a
    key has no more versions than there are batches that touch it, and the window over
    them stays short however many reports share the key.
    """
    merged = latest_per_key(results.withColumn("at", batch_at()), [*keys, "at"])
    columns = [*dict.fromkeys([*keys, *RECORD_COLUMNS]), "at"]
    merged = merged.select(*columns)
    if stored is not None:
        wanted = results.select("branch_hash").distinct()
        before = stored.join(wanted, "branch_hash", "left_semi")
        at = F.lit(None).cast(merged.schema["at"].dataType)
        merged = merged.unionByName(before.withColumn("at", at).select(*columns))
    following = F.lead("at").over(W.partitionBy(*keys).orderBy("at"))
    return merged.withColumn("until", following)


def report_contents(versions: DataFrame, targets: DataFrame) -> DataFrame:
    """The rows each report shows: those of its version that stood when it was written.

    With several versions per run an older one may later take a row's place in the
    ledger; the report of the newer one keeps the row.
    """
    named = targets.select(
        F.col("branch_dir").alias("report_branch"),
        F.col("branch_hash").alias("report_hash"),
        F.col("at").alias("_written"),
    )
    merged = F.col("at").isNull() | (F.col("at") <= F.col("_written"))
    stands = F.col("until").isNull() | (F.col("until") > F.col("_written"))
    on = F.col("branch_hash") == F.col("report_hash")
    return versions.join(named, on).where(merged & stands).drop("at", "until", "_written")


def write_text(lines: DataFrame, folders: Sequence[str], target: str) -> None:
    """One folder per report, its lines in order over the sorted part files.

    Long reports are spread over several tasks; concatenating a folder's parts in name
    order gives the report. Reports that ``lines`` does not cover stay as they are.
    """
    placed = _placed(lines, folders, "line_no").select(*folders, "line")
    writer = placed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy(*folders).text(target)


def csv_lines(
    rows: DataFrame, folders: Sequence[str], columns: Sequence[str] = K.REPORT_COLUMNS
) -> DataFrame:
    """``(folders, line_no, line)``: a heading as line 0 of each report, then its rows.

    Quotes are doubled; an empty text is written as nothing, like a missing one.
    """
    options = {
        "escape": '"',
        "emptyValue": "",
        "ignoreLeadingWhiteSpace": "false",
        "ignoreTrailingWhiteSpace": "false",
    }
    head = rows.select(*folders).distinct().select(
        *folders, F.lit(0).cast("bigint").alias("line_no"), F.lit(",".join(columns)).alias("line")
    )
    body = rows.select(
        *folders,
        (F.col("position") + 1).cast("bigint").alias("line_no"),
        F.to_csv(F.struct(*columns), options).alias("line"),
    )
    return head.unionByName(body)


def write_csv(
    rows: DataFrame, folders: Sequence[str], target: str, encoding: str = K.REPORT_ENCODING
) -> None:
    """Reports as CSV: a folder's parts in name order are one file with one heading.

    The text writer passes bytes on as they are, so lines are handed to it in ``encoding``.
    In ISO-8859-1 a sign it lacks is written as a question mark.
    """
    columns = [c for c in rows.columns if c not in (*folders, "position")]
    lines = csv_lines(rows, folders, columns)
    text = F.col("line")
    if encoding == "ISO-8859-1":
        text = F.regexp_replace(text, r"[^\x00-\xFF]", "?")
    encoded = text if encoding == "UTF-8" else F.encode(text, encoding).cast("string")
    write_text(lines.withColumn("line", encoded), folders, target)


def _placed(df: DataFrame, folders: Sequence[str], place: str) -> DataFrame:
    # Folder columns that cannot be null keep the writer from sorting again.
    df = df.withColumns({f: F.coalesce(F.col(f), F.lit("")) for f in folders})
    columns = [*folders, place]
    return df.repartitionByRange(*columns).sortWithinPartitions(*columns)


def write_reports(
    results: DataFrame,
    stored: DataFrame | None,
    base_url: str,
    target: str,
    keys: Sequence[str] = K.LEDGER_KEY,
) -> None:
    """Markdown, CSV and latest reports below ``target`` for everything ``results`` covers.

    ``results`` has one row per report and job, ``stored`` the ledger before the run. A
    version without rows gets no file. Folders carry their own column names, so that CSV
    keeps its ``branch`` column.
    """
    versions = stage(row_versions(results, stored, keys), "versions")
    folders = ["report_branch", "report_hash"]
    contents = report_contents(versions, stage(report_targets(results), "targets"))
    rows = stage(numbered_rows(contents, base_url, folders), "report_rows")
    write_text(markdown_lines(rows, groups=folders), folders, f"{target}/markdown")
    csv = rows.select(*folders, "position", *K.REPORT_COLUMNS)
    write_csv(csv, folders, f"{target}/csv")
    newest = report_contents(versions, stage(latest_targets(results), "targets"))
    rows = stage(numbered_rows(newest, base_url, folders), "latest_rows")
    write_text(
        markdown_lines(rows, groups=folders), ["report_branch"], f"{target}/latest"
    )


def write_branch_reports(ledger: DataFrame, branch: str, base_url: str, target: str) -> None:
    """Write the report of every version stored for ``branch`` anew, from the ledger alone."""
    hashes = ledger.where(F.col("branch") == branch).select("branch_hash").distinct()
    shown = ledger.join(hashes, "branch_hash", "left_semi")
    rows = stage(
        numbered_rows(shown, base_url).withColumnRenamed("branch_hash", "report_hash"), "rows"
    )
    write_text(markdown_lines(rows, groups=["report_hash"]), ["report_hash"], f"{target}/markdown")
    write_csv(
        rows.select("report_hash", "position", *K.REPORT_COLUMNS), ["report_hash"], f"{target}/csv"
    )


def aligned_lines(rows: DataFrame, columns: Sequence[str], groups: Sequence[str]) -> DataFrame:
    """Space-aligned lines: columns two blanks apart, the last one not padded."""
    sizes = stage(column_widths(rows, groups, columns), "widths")
    padded = [
        F.rpad(F.col(c), F.col(f"_w{i}"), F.lit(" ")) for i, c in enumerate(columns[:-1])
    ] + [F.col(columns[-1])]
    return rows.join(sizes, list(groups)).select(
        *groups, F.col("position").alias("line_no"), F.concat_ws("  ", *padded).alias("line")
    )
