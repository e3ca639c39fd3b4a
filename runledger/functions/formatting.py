"""From ledger rows to what a report shows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runledger import constants as K
from runledger.functions.versions import sanitize_branch

# What a ledger row says, lineage left out.
RECORD_COLUMNS = (
    *K.LEDGER_KEY,
    *[f"{kind}_{part}" for kind in K.KINDS for part in ("pass", "fail", "status")],
    "build_passed",
    "netcdf_c",
    "netcdf_f",
    "artifacts_hash",
    "branch_hash",
    "modified",
)


def count_text(number: Column, status: Column) -> Column:
    """A result as the archive keeps it: the number, or the word ``fail``."""
    return F.when(status == "fail", K.FAILED).otherwise(number.cast("string"))


def archive_rows(df: DataFrame) -> DataFrame:
    """Ledger rows in archive column order, numbers and the word ``fail`` in one column."""
    columns = []
    for name in K.ARCHIVE_COLUMNS:
        columns.append(_archive_column(name).alias(name))
    return df.select(*columns)


def _archive_column(name: str) -> Column:
    for kind, short in K.KINDS.items():
        for side in ("pass", "fail"):
            if name == f"{short}_{side}":
                return count_text(F.col(f"{kind}_{side}"), F.col(f"{kind}_status"))
    if name == "build":
        return F.col("build_passed").cast("int")
    return F.col(name)


def relative_path() -> Column:
    parts = ("branch", "host", "compiler", "c_version", "o_g", "mpi", "m_version")
    return F.concat_ws("/", *[F.col(p) for p in parts])


def artifact_link(base_url: str, commit: Column, path: Column) -> Column:
    return F.concat(
        F.lit(f"[artifacts]({base_url}/tree/"), commit, F.lit("/"), path, F.lit(")")
    )


def older_artifact_link(base_url: str) -> Column:
    """Link form that addresses the host's own branch instead of a commit."""
    host, branch = sanitize_branch(F.col("host")), sanitize_branch(F.col("branch"))
    path = F.concat_ws(
        "/", host, branch, host, "compiler", "c_version", "o_g", "mpi", F.lower("m_version")
    )
    return F.concat(F.lit(f"[artifacts]({base_url}/tree/"), path, F.lit(")"))


def report_rows(df: DataFrame, base_url: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """The report columns as text, after any ``keep`` columns of the ledger."""
    shown: dict[str, Column] = {name: F.col(name) for name in ("branch", "host", "o_g", "os")}
    for kind, short in K.KINDS.items():
        for side in ("pass", "fail"):
            number, status = F.col(f"{kind}_{side}"), F.col(f"{kind}_status")
            shown[f"{short}_{side}"] = F.when(
                (status == "ok") & (number == K.QUEUED), K.PENDING
            ).otherwise(count_text(number, status))
    shown["build"] = F.when(F.col("build_passed"), K.PASSED).otherwise(K.FAILED)
    shown["compiler"] = F.concat_ws(" ", "compiler", "c_version")
    shown["mpi"] = F.concat_ws(" ", "mpi", "m_version")
    shown["netcdf"] = F.concat_ws(" ", "netcdf_c", "netcdf_f")
    shown["artifacts_hash"] = artifact_link(base_url, F.col("artifacts_hash"), relative_path())
    shown["modified"] = F.col("modified")
    return df.select(
        *[F.col(k) for k in keep], *[shown[name].alias(name) for name in K.REPORT_COLUMNS]
    )


def output_location(root: str, branch: Column, token: Column) -> Column:
    return F.concat_ws("/", F.lit(root), sanitize_branch(branch), token)


def concatenated_order_key() -> Column:
    """Sort key of the older listing: the report order's columns run together."""
    return F.concat(*[F.col(c) for c in K.REPORT_ORDER])
