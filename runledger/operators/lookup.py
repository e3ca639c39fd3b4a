"""Lookups with defaults."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runledger import constants as K
from runledger.functions.paths import path_attributes
from runledger.operators.postings import candidate_pairs
from runledger.session import stage


def greatest_by(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], values: Sequence[str]
) -> DataFrame:
    """Per key the ``values`` of the row that is last in ``order``; folded in the map tasks."""
    picked = F.max_by(F.struct(*values), F.struct(*order)).alias("_picked")
    return df.groupBy(*keys).agg(picked).select(*keys, *[f"_picked.{v}" for v in values])


def least_by(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], values: Sequence[str]
) -> DataFrame:
    picked = F.min_by(F.struct(*values), F.struct(*order)).alias("_picked")
    return df.groupBy(*keys).agg(picked).select(*keys, *[f"_picked.{v}" for v in values])


def build_map(
    logs: DataFrame,
    scope: Sequence[str] = (),
    strip_token: str | None = K.STRIPPED_PATH_TOKEN,
    key_value: bool = False,
) -> DataFrame:
    """One build outcome per attribute set; of several logs the one with the greatest path."""
    keyed = logs.withColumns(path_attributes(F.col("path"), strip_token, key_value))
    return greatest_by(
        keyed,
        [*scope, *K.LOOKUP_KEY],
        ["path"],
        ["build_passed", "netcdf_c", "netcdf_f"],
    )


def lookup_key(name: str) -> Column:
    return F.lower(F.coalesce(F.col(name), F.lit(K.NO_ATTRIBUTE)))


def with_build_outcome(
    reports: DataFrame, builds: DataFrame, scope: Sequence[str] = ()
) -> DataFrame:
    """Left join on the lower-cased attributes; a build value replaces the report's own.

    A miss is a failed build of unknown versions, a hit without a version is ``N/A``.
    Whether the build side is broadcast is left to its measured size; beyond that AQE
    splits the hot attribute sets of the report side.
    """
    values = ["build_passed", "netcdf_c", "netcdf_f"]
    right = builds.select(
        *[F.col(s).alias(f"_s_{s}") for s in scope],
        *[F.col(k).alias(f"_k_{k}") for k in K.LOOKUP_KEY],
        *[F.col(v).alias(f"_b_{v}") for v in values],
        F.lit(True).alias("_hit"),
    )
    on = F.lit(True)
    for s in scope:
        on = on & (F.col(s) == F.col(f"_s_{s}"))
    for k in K.LOOKUP_KEY:
        on = on & (lookup_key(k) == F.col(f"_k_{k}"))
    hit = F.coalesce(F.col("_hit"), F.lit(False))
    outcome = {
        "build_passed": F.when(hit, F.col("_b_build_passed")).otherwise(F.lit(False)),
        **{
            v: F.when(~hit, K.UNKNOWN)
            .when(F.col(f"_b_{v}") == "", K.NOT_AVAILABLE)
            .otherwise(F.col(f"_b_{v}"))
            for v in ("netcdf_c", "netcdf_f")
        },
    }
    joined = reports.drop(*values).join(right, on, "left").withColumns(outcome)
    return joined.drop(*right.columns)


def latest_commits(commit_files: DataFrame, commits: DataFrame) -> DataFrame:
    """The newest commit that touched each path in each machine's log.

    ``(machine, path, artifacts_hash, modified)``. Places in two machines' logs are not
    compared, and a commit that stands in several logs counts in each.
    """
    placed = commits.select("machine", "commit_hash", "pos", "committed_at")
    # Dealt by commit alone, which serves both dropping repeats and the join.
    files = commit_files.select("commit_hash", "path").repartition("commit_hash").distinct()
    touched = files.join(placed, "commit_hash")
    keys = ["machine", "path"]
    newest = least_by(touched, keys, ["pos", "commit_hash"], ["commit_hash", "committed_at"])
    return newest.select(
        *keys,
        F.trim("commit_hash").alias("artifacts_hash"),
        F.trim("committed_at").alias("modified"),
    )


def with_latest_commit(records: DataFrame, latest: DataFrame) -> DataFrame:
    """Attach commit and time by machine and path; a file no commit names gets empty texts."""
    joined = records.join(latest, ["machine", "path"], "left")
    return joined.withColumns(
        {c: F.coalesce(F.col(c), F.lit("")) for c in ("artifacts_hash", "modified")}
    )


def modified_time(modified: Column) -> Column:
    return F.try_to_timestamp(modified, F.lit("yyyy-MM-dd HH:mm:ss Z"))


def first_matching(
    values: DataFrame, patterns: DataFrame, value: str, name: str, pattern: str, order: str
) -> DataFrame:
    """``values`` with the ``name`` of the first pattern that matches ``value`` from its start.

    ``patterns`` is a table, first in ``order``; equal places go by name. A value no
    pattern matches, or null, gets null. Distinct values meet the patterns by letters
    these require, so neither side is compared with everything, and the answers come
    back by value.
    """
    asked = stage(values.select(value).where(F.col(value).isNotNull()).distinct(), "values")
    rules = patterns.select(F.col(pattern).alias("_rule"), F.col(order).alias("_at"), F.col(name).alias("_name"))
    rules = rules.where(F.col("_rule").isNotNull())
    pairs = candidate_pairs(asked, rules, value, "_rule")
    hits = pairs.where(F.regexp_like(value, F.concat(F.lit("^(?:"), "_rule", F.lit(")")))).distinct()
    first = F.min_by("_name", F.struct("_at", "_name")).alias(name)
    found = stage(hits.join(rules, "_rule").groupBy(value).agg(first), "first")
    return values.join(found, value, "left").select(*values.columns, name)
