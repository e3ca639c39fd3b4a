"""Jobs and the recent versions each one covers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from runledger import constants as K
from runledger.functions.versions import branch_from_log_line, hash_token, sanitize_branch
from runledger.operators.postings import candidate_pairs
from runledger.session import stage
from runledger.sources.commits import commit_lines

_PLAIN = r"\A[A-Za-z0-9_-]*\z"


def ordered_distinct(
    df: DataFrame, value: str, at: str | Column, keys: Sequence[str] = ()
) -> DataFrame:
    """Each value once per key, with the place of its first occurrence as ``first_at``."""
    at = F.col(at) if isinstance(at, str) else at
    return df.groupBy(*keys, value).agg(F.min(at).alias("first_at"))


def job_grid(branches: DataFrame, machines: Sequence[str] = K.MACHINES, qty: int = 1) -> DataFrame:
    """Every machine with every branch of ``branches(branch, branch_pos)``.

    The machines are run configuration, a short list, so the product is an explode of a
    literal array inside each branch row and moves no data.
    """
    names = F.array(*[F.lit(m) for m in machines])
    return branches.select(
        F.posexplode(names).alias("machine_pos", "machine"),
        "branch",
        "branch_pos",
        F.lit(qty).alias("qty"),
    )


def log_branches(commits: DataFrame) -> DataFrame:
    """Distinct branches named anywhere in the log, with the place of the newest mention."""
    named = commit_lines(commits).select("at", branch_from_log_line(F.col("line")).alias("branch"))
    return ordered_distinct(named.where(F.col("branch") != ""), "branch", "at")


def with_branch_pos(branches: DataFrame, at: str = "first_at") -> DataFrame:
    """Turn a place of any type into the ``branch_pos`` a job grid carries."""
    return branches.select("branch", F.col(at).alias("branch_pos"))


def _folded_lines(commits: DataFrame) -> DataFrame:
    """Equal lines of a machine's log as one, with their first place ``at``.

    The place is folded as a number first, which hashes in the map tasks; only what that
    leaves is compared as a whole place. A missing place comes first, as in an ordering.
    """
    lines = commit_lines(commits).where(F.col("line").contains(F.col("machine")))
    keys = ["machine", "line", F.col("at.line_no").alias("line_no"), F.col("at.pos").isNull().alias("_none")]
    folded = lines.groupBy(*keys).agg(F.min("at.pos").alias("pos"))
    return folded.groupBy("machine", "line").agg(F.min(F.struct("pos", "line_no")).alias("at"))


def recent_hashes(
    commits: DataFrame,
    jobs: DataFrame,
    qty: int | None = None,
    patterns: Sequence[str] = K.HASH_PATTERNS,
    exact: bool = False,
) -> DataFrame:
    """The newest distinct versions per job, ``hash_rank`` 1 for the newest.

    A job gets as many as its own ``qty`` says, or all jobs ``qty`` where that is given;
    none or less than one gives no version. A commit line counts for a job when it names
    the machine and the sanitised branch, read as a regular expression, hits it; ``exact``
    demands the branch the line names. Equal lines are folded first. Lines and branches
    meet on the machine and on letters the branch requires, so the lines of a machine
    that holds most of the log spread over its branches. Groups are cut to the largest
    quantity in the map tasks before they meet.
    """
    lines = _folded_lines(commits).withColumn("branch_hash", hash_token(F.col("line"), patterns))
    lines = lines.where(F.col("branch_hash") != "")
    token = sanitize_branch(F.col("branch"))
    keys = ["machine", "branch"]
    wanted = jobs.withColumn("qty", F.col("qty") if qty is None else F.lit(qty))
    carried = [c for c in wanted.columns if c not in keys]
    wanted = wanted.withColumn("_token", token)
    if exact:
        lines = lines.withColumn("_token", branch_from_log_line(F.col("line")))
        folded = lines.groupBy("machine", "_token", "branch_hash").agg(F.min("at").alias("at"))
        met = stage(folded, "lines")
    else:
        # Read back, so that hot keys of the join can be split.
        pairs = candidate_pairs(stage(lines, "lines"), wanted, "line", "_token", ["machine"])
        # A branch without regular-expression signs is looked for as text, which saves
        # compiling a pattern for every pair.
        named = F.when(
            F.regexp_like("_token", F.lit(_PLAIN)), F.col("line").contains(F.col("_token"))
        ).otherwise(F.regexp_like("line", F.col("_token")))
        met = pairs.where(named).drop("line")
    joined = met.join(wanted, ["machine", "_token"])
    first = joined.groupBy(*keys, *carried, "branch_hash").agg(F.min("at").alias("first_at"))
    if qty is None:
        qty = wanted.agg(F.coalesce(F.max("qty"), F.lit(0))).first()[0]
    rank = F.row_number().over(W.partitionBy(*keys).orderBy("first_at", "branch_hash"))
    ranked = first.withColumn("hash_rank", rank).where(F.col("hash_rank") <= max(qty, 0))
    return ranked.where(F.col("hash_rank") <= F.col("qty"))


def jobs_without(jobs: DataFrame, results: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Jobs, or jobs and versions, that no result belongs to."""
    return jobs.join(results.select(*keys), list(keys), "left_anti")
