"""All jobs of a run in one plan: match, parse, look up, merge, report."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from runledger import constants as K
from runledger.functions.formatting import RECORD_COLUMNS
from runledger.functions.parsing import parse_logs, parse_reports
from runledger.operators.history import jobs_without
from runledger.operators.lookup import build_map, with_build_outcome, with_latest_commit
from runledger.operators.matching import (
    few_jobs,
    match_lines,
    match_texts,
    matches_of_few_jobs,
    matches_of_jobs,
    owned_by,
    paths_of_jobs,
)
from runledger.operators.merge import ARRIVAL, arrival_seq
from runledger.session import stage
from runledger.sinks.ledger import Ledger, result_counts
from runledger.sinks.reports import write_reports
from runledger.sources.lines import fold_logs

SCOPE = ("machine", "job_branch", "branch_hash")
LEDGER_COLUMNS = (*RECORD_COLUMNS, "source_path", ARRIVAL)


@dataclass
class Run:
    """What a run leaves: its results, what it turned away, and jobs it found nothing for."""

    results: DataFrame
    rejects: DataFrame
    missing: DataFrame
    ledger: Ledger | None = None
    counts: dict[str, int] | None = None


def requests_of(hashes: DataFrame) -> DataFrame:
    """Recent versions per job as match requests."""
    return hashes.select(
        "machine",
        "machine_pos",
        F.col("branch").alias("job_branch"),
        "branch_pos",
        "hash_rank",
        "branch_hash",
    )


def owned_files(
    files: DataFrame, requests: DataFrame, exact_machine: bool = False, key_value: bool = False
) -> tuple[DataFrame, DataFrame]:
    """The files whose path some job owns, and the pairs of path and job.

    The pairs come from the paths alone; the files are cut down to them before their
    texts are looked at, in a broadcast join while the paths are few.
    """
    jobs = requests.select("machine", F.col("job_branch").alias("branch")).distinct()
    pairs = paths_of_jobs(files.select("path").distinct(), jobs, exact_machine, key_value)
    pairs = stage(pairs.select("path", "machine", "branch").distinct(), "owned")
    mine = pairs.select("path").distinct()
    return files.join(mine, "path", "left_semi"), pairs


def _matched_outcomes(logs: DataFrame, requests: DataFrame, literal: bool) -> DataFrame:
    """Outcome of every log with each version it matches, from whole texts or from lines."""
    if "line" not in logs.columns:
        texts = logs.select("path", "text", "match_text")
        # Of equal paths one outcome is kept afterwards, so none is dropped here.
        return match_texts(parse_logs(texts).drop("text"), requests, literal=literal, once=False)
    lines = logs.select("path", F.array(F.replace("line", F.lit("\ufffd"), F.lit(""))).alias("lines"))
    matches = match_lines(lines, requests, literal=literal)
    return matches.join(fold_logs(logs), "path")


def summarize(
    reports: DataFrame,
    logs: DataFrame,
    hashes: DataFrame,
    latest: DataFrame,
    run_id: int = 0,
    literal: bool = False,
    exact_machine: bool = False,
    on_incomplete: str = "reject",
    strip_token: str | None = K.STRIPPED_PATH_TOKEN,
    key_value: bool = False,
    requests: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """``(results, rejects)`` of every job and version at once.

    ``reports`` and ``logs`` are ``(path, text, match_text)``, ``hashes`` comes from
    ``recent_hashes``, ``latest`` from ``latest_commits``. Logs may come as lines instead,
    as ``log_lines`` gives them, which suits logs too long for a row. Paths are tested first: only
    files some job owns are read and parsed. Against few jobs a path is tested in its own row, so
    that no text is shuffled; many jobs meet the paths in a join. Texts are reduced to records and version lines
    where they are read. A build log counts for the job and version it matched itself.
    ``exact_machine`` wants the machine as a path component instead of anywhere in the path.
    ``on_incomplete`` sets aside reports that lack a header or a result (``reject``) or
    fails on them (``fail``).
    """
    requests = stage(requests_of(hashes), "requests") if requests is None else requests
    jobs, rules = few_jobs(requests), (exact_machine, key_value)

    def owned(files: DataFrame) -> tuple[DataFrame, DataFrame | None]:
        if jobs is None:
            return owned_files(files, requests, *rules)
        return files.where(owned_by(jobs, *rules)), None

    def of_jobs(matches: DataFrame, pairs: DataFrame | None) -> DataFrame:
        if jobs is None:
            return matches_of_jobs(matches, pairs, requests)
        return matches_of_few_jobs(matches, jobs, requests, *rules)

    own_reports, pairs = owned(reports)
    records = parse_reports(own_reports.select("path", "text", "match_text")).drop("text")
    # A record travels as one column, so that dropping duplicates compares path and version only.
    fields = [c for c in records.columns if c not in ("path", "match_text")]
    found = match_texts(
        records.select("path", "match_text", F.struct(*fields).alias("record")),
        requests,
        literal=literal,
    ).select("path", "branch_hash", "record.*")
    found = stage(of_jobs(found, pairs), "found")
    own_logs, pairs = owned(logs)
    built = of_jobs(_matched_outcomes(own_logs, requests, literal), pairs)
    if on_incomplete == "fail":
        message = F.concat_ws(" ", F.lit("incomplete report:"), "reject_reason", "path")
        found = found.withColumn(
            "reject_reason",
            F.when(F.col("reject_reason").isNotNull(), F.raise_error(message).cast("string")),
        )
    rejects = found.where(F.col("reject_reason").isNotNull()).select(
        "path", *SCOPE, "reject_reason"
    )
    whole = found.where(F.col("reject_reason").isNull()).drop("reject_reason")
    # Far smaller than the reports. Read back, it has a known size for the choice of join, and
    # where it is too large to broadcast both sides are plain shuffles, which AQE can split.
    builds = stage(build_map(built, SCOPE, strip_token, key_value), "builds")
    results = with_latest_commit(with_build_outcome(whole, builds, SCOPE), latest)
    results = results.withColumns({ARRIVAL: arrival_seq(run_id), "source_path": F.col("path")})
    job = ("machine", "machine_pos", "job_branch", "branch_pos", "hash_rank")
    return results.select(*job, *LEDGER_COLUMNS), rejects


def run(
    reports: DataFrame,
    logs: DataFrame,
    hashes: DataFrame,
    latest: DataFrame,
    ledger: Ledger,
    base_url: str,
    target: str | None = None,
    run_id: int | None = None,
    source: str = "run",
    oversized: DataFrame | None = None,
    **options,
) -> Run:
    """Summarise, merge into the ledger and write the reports below ``target``.

    The run takes its place in the ledger when it starts, after all runs that started
    before it; with the ``run_id`` of an earlier run of its ``source`` it takes that run's
    place and replaces its rows. ``counts`` of the run are taken while its results are
    written. ``oversized`` files, which nothing reads, are among its rejects.
    """
    run_id = ledger.claim(source, run_id)
    requests = stage(requests_of(hashes), "requests")
    results, rejects = summarize(
        reports, logs, hashes, latest, run_id, requests=requests, **options
    )
    counted = Observation(f"run-{uuid.uuid4().hex}")
    results = stage(results.observe(counted, *[c.alias(n) for n, c in result_counts().items()]), "results")
    if oversized is not None:
        unread = oversized.select("path", F.lit("oversized").alias("reject_reason"))
        rejects = rejects.unionByName(unread, allowMissingColumns=True)
    if target:
        stored = ledger.read() if ledger.exists() else None
        write_reports(results, stored, base_url, target, ledger.keys)
    ledger.merge(results.select(*LEDGER_COLUMNS), run_id, source)
    missing = jobs_without(requests, results, SCOPE)
    return Run(results, rejects, missing, ledger, dict(counted.get))


def listing(ledger: DataFrame, token: str | None = None) -> DataFrame:
    """Ledger rows of one version, or of all, in report order."""
    rows = ledger if token is None else ledger.where(F.col("branch_hash") == token)
    return rows.orderBy(*[F.col(c).asc_nulls_first() for c in (*K.REPORT_ORDER, "os")])
