"""Every query over the sample tables, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runledger import constants as K
from runledger.catalog import samples as S
from runledger.functions import formatting, parsing, paths, text, versions
from runledger.operators import history, lookup, matching, merge, ordering
from runledger.plans import summarize as plan
from runledger.plans.textreport import text_report
from runledger.session import TASKS_MOVE_FILES, file_tasks, scratch_dir, stage
from runledger.sinks import reports as R
from runledger.sinks.ledger import Ledger, run_counts
from runledger.sources import commits as C
from runledger.sources import config as cfg
from runledger.sources.files import in_path_order, list_tree, logs_of, reports_of, scan_tree
from runledger.sources.lines import fold_logs, log_lines
from runledger.streaming.ingest import ingest, stream_packed

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
QTY = 3
EVENT_MACHINES = ("click", "error", "purchase", "signup", "view")
HOST_PATTERNS = (
    ("blogs", r"blog\."),
    ("mobile", r"m\."),
    ("stores", r".*cheap"),
    ("nets", r".*example\.net"),
    ("orgs", r"th\w*\.example\.org"),
)


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def _attributes() -> list[str]:
    return list(K.LEDGER_KEY)


def _numbers() -> list[str]:
    return [f"{kind}_{part}" for kind in K.KINDS for part in ("pass", "fail", "status")]


# --- sources -------------------------------------------------------------------------


@query
def file_scan(spark: SparkSession, d: str) -> DataFrame:
    """Documents as a tree of text files, one each, found by path and read as bytes."""
    root = scratch_dir(spark, "documents")
    docs = S.table(spark, d, "documents").select("lang", "source", "doc_id", "text")
    docs = docs.withColumn("text", F.regexp_replace("text", r"\n\z", ""))
    folders = ["lang", "source", "doc_id"]
    docs = docs.repartition(file_tasks(spark), *folders)
    docs.write.options(**TASKS_MOVE_FILES).partitionBy(*folders).text(root)
    files = scan_tree(spark, root, ["/source=src", "doc_id="], ["/lang=de/", "/source=src3/"])
    content = text.utf8_text(F.col("content"))
    return files.select(
        F.regexp_extract("path", r"doc_id=(\d+)/", 1).cast("bigint").alias("doc_id"),
        F.size(text.split_lines(content)).cast("bigint").alias("n_lines"),
        F.md5(F.regexp_replace(content, r"\n\z", "").cast("binary")).alias("digest"),
        text.valid_utf8(F.col("content")).alias("valid"),
    )


@query
def tree_reports(spark: SparkSession, d: str) -> DataFrame:
    """Reports found in a tree of files, read as ISO-8859-1 and parsed, in path order."""
    files = scan_tree(spark, S.tree(spark, d), [K.REPORT_FILE], K.REPORT_IGNORE)
    found = in_path_order(reports_of(files))
    parsed = parsing.parse_reports(found)
    return parsed.select(
        F.regexp_extract("path", r"/dir=r(\d+)-", 1).cast("bigint").alias("seq"),
        *_attributes(),
        *_numbers(),
        F.coalesce("reject_reason", F.lit("whole")).alias("reject_reason"),
    )


def _tree_logs(logs: DataFrame) -> DataFrame:
    return logs.select(
        F.regexp_extract("path", r"/dir=r(\d+)-", 1).cast("bigint").alias("seq"),
        *[c.alias(n) for n, c in paths.path_attributes(F.col("path"), None, True).items()],
        "build_passed",
        "netcdf_c",
        "netcdf_f",
    )


@query
def tree_logs(spark: SparkSession, d: str) -> DataFrame:
    """Build logs found in a tree of files, each read whole; other suffixes are left out."""
    files = scan_tree(spark, S.tree(spark, d), [K.LOG_FILE], K.LOG_IGNORE, glob="*.log")
    return _tree_logs(parsing.parse_logs(logs_of(files)))


@query
def tree_logs_by_line(spark: SparkSession, d: str) -> DataFrame:
    """The same logs, read line by line."""
    return _tree_logs(fold_logs(log_lines(spark, S.tree(spark, d))))


@query
def tree_run(spark: SparkSession, d: str) -> DataFrame:
    """All jobs of a run over a tree of files, logs read line by line."""
    root = S.tree(spark, d)
    branches = spark.createDataFrame([(b, i) for i, b in enumerate(S.BRANCHES)], "branch string, branch_pos int")
    tokens = F.explode(F.array(*[F.lit(t) for t in S.TREE_VERSIONS]))
    requests = history.job_grid(branches, S.TREE_HOSTS).withColumns({"hash_rank": F.lit(1), "branch_hash": tokens})
    latest = spark.createDataFrame([], "machine string, path string, artifacts_hash string, modified string")
    listed = list_tree(spark, root)
    results, _ = plan.summarize(
        reports_of(scan_tree(spark, root, [K.REPORT_FILE], K.REPORT_IGNORE, listed=listed)),
        log_lines(spark, root, listed), requests, latest,
        strip_token=None, key_value=True,
    )
    return results.select(
        "machine", "job_branch", F.regexp_extract("source_path", r"/dir=r(\d+)-", 1).cast("bigint").alias("seq"),
        "host", "branch_hash", "unit_pass", "build_passed", "netcdf_c", "netcdf_f",
    )


@query
def path_filter(spark: SparkSession, d: str) -> DataFrame:
    pages = S.table(spark, d, "pages").select("page_id", "url")
    return pages.where(
        text.path_selected(F.col("url"), ["://", ".example."], ["page=", "cheap"])
    )


@query
def ref_listing(spark: SparkSession, d: str) -> DataFrame:
    """Heads listing with a blank line after each entry, rendered from customers."""
    customer = S.table(spark, d, "customer")
    entry = F.concat(
        F.md5("c_name"), F.lit("\trefs/heads/"), F.lower("c_mktsegment"), F.lit("/"), "c_name"
    )
    listing = customer.select(
        F.col("c_custkey").alias("pos"), F.explode(F.array(entry, F.lit(""))).alias("line")
    )
    return C.listed_branches(listing).withColumn(
        "folder", versions.sanitize_branch(F.col("branch"))
    )


@query
def config_explode(spark: SparkSession, d: str) -> DataFrame:
    """Machine configuration written as JSON, one document per supplier."""
    supplier = S.table(spark, d, "supplier")
    machine = F.struct(
        F.col("s_name").alias("machine_name"),
        F.concat(F.lower("s_name"), F.lit("*")).alias("hostname_pattern"),
        F.array(
            F.concat(F.lit("/scratch/"), "s_suppkey"), F.concat(F.lit("/home/"), "s_nationkey")
        ).alias("update_paths"),
    )
    root = scratch_dir(spark, "config")
    supplier.select(F.to_json(F.struct(F.array(machine).alias("machines"))).alias("v")).write.text(
        root
    )
    return cfg.read_config(spark, root, multi_line=False).select(
        F.col("machine_pos").cast("bigint").alias("machine_pos"),
        "machine_name",
        "hostname_pattern",
        F.col("path_pos").cast("bigint").alias("path_pos"),
        "update_path",
    )


# --- matching ------------------------------------------------------------------------


@query
def line_match(spark: SparkSession, d: str) -> DataFrame:
    docs = S.table(spark, d, "documents").select("doc_id", "text")
    found = matching.lines_matching(docs, "text", "The|E.u|Ist? [a-m]")
    return found.withColumn("line_no", F.col("line_no").cast("bigint"))


def _versions(spark: SparkSession, d: str) -> DataFrame:
    return S.cells(spark, d).select(F.col("hash").alias("branch_hash")).distinct()


@query
def hash_match_rules(spark: SparkSession, d: str) -> DataFrame:
    """Versions as they are, and as general regular expressions."""
    files = S.reports(spark, d).select("path", "match_text")
    token = F.col("branch_hash")
    forms = [
        token,
        F.replace(token, F.lit("v8"), F.lit("v+8")),
        F.replace(token, F.lit("60a38e"), F.lit("[6].+")),
        F.replace(token, F.lit("5-g60a38e"), F.lit("(5|6)-g6")),
    ]
    tokens = _versions(spark, d).select(F.explode(F.array(*forms)).alias("branch_hash")).distinct()
    return matching.match_texts(files, tokens)


@query
def hash_match_literal(spark: SparkSession, d: str) -> DataFrame:
    files = S.reports(spark, d).select("path", "match_text")
    return matching.match_texts(files, _versions(spark, d), literal=True)


@query
def path_job_match(spark: SparkSession, d: str) -> DataFrame:
    paths_ = S.reports(spark, d).select("path").distinct()
    jobs = history.job_grid(S.branches(spark, d), S.RUN_MACHINES)
    return matching.paths_of_jobs(paths_, jobs).select("path", "machine", "branch")


@query
def contains_mark(spark: SparkSession, d: str) -> DataFrame:
    files = S.reports(spark, d).select("path", "text")
    return matching.containing_mark(files, _versions(spark, d), K.HASH_MARK).select(
        "path", "branch_hash"
    )


# --- parsing -------------------------------------------------------------------------


@query
def parse_header(spark: SparkSession, d: str) -> DataFrame:
    return parsing.parse_reports(S.reports(spark, d)).select("seq", *_attributes())


@query
def parse_results(spark: SparkSession, d: str) -> DataFrame:
    return parsing.parse_reports(S.reports(spark, d)).select("seq", *_numbers())


@query
def parse_rejects(spark: SparkSession, d: str) -> DataFrame:
    parsed = parsing.parse_reports(S.damaged_reports(spark, d))
    return parsed.select("seq", F.coalesce("reject_reason", F.lit("whole")).alias("reject_reason"))


@query
def build_attrs(spark: SparkSession, d: str) -> DataFrame:
    parsed = parsing.parse_logs(S.logs(spark, d))
    return parsed.select("seq", "build_passed", "netcdf_c", "netcdf_f")


@query
def build_tail_success(spark: SparkSession, d: str) -> DataFrame:
    return S.logs(spark, d).select(
        "seq", parsing.tail_build_passed(F.col("text")).alias("tail_passed")
    )


@query
def path_attrs(spark: SparkSession, d: str) -> DataFrame:
    rows = S.reports(spark, d)
    return rows.select(
        "seq", *[c.alias(n) for n, c in paths.path_attributes(F.col("path")).items()]
    )


@query
def hash_token(spark: SparkSession, d: str) -> DataFrame:
    rows = S.commits(spark, d)
    token = versions.hash_token(F.col("message"))
    return rows.select(
        "commit_hash",
        token.alias("token"),
        versions.commit_prefix(token).alias("prefix"),
        versions.is_tagged(token).alias("tagged"),
        versions.message_hash(F.col("message")).alias("word"),
    )


@query
def branch_from_log(spark: SparkSession, d: str) -> DataFrame:
    found = history.log_branches(S.commits(spark, d))
    return found.select("branch", F.col("first_at.pos").alias("first_pos"))


# --- history -------------------------------------------------------------------------


@query
def ordered_unique(spark: SparkSession, d: str) -> DataFrame:
    events = S.table(spark, d, "events")
    first = history.ordered_distinct(events, "event_type", "event_id", ["user_id"])
    return first.withColumnRenamed("first_at", "first_event")


def _event_jobs(spark: SparkSession, d: str) -> DataFrame:
    """Every machine with every branch of the log; longer names ask for more versions."""
    found = history.with_branch_pos(history.log_branches(S.commits(spark, d)))
    jobs = history.job_grid(found, EVENT_MACHINES)
    return jobs.withColumn("qty", F.length("branch") - 4)


def _ranked(hashes: DataFrame) -> DataFrame:
    return hashes.select(
        "machine", "branch", "branch_hash", F.col("hash_rank").cast("bigint").alias("hash_rank")
    )


@query
def recent_n_unique(spark: SparkSession, d: str) -> DataFrame:
    return _ranked(history.recent_hashes(S.commits(spark, d), _event_jobs(spark, d)))


@query
def recent_n_exact(spark: SparkSession, d: str) -> DataFrame:
    return _ranked(history.recent_hashes(S.commits(spark, d), _event_jobs(spark, d), exact=True))


@query
def job_grid(spark: SparkSession, d: str) -> DataFrame:
    langs = S.table(spark, d, "documents").select(F.col("lang").alias("branch")).distinct()
    grid = history.job_grid(langs.withColumn("branch_pos", F.col("branch")), K.MACHINES, 2)
    return grid.select(
        F.col("machine_pos").cast("bigint").alias("machine_pos"),
        "machine",
        "branch",
        F.col("qty").cast("bigint").alias("qty"),
    )


def _run_jobs(spark: SparkSession, d: str) -> DataFrame:
    return history.job_grid(S.branches(spark, d), S.RUN_MACHINES, QTY)


def _run_hashes(spark: SparkSession, d: str) -> DataFrame:
    return history.recent_hashes(S.report_commits(spark, d), _run_jobs(spark, d), QTY)


@query
def job_hashes(spark: SparkSession, d: str) -> DataFrame:
    return _ranked(_run_hashes(spark, d))


@query
def missing_jobs(spark: SparkSession, d: str) -> DataFrame:
    jobs = _run_jobs(spark, d)
    missing = history.jobs_without(jobs, _run_hashes(spark, d), ["machine", "branch"])
    return missing.select("machine", "branch")


# --- lookups -------------------------------------------------------------------------


@query
def build_map(spark: SparkSession, d: str) -> DataFrame:
    return lookup.build_map(parsing.parse_logs(S.logs(spark, d)))


@query
def lookup_default(spark: SparkSession, d: str) -> DataFrame:
    records = parsing.parse_reports(S.reports(spark, d)).select("seq", *_attributes())
    builds = lookup.build_map(parsing.parse_logs(S.logs(spark, d)))
    return lookup.with_build_outcome(records, builds).select(
        "seq", "build_passed", "netcdf_c", "netcdf_f"
    )


@query
def lookup_missing_attribute(spark: SparkSession, d: str) -> DataFrame:
    """Reports without an mpi version meet the logs kept under ``none``."""
    cells = S.cells(spark, d)
    unnamed = F.col("mpi") == "mpiuni"
    records = cells.select("seq", *_attributes()).withColumn("m_version", F.when(~unnamed, F.col("m_version")))
    named = F.when(unnamed, F.replace("path", F.concat(F.lit("/"), "m_version", F.lit("/")), F.lit("/None/")))
    logs = S.logs(spark, d, "mpi", "m_version")
    logs = logs.withColumn("path", F.coalesce(named, "path"))
    builds = lookup.build_map(parsing.parse_logs(logs))
    return lookup.with_build_outcome(records, builds).select(
        "seq", "build_passed", "netcdf_c", "netcdf_f"
    )


@query
def latest_commit_per_file(spark: SparkSession, d: str) -> DataFrame:
    """Places rise from machine to machine, against the order of time between machines."""
    contrary = F.col("pos") + F.length("machine") * 1_000_003
    commits = S.commits(spark, d).withColumn("pos", contrary)
    latest = lookup.latest_commits(commits.select("commit_hash", "path"), commits)
    epoch = F.unix_seconds(lookup.modified_time(F.col("modified")))
    return latest.withColumn("epoch", epoch)


@query
def regex_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Hosts of pages by the patterns of a configuration written as JSON."""
    machine = F.struct(
        F.col("name").alias("machine_name"),
        F.col("pattern").alias("hostname_pattern"),
        F.array().cast("array<string>").alias("update_paths"),
    )
    rules = [(i, *rule) for i, rule in enumerate(HOST_PATTERNS)]
    rules = spark.createDataFrame(rules, "at int, name string, pattern string").select("at", machine.alias("m"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("at", "m"))), lambda r: r["m"])
    root = scratch_dir(spark, "config")
    rules.agg(F.to_json(F.struct(listed.alias("machines")))).write.text(root)
    patterns = cfg.machine_patterns(cfg.read_config(spark, root))
    host = F.regexp_extract("url", "https?://([^/]+)", 1)
    pages = S.table(spark, d, "pages").select("page_id", host.alias("host"))
    found = lookup.first_matching(
        pages, patterns, "host", "machine_name", "hostname_pattern", "machine_pos"
    )
    return found.withColumnRenamed("machine_name", "machine")


# --- ledger --------------------------------------------------------------------------


def _latest(spark: SparkSession, d: str) -> DataFrame:
    commits = S.report_commits(spark, d)
    return lookup.latest_commits(commits.select("commit_hash", "path"), commits)


def _ledger_rows(spark: SparkSession, d: str, latest: DataFrame | None = None) -> DataFrame:
    """One ledger row per report, all of one job, arriving in order of ``seq``."""
    token = F.regexp_extract("text", r"git hash = (\S+)", 1)
    machine = {"branch_hash": token, "machine": F.lower("host")}
    records = parsing.parse_reports(S.reports(spark, d)).withColumns(machine)
    # Read back, it has a known size, and no test on its keys is carried down to the logs.
    builds = stage(lookup.build_map(parsing.parse_logs(S.logs(spark, d))), "builds")
    rows = lookup.with_build_outcome(records.drop("text", "match_text"), builds)
    rows = lookup.with_latest_commit(rows, _latest(spark, d) if latest is None else latest)
    return rows.withColumns(
        {
            "source_path": F.col("path"),
            "hash_rank": F.lit(1),
            "job_branch": F.col("branch"),
            "machine_pos": F.lit(0),
            "branch_pos": F.lit(0),
        }
    ).withColumn(merge.ARRIVAL, merge.arrival_seq(0))


def _stored_ledger(
    spark: SparkSession, d: str, keep_history: bool = False, latest: DataFrame | None = None
) -> Ledger:
    ledger = Ledger(spark, scratch_dir(spark, "ledger"), keep_history)
    ledger.merge(_ledger_rows(spark, d, latest).select(*plan.LEDGER_COLUMNS), 0)
    return ledger


def _archive(df: DataFrame) -> DataFrame:
    return formatting.archive_rows(df).withColumn("build", F.col("build").cast("bigint"))


def _flat(df: DataFrame) -> DataFrame:
    return df.select(*formatting.RECORD_COLUMNS)


@query
def upsert_last_wins(spark: SparkSession, d: str) -> DataFrame:
    return _flat(merge.latest_per_key(_ledger_rows(spark, d)))


@query
def upsert_lineitem(spark: SparkSession, d: str) -> DataFrame:
    """Line items shipped in the last flag replace the stored ones with their key."""
    items = S.table(spark, d, "lineitem")
    keys = ["l_orderkey", "l_linenumber"]
    order = ["l_shipdate", "l_extendedprice", "l_partkey", "l_suppkey", "l_quantity", "l_tax"]
    order += ["l_discount", "l_returnflag", "l_linestatus"]
    stored = merge.latest_per_key(items.where("l_returnflag <> 'R'"), keys, order)
    merged = merge.upsert(stored, items.where("l_returnflag = 'R'"), keys, order)
    return merged.withColumn("l_shipdate", F.col("l_shipdate").cast("date"))


@query
def upsert_history(spark: SparkSession, d: str) -> DataFrame:
    return _flat(_stored_ledger(spark, d, keep_history=True).read())


@query
def ledger_all(spark: SparkSession, d: str) -> DataFrame:
    ledger = _stored_ledger(spark, d)
    return _flat(plan.listing(ledger.snapshot(scratch_dir(spark, "snapshot"))))


@query
def ledger_by_hash(spark: SparkSession, d: str) -> DataFrame:
    return _archive(_stored_ledger(spark, d).by_hash("v8.5.0"))


@query
def hashes_of_branch(spark: SparkSession, d: str) -> DataFrame:
    return _stored_ledger(spark, d).hashes_of_branch("develop")


@query
def ledger_counts(spark: SparkSession, d: str) -> DataFrame:
    return run_counts(_stored_ledger(spark, d).read(), ["branch", "host"])


@query
def incremental_equals_batch(spark: SparkSession, d: str) -> DataFrame:
    """Reports of finished, open and pending orders arrive one after the other."""
    source = scratch_dir(spark, "incoming")
    offsets = scratch_dir(spark, "offsets")
    ledger = Ledger(spark, scratch_dir(spark, "ledger"))
    status = S.cells(spark, d).select("seq", "status")
    rows = stage(_ledger_rows(spark, d).select("seq", *plan.LEDGER_COLUMNS), "rows")
    rows = rows.join(status, "seq").drop("seq")

    def with_run(batch: DataFrame, batch_id: int) -> DataFrame:
        run = F.lit(batch_id).cast("bigint")
        return batch.withColumn(merge.ARRIVAL, F.col(merge.ARRIVAL).withField("run_id", run))

    for (arrived,) in status.select("status").distinct().orderBy("status").collect():
        rows.where(F.col("status") == arrived).drop("status").write.mode("append").parquet(source)
        stream = stream_packed(spark, source, rows.drop("status").schema)
        ingest(stream, with_run, ledger, offsets)
    return _flat(ledger.read())


# --- reports -------------------------------------------------------------------------


def _report_ledger(spark: SparkSession, d: str) -> DataFrame:
    ledger = _stored_ledger(spark, d, keep_history=True)
    return ledger.snapshot(scratch_dir(spark, "snapshot"))


@query
def report_rows(spark: SparkSession, d: str) -> DataFrame:
    return formatting.report_rows(_ledger_rows(spark, d), S.BASE_URL, ("branch_hash",))


@query
def archive_rows(spark: SparkSession, d: str) -> DataFrame:
    return _archive(_ledger_rows(spark, d))


@query
def report_locations(spark: SparkSession, d: str) -> DataFrame:
    rows = _ledger_rows(spark, d)
    return rows.select(
        formatting.output_location("out", F.col("branch"), F.col("branch_hash")).alias("location"),
        formatting.older_artifact_link(S.BASE_URL).alias("link"),
    ).distinct()


@query
def concat_sort_rank(spark: SparkSession, d: str) -> DataFrame:
    """Places of every configuration in report order and in the order of run-together keys."""
    order = list(K.REPORT_ORDER)
    configs = S.cells(spark, d).select(*order).distinct()
    configs = configs.withColumn("joined", formatting.concatenated_order_key())
    by_columns = ordering.ordered_positions(configs, [], order, "column_place")
    return ordering.ordered_positions(by_columns, [], ["joined", *order], "joined_place")


@query
def markdown_lines(spark: SparkSession, d: str) -> DataFrame:
    rows = R.numbered_rows(_report_ledger(spark, d), S.BASE_URL)
    return R.markdown_lines(rows)


@query
def csv_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    rows = R.numbered_rows(_report_ledger(spark, d), S.BASE_URL)
    root = scratch_dir(spark, "csv")
    named = rows.withColumnRenamed("branch_hash", "report_hash")
    R.write_csv(
        named.select("report_hash", "position", *K.REPORT_COLUMNS), ["report_hash"], root
    )
    return _csv_back(spark, root, ["report_hash"])


def _csv_back(spark: SparkSession, root: str, folders: list[str]) -> DataFrame:
    """Rows of CSV reports read from their files, parts joined, one heading each."""
    schema = ", ".join(f"{c} string" for c in ("value", *folders))
    lines = spark.read.schema(schema).text(root)
    lines = lines.withColumn("value", F.decode(F.col("value").cast("binary"), K.REPORT_ENCODING))
    heading = ",".join(K.REPORT_COLUMNS)
    columns = ", ".join(f"{c} string" for c in K.REPORT_COLUMNS)
    body = lines.where(F.col("value") != heading)
    row = F.from_csv("value", F.lit(columns), {"escape": '"'}).alias("row")
    headings = lines.where(F.col("value") == heading).groupBy(*folders).agg(F.count("*").alias("n"))
    once = headings.where("n = 1").drop("n")
    return body.select(*folders, row).join(once, folders, "left_semi").select("row.*", *folders)


@query
def aligned_report(spark: SparkSession, d: str) -> DataFrame:
    reports = S.reports(spark, d)
    parts = F.split("path", "/")
    flat = F.concat(
        F.lit("/"),
        F.array_join(F.slice(parts, 3, 7), "/"),
        F.lit("-"),
        F.element_at(parts, -2),
        F.lit("/Summary.dat"),
    )
    reports = reports.select(flat.alias("path"), "text")
    return text_report(reports, S.report_commits(spark, d), "develop")


# --- whole runs ----------------------------------------------------------------------


def _run_inputs(spark: SparkSession, d: str, latest: DataFrame | None = None):
    latest = _latest(spark, d) if latest is None else latest
    return S.reports(spark, d), S.logs(spark, d), _run_hashes(spark, d), latest


def _full_run(spark: SparkSession, d: str, latest: DataFrame | None = None) -> plan.Run:
    ledger = Ledger(spark, scratch_dir(spark, "ledger"))
    return plan.run(*_run_inputs(spark, d, latest), ledger, S.BASE_URL)


@query
def run_results(spark: SparkSession, d: str) -> DataFrame:
    results, _ = plan.summarize(*_run_inputs(spark, d))
    return results.select("machine", "job_branch", "source_path", *formatting.RECORD_COLUMNS)


@query
def full_run(spark: SparkSession, d: str) -> DataFrame:
    return _flat(_full_run(spark, d).ledger.read())


@query
def run_missing(spark: SparkSession, d: str) -> DataFrame:
    return _full_run(spark, d).missing.select("machine", "job_branch", "branch_hash")


@query
def latest_pointer(spark: SparkSession, d: str) -> DataFrame:
    return R.latest_targets(_full_run(spark, d).results).select("branch_dir", "branch_hash")


@query
def report_targets(spark: SparkSession, d: str) -> DataFrame:
    return R.report_targets(_full_run(spark, d).results).drop("at")


@query
def reports_as_written(spark: SparkSession, d: str) -> DataFrame:
    """Rows of every report and latest report, with the run merged over an older ledger."""
    latest = stage(_latest(spark, d), "latest")
    older = _stored_ledger(spark, d, latest=latest).read()
    results = _full_run(spark, d, latest).results
    versions = stage(R.row_versions(results, older, K.LEDGER_KEY), "versions")
    shown = R.report_contents(versions, R.report_targets(results)).withColumn("kind", F.lit("each"))
    latest = R.report_contents(versions, R.latest_targets(results))
    both = shown.unionByName(latest.withColumn("kind", F.lit("latest")))
    return both.select("kind", "report_branch", "report_hash", *formatting.RECORD_COLUMNS)


@query
def two_runs_ledger(spark: SparkSession, d: str) -> DataFrame:
    """Two runs over different machines that overlap: both start before either is merged."""
    reports, logs, hashes, latest = _run_inputs(spark, d)
    ledger = Ledger(spark, scratch_dir(spark, "ledger"), keep_history=True)
    hashes, latest = stage(hashes, "hashes"), stage(latest, "latest")
    started = [ledger.claim() for _ in range(2)]
    for run_id, half in zip(started, ("machine < 'gb'", "machine >= 'gb'"), strict=True):
        plan.run(reports, logs, hashes.where(half), latest, ledger, S.BASE_URL, run_id=run_id)
    return _flat(ledger.read())


@query
def two_runs_reports(spark: SparkSession, d: str) -> DataFrame:
    """CSV rows read from the files that two runs of different branches left in one folder."""
    reports, logs, hashes, latest = _run_inputs(spark, d)
    ledger = Ledger(spark, scratch_dir(spark, "ledger"))
    target = scratch_dir(spark, "reports")
    hashes, latest = stage(hashes, "hashes"), stage(latest, "latest")
    for half in ("branch = 'develop'", "branch <> 'develop'"):
        plan.run(reports, logs, hashes.where(half), latest, ledger, S.BASE_URL, target)
    return _csv_back(spark, f"{target}/csv", ["report_branch", "report_hash"])
