import csv
import glob
import io
import os

import pytest
from pyspark.sql import functions as F

from runledger import constants as K
from runledger.functions.parsing import parse_reports
from runledger.operators import merge
from runledger.plans import summarize as plan
from runledger.session import scratch_dir
from runledger.sinks import reports as R
from runledger.sinks.ledger import Ledger, run_counts
from runledger.sources.files import log_tree, report_tree
from runledger.sources.lines import log_lines
from runledger.streaming.ingest import ingest, stream_packed, stream_tree

SCHEMA = "k string, branch_hash string, v int, s int"


def small_ledger(spark, **options):
    options = {"keys": ["k"], "cluster": ["branch_hash", "k"], "order": ["s"], **options}
    return Ledger(spark, scratch_dir(spark, "ledger"), **options)


def rows(ledger):
    return {(r.k, r.branch_hash, r.v) for r in ledger.read().collect()}


def frame(spark, *values):
    return spark.createDataFrame(list(values), SCHEMA)


def test_merge_replaces_and_adds(spark):
    ledger = small_ledger(spark)
    assert not ledger.exists() and ledger.runs() == 0
    with pytest.raises(ValueError):
        ledger.read()
    ledger.merge(frame(spark, ("a", "h1", 1, 1), ("b", "h1", 1, 1)), 0)
    newer = frame(spark, ("a", "h2", 3, 2), ("a", "h2", 2, 1), ("c", "h2", 1, 1))
    ledger.merge(newer, 1)
    expected = {("a", "h2", 3), ("b", "h1", 1), ("c", "h2", 1)}
    assert rows(ledger) == expected
    ledger.merge(newer, 1)
    assert rows(ledger) == expected and ledger.runs() == 2
    before = ledger.read()
    ledger.merge(frame(spark, ("b", "h3", 9, 1)), 2)
    assert rows(ledger) == {("a", "h2", 3), ("b", "h3", 9), ("c", "h2", 1)}
    # A reader of the earlier state is not disturbed by what came after.
    assert {(r.k, r.branch_hash, r.v) for r in before.collect()} == expected
    reopened = Ledger(spark, ledger.root, keys=["k"])
    assert rows(reopened) == rows(ledger)
    assert {r.k for r in ledger.by_hash("h2").collect()} == {"a", "c"}
    # Replaced by another version, so no longer found under the old one.
    assert ledger.by_hash("h1").count() == 0


def test_empty_merge(spark):
    ledger = small_ledger(spark)
    ledger.merge(frame(spark), 0)
    assert rows(ledger) == set() and ledger.runs() == 1
    ledger.merge(frame(spark, ("a", "h", 1, 1)), 1)
    assert rows(ledger) == {("a", "h", 1)}
    # A run repeated without rows takes back what it stored.
    ledger.merge(frame(spark), 1)
    assert rows(ledger) == set()


def test_runs_without_number_are_all_kept(spark):
    ledger = small_ledger(spark)
    first = ledger.merge(frame(spark, ("a", "h", 1, 1), ("b", "h", 1, 1)))
    second = ledger.merge(frame(spark, ("c", "h", 1, 1)))
    assert (first, second) == (0, 1) and {r[0] for r in rows(ledger)} == {"a", "b", "c"}
    assert ledger.claim() == 2 and Ledger(spark, ledger.root, keys=["k"]).claim() == 3


def test_overlapping_runs_keep_their_rows(spark):
    one = small_ledger(spark)
    other = Ledger(spark, one.root, keys=["k"], cluster=["branch_hash", "k"], order=["s"])
    ids = [one.claim(), other.claim()]
    assert ids == [0, 1]
    # The run that started later is merged first, and still wins.
    other.merge(frame(spark, ("k", "h", 2, 1), ("b", "h", 2, 1)), ids[1])
    one.merge(frame(spark, ("k", "h", 1, 1), ("a", "h", 1, 1)), ids[0])
    assert rows(one) == {("k", "h", 2), ("a", "h", 1), ("b", "h", 2)}


def test_claims_at_the_same_time_differ(spark):
    from concurrent.futures import ThreadPoolExecutor

    ledger = small_ledger(spark)
    with ThreadPoolExecutor(4) as pool:
        ids = list(pool.map(lambda _: ledger.claim("a.b/c 1"), range(8)))
    assert len(set(ids)) == 8 and set(ids) == {n for _, n in ledger._places()}
    assert {s for s, _ in ledger._places()} == {"a.b/c 1"}


def test_old_run_repeated_late_stays_old(spark):
    ledger = small_ledger(spark)
    ledger.merge(frame(spark, ("k", "h", 1, 1)), 0)
    ledger.merge(frame(spark, ("k", "h", 2, 1)), 1)
    copy = ledger.snapshot(scratch_dir(spark, "snapshot"))
    ledger.merge(frame(spark, ("k", "h", 7, 1), ("n", "h", 7, 1)), 0)
    assert rows(ledger) == {("k", "h", 2), ("n", "h", 7)} and ledger.runs() == 2
    assert [r.v for r in copy.collect()] == [2]


def test_sources_interleave_by_arrival(spark):
    ledger, model = small_ledger(spark), {}
    steps = [("x", 0), ("x", 1), ("y", 0), ("x", 2), ("y", 1), ("x", 3), ("2022-01-01", 0)]
    for v, (source, run_id) in enumerate(steps):
        key = f"k{v % 3}"
        ledger.merge(frame(spark, (key, "h", v, 1), (source, "h", v, 1)), run_id, source)
        model |= {key: v, source: v}
    assert {(r[0], r[2]) for r in rows(ledger)} == set(model.items())
    # A batch of a stream that is repeated leaves what other sources wrote since.
    ledger.merge(frame(spark, ("k1", "h", 99, 1), ("x", "h", 99, 1)), 1, "x")
    assert {(r[0], r[2]) for r in rows(ledger)} == set(model.items())


def test_run_lost_before_its_commit_changes_nothing(spark):
    ledger = small_ledger(spark)
    ledger.merge(frame(spark, ("a", "h", 1, 1)), 0)
    again = frame(spark, ("a", "h", 2, 1), ("b", "h", 2, 1))
    broken = again.withColumn("v", F.when(F.col("k") == "b", F.raise_error(F.lit("lost")).cast("int")).otherwise(F.col("v")))
    with pytest.raises(Exception, match="lost"):
        ledger.merge(broken, 0)
    assert rows(ledger) == {("a", "h", 1)}
    ledger.merge(again, 0)
    assert rows(ledger) == {("a", "h", 2), ("b", "h", 2)} and ledger.runs() == 1


def test_scratch_needs_a_shared_folder_on_a_cluster():
    from runledger import session

    class Conf(dict):
        def get(self, key, default=None):
            return super().get(key, default)

    class Fake:
        conf = Conf({"spark.master": "yarn"})

    with pytest.raises(ValueError):
        session.scratch_dir(Fake, "x")
    Fake.conf["spark.checkpoint.dir"] = "hdfs://x/tmp/"
    assert session.scratch_dir(Fake, "x").startswith("hdfs://x/tmp/x-")


def test_history_key():
    assert merge.history_key()[-1] == "branch_hash"
    assert merge.history_key()[:-1] == K.LEDGER_KEY


def _scanned(df):
    """Rows that the scans of an executed plan gave, after row groups were left out."""
    total = 0
    nodes = [df._jdf.queryExecution().executedPlan()]
    while nodes:
        node = nodes.pop()
        if node.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            nodes.append(node.executedPlan())
        elif node.getClass().getSimpleName().endswith("QueryStageExec"):
            nodes.append(node.plan())
        elif node.getClass().getSimpleName() == "FileSourceScanExec":
            total += node.metrics().apply("numOutputRows").value()
        children = node.children()
        nodes += [children.apply(i) for i in range(children.size())]
    return total


def test_version_lookup_skips_row_groups(spark):
    ledger = small_ledger(spark, keys=["k", "branch_hash"])
    many = spark.range(40_000).selectExpr(
        "string(id) AS k", "concat('h', lpad(string(id % 400), 4, '0')) AS branch_hash", "int(id) AS v", "1 AS s"
    )
    ledger.merge(many, 0)
    found = ledger.by_hash("h0007").select("v")
    assert found.count() == 100
    found.collect()
    assert 100 <= _scanned(found) <= 20_000
    # Within the range of a row group, but in none of them: the Bloom filter or dictionary says so.
    unknown = ledger.by_hash("h0007x")
    assert unknown.collect() == [] and _scanned(unknown) == 0
    plan_ = found._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(branch_hash,h0007)" in plan_
    copy = ledger.snapshot(scratch_dir(spark, "snapshot")).where("branch_hash = 'h0399'")
    assert len(copy.collect()) == 100 and _scanned(copy) <= 20_000


def test_streamed_batches_equal_one_batch(spark, tmp_path):
    ledger = small_ledger(spark)
    source, offsets = str(tmp_path / "in"), str(tmp_path / "offsets")
    parts = [
        [("a", "h", 1, 1), ("b", "h", 1, 2)],
        [("a", "h", 2, 3)],
        [("b", "h", 5, 4), ("b", "h", 4, 3), ("c", "h", 1, 1)],
    ]
    for part in parts:
        df = spark.createDataFrame(part, SCHEMA)
        df.write.mode("append").parquet(source)
        ingest(stream_packed(spark, source, df.schema), lambda b, i: b, ledger, offsets)
    state = rows(ledger)
    ingest(stream_packed(spark, source, df.schema), lambda b, i: b, ledger, offsets)
    everything = spark.createDataFrame([r for p in parts for r in p], SCHEMA)
    once = merge.latest_per_key(everything, ["k"], ["s"])
    assert rows(ledger) == state == {(r.k, r.branch_hash, r.v) for r in once.collect()}


RESULT = "{k} test results\tPASS {p}\tFAIL 0\n"


def write_report(root, branch, host, compiler, folder, token, passed, log=True, kinds=tuple(K.KINDS)):
    leaf = root / branch / host / compiler / "18" / "g" / "mpi" / "1" / folder
    leaf.mkdir(parents=True)
    text = f"Build for = {compiler}_18_mpi_g_{branch}, mpi version 1 on {host} {K.OS_MARK}: Linux\n"
    text += "".join(RESULT.format(k=k, p=passed) for k in kinds) + f"---\n{token}\n"
    (leaf / "summary.dat").write_text(text)
    if log:
        done = f"{token}\nNetCDF library version: 4.7.2\n{K.SUCCESS_MESSAGE}\n"
        (leaf / "build.log").write_text(done)
    return "/" + str((leaf / "summary.dat").relative_to(root))


@pytest.fixture(scope="module")
def world(spark, tmp_path_factory):
    """A small tree, its log and a run with two versions per job."""
    root = tmp_path_factory.mktemp("world")
    paths = [
        write_report(root, "develop", "hera", "intel", "a", "v8.1.0b2-5-gaaaa99", 2),
        write_report(root, "develop", "hera", "intel", "b", "v8.1.0b1-5-gbbbb", 1),
        write_report(root, "develop", "hera", "nag", "a", "v8.1.0b2-5-gaaaa", 22, log=False),
        write_report(root, "develop", "jet", "intel", "a", "v8.1.0b2-5-gaaaa", 3),
        write_report(root, "feat", "jet", "intel", "a", "v8.1.0b2-5-gaaaa", 4),
        write_report(root, "feat", "jet", "nag", "a", "v8.1.0b2-5-gaaaa", 4, kinds=("unit",)),
        write_report(root, "feat", "jet", "pgi", "a", "v7.0.0", 4),
    ]
    log = []
    for machine in ("hera", "jet"):
        for branch in ("develop", "feat"):
            for pos, token in enumerate(["v8.1.0b2-5-gaaaa", "v8.1.0b1-5-gbbbb", "v8.0.0"]):
                text = f"update for test of intel_18_mpi_g_{branch} with hash {token} on {machine}"
                log.append((machine, pos, text))
    commits = spark.createDataFrame(log, "machine string, pos int, message string")
    latest = spark.createDataFrame(
        [(m, p, f"c{i}", f"2022-01-0{i + 1} 10:00:00 +0000")
         for i, p in enumerate(paths) for m in ("hera", "jet")],
        "machine string, path string, artifacts_hash string, modified string",
    )
    branches = spark.createDataFrame([("develop", 0), ("feat", 1)], "branch string, branch_pos int")
    from runledger.operators.history import job_grid, recent_hashes

    hashes = recent_hashes(commits, job_grid(branches, ["hera", "jet"], 2), 2)
    return str(root), paths, hashes, latest


def do_run(spark, world, target=None, keep_history=False, **options):
    root, _, hashes, latest = world
    ledger = Ledger(spark, scratch_dir(spark, "ledger"), keep_history)
    return plan.run(
        report_tree(spark, root), log_tree(spark, root), hashes, latest, ledger,
        "https://example.org/x", target, **options,
    )


def test_run_over_a_tree(spark, world, tmp_path):
    target = str(tmp_path / "out")
    out = do_run(spark, world, target)
    paths = world[1]
    got = {(r.source_path, r.machine, r.job_branch, r.branch_hash) for r in out.results.collect()}
    aaaa, bbbb = "v8.1.0b2-5-gaaaa", "v8.1.0b1-5-gbbbb"
    assert got == {
        (paths[0], "hera", "develop", aaaa), (paths[1], "hera", "develop", bbbb),
        (paths[2], "hera", "develop", aaaa), (paths[3], "jet", "develop", aaaa),
        (paths[4], "jet", "feat", aaaa),
    }
    assert [(r.path, r.reject_reason) for r in out.rejects.collect()] == [(paths[5], "missing_kind")]
    missing = {(r.machine, r.job_branch, r.branch_hash) for r in out.missing.collect()}
    assert missing == {
        ("hera", "feat", aaaa), ("hera", "feat", bbbb), ("jet", "develop", bbbb), ("jet", "feat", bbbb),
    }
    # The older version is merged after the newer one and keeps the shared configuration.
    stored = {(r.branch, r.host, r.compiler): r for r in out.ledger.read().collect()}
    assert stored["develop", "hera", "intel"].branch_hash == bbbb
    assert stored["develop", "hera", "intel"].artifacts_hash == "c1"
    row = stored["develop", "hera", "nag"]
    assert (row.build_passed, row.netcdf_c) == (False, "unknown")
    assert stored["develop", "jet", "intel"].build_passed
    assert stored["develop", "jet", "intel"].netcdf_f == "N/A"
    assert out.counts == {"reports": 5, "builds_passed": 4, "without_log": 1}
    counts = {tuple(r) for r in run_counts(out.results, ["machine"]).collect()}
    assert counts == {("hera", 3, 2, 1), ("jet", 2, 2, 0)}

    # Reports show what stood when they were written.
    def report(kind, *folders):
        parts = sorted(glob.glob(os.path.join(target, kind, *folders, "*.txt")))
        return "".join(open(p).read() for p in parts).splitlines()

    newest = report("markdown", "report_branch=develop", f"report_hash={aaaa}")
    cells = [[c.strip() for c in line.strip("|").split("|")] for line in newest]
    assert cells[0][:4] == ["", "branch", "host", "compiler"]
    assert [c[2:4] + [c[9]] for c in cells[2:]] == [
        ["hera", "nag 18", "22"], ["jet", "intel 18", "3"]
    ]
    latest = report("latest", "report_branch=develop")
    assert latest == newest
    feat = report("markdown", "report_branch=feat", f"report_hash={aaaa}")
    # Every row with the version, of every branch and machine.
    assert len(feat) == 2 + 3
    old = report("markdown", "report_branch=develop", f"report_hash={bbbb}")
    assert len(old) == 2 + 1
    assert not os.path.exists(os.path.join(target, "markdown", "report_branch=develop", "report_hash=v8.0.0"))


def test_paths_are_tested_before_texts_are_parsed(spark, world, tmp_path):
    root, _, hashes, _ = world
    requests = plan.requests_of(hashes)
    mine, pairs = plan.owned_files(report_tree(spark, root), requests)
    tree = parse_reports(mine)._jdf.queryExecution().optimizedPlan().toString()
    assert tree.index("reject_reason") < tree.index("LeftSemi") < tree.index("content")
    assert {r.path for r in pairs.collect()} == {r.path for r in mine.collect()}
    too_long = spark.createDataFrame([("/big/summary.dat", 9)], "path string, length long")
    out = do_run(spark, world, oversized=too_long)
    assert ("/big/summary.dat", "oversized") in {(r.path, r.reject_reason) for r in out.rejects.collect()}


def test_logs_as_lines_give_the_same_run(spark, world):
    root, _, hashes, latest = world
    runs = [
        plan.summarize(report_tree(spark, root), logs, hashes, latest)[0]
        for logs in (log_tree(spark, root), log_lines(spark, root))
    ]
    assert sorted(map(str, runs[0].collect())) == sorted(map(str, runs[1].collect()))


def test_reports_of_a_branch_from_the_ledger(spark, world, tmp_path):
    out = do_run(spark, world, keep_history=True)
    R.write_branch_reports(out.ledger.read(), "develop", "https://example.org/x", str(tmp_path))
    found = {os.path.basename(p) for p in glob.glob(f"{tmp_path}/markdown/report_hash=*")}
    assert found == {"report_hash=v8.1.0b2-5-gaaaa", "report_hash=v8.1.0b1-5-gbbbb"}
    parts = sorted(glob.glob(f"{tmp_path}/markdown/report_hash=v8.1.0b2-5-gaaaa/*.txt"))
    assert len("".join(open(p).read() for p in parts).splitlines()) == 2 + 4


def test_older_text_report(spark, tmp_path):
    from runledger.plans.textreport import write_text_report

    text = f"Build for = x, mpi version 1 on h {K.OS_MARK}: Linux\ngit hash = v8-g1\n"
    text += "".join(RESULT.format(k=k, p=5) for k in K.KINDS)
    reports = spark.createDataFrame(
        [("/develop/Gaea/nag/7/O/mpiuni/Summary.dat", text),
         ("/develop/hera/intel/18/g/mpi/1/summary.dat", text),
         ("/develop/hera/intel/18/g/mpi/2/summary.dat", text.replace("v8-g1", "v7-g1")),
         ("/feat/hera/intel/18/g/mpi/1/summary.dat", text)],
        "path string, text string",
    )
    commits = spark.createDataFrame(
        [("hera", 1, "update for test of a_develop with hash v7-g1 on hera"),
         ("hera", 0, "update for test of a_develop with hash v8-g1 on hera"),
         ("jet", 0, "develop merged")],
        "machine string, pos int, message string",
    )
    write_text_report(reports, commits, "develop", str(tmp_path / "out"))
    assert os.listdir(tmp_path / "out").count("branch_hash=v8-g1") == 1
    parts = sorted(glob.glob(str(tmp_path / "out/branch_hash=*/*.txt")))
    lines = [line.split() for p in parts for line in open(p).read().splitlines()]
    assert [line[:6] for line in lines] == [
        ["Linux", "Gaea", "nag", "7", "mpiuni", "none"],
        ["OS", "HOST", "compilier", "version", "mpi-type", "mpi-ver"],
        ["Linux", "hera", "intel", "18", "mpi", "1"],
    ]
    assert lines[0][7:9] == ["5", "0"]
    feat = commits.withColumn("message", F.replace("message", F.lit("develop"), F.lit("feat")))
    feat = feat.withColumn("message", F.replace("message", F.lit("v8-g1"), F.lit("v7-g1")))
    more = reports.withColumn("path", F.replace("path", F.lit("/develop/"), F.lit("/feat/")))
    write_text_report(more, feat, "feat", str(tmp_path / "out"))
    assert parts == sorted(glob.glob(str(tmp_path / "out/branch_hash=v8-g1/*.txt")))
    assert glob.glob(str(tmp_path / "out/branch_hash=v7-g1/*.txt"))


def test_first_machine_report_keeps_replaced_rows(spark, world, tmp_path):
    root, _, hashes, latest = world
    target = str(tmp_path / "out")
    only_hera = hashes.where("machine = 'hera'")
    do_run(spark, (root, None, only_hera, latest), target)
    parts = glob.glob(f"{target}/latest/report_branch=develop/*.txt")
    text = "".join(open(p).read() for p in parts)
    assert "intel 18" in text and "nag 18" in text


def test_incomplete_report_can_fail_the_run(spark, world):
    with pytest.raises(Exception, match="incomplete report"):
        do_run(spark, world, on_incomplete="fail")


def test_history_keeps_every_version(spark, world):
    out = do_run(spark, world, keep_history=True)
    kept = {(r.host, r.compiler, r.branch_hash) for r in out.ledger.read().where("branch = 'develop'").collect()}
    assert ("hera", "intel", "v8.1.0b2-5-gaaaa") in kept and ("hera", "intel", "v8.1.0b1-5-gbbbb") in kept


def test_repeated_run_changes_nothing(spark, world):
    out = do_run(spark, world)
    before = sorted(map(str, out.ledger.read().collect()))
    out.ledger.merge(out.results.select(*plan.LEDGER_COLUMNS), 1)
    assert sorted(map(str, out.ledger.read().collect())) == before


def test_stream_of_a_tree(spark, world, tmp_path):
    """New report files flow into the ledger once."""
    from runledger.functions.parsing import parse_reports
    from runledger.sources.files import reports_of

    ledger = small_ledger(spark, keys=["source_path"], cluster=["source_path"], order=["source_path"])

    def to_rows(batch, _):
        parsed = parse_reports(reports_of(batch)).where("reject_reason IS NULL")
        return parsed.select(F.col("path").alias("source_path"), "branch", "unit_pass")

    for _ in range(2):
        stream = stream_tree(spark, world[0], "summary.dat")
        ingest(stream, to_rows, ledger, str(tmp_path / "offsets"))
    assert ledger.read().count() == 6 and ledger.runs() == 1


def test_markdown_layout(spark):
    df = spark.createDataFrame(
        [("h", 0, "a", "1"), ("h", 1, "longer text", "-22"), ("g", 0, "b", "fail")],
        "branch_hash string, position bigint, name string, num string",
    )
    lines = R.markdown_lines(df, ["name", "num"]).where("branch_hash = 'h'").orderBy("line_no")
    assert [r.line for r in lines.collect()] == [
        "|    | name        |   num |",
        "|----|-------------|-------|",
        "|  0 | a           |     1 |",
        "|  1 | longer text |   -22 |",
    ]
    other = R.markdown_lines(df, ["name", "num"]).where("branch_hash = 'g'").orderBy("line_no")
    assert [r.line for r in other.collect()][2] == "|  0 | b      | fail  |"


def test_csv_needs_quoting_only_where_it_must(spark, tmp_path):
    values = ["plain", "with, comma", 'with "quotes"', " blanks ", "", "café", "5 €"]
    df = spark.createDataFrame([("h", i, v, "x") for i, v in enumerate(values)],
                               "folder string, position int, a string, b string")
    R.write_csv(df, ["folder"], str(tmp_path / "csv"))
    parts = sorted(glob.glob(str(tmp_path / "csv/folder=h/part-*")))
    text = "".join(open(part, encoding="iso-8859-1", newline="").read() for part in parts)
    read = list(csv.reader(io.StringIO(text)))
    assert read[0] == ["a", "b"] and [r[0] for r in read[1:]] == [*values[:-1], "5 ?"]
    expected = io.StringIO()
    csv.writer(expected, lineterminator="\n").writerows(read)
    assert expected.getvalue() == text


def test_aligned_layout(spark):
    df = spark.createDataFrame([("h", 0, "a", "bbb"), ("h", 1, "long", "c")],
                               "branch_hash string, position bigint, x string, y string")
    lines = R.aligned_lines(df, ["x", "y"], ["branch_hash"]).orderBy("line_no").collect()
    assert [r.line for r in lines] == ["a     bbb", "long  c"]


def test_shown_values(spark):
    from runledger.functions.formatting import older_artifact_link, report_rows

    values = dict.fromkeys(K.LEDGER_KEY, "x") | {"branch": "feat/a", "host": "h", "m_version": "V1"}
    for kind in K.KINDS:
        values |= {f"{kind}_pass": -1, f"{kind}_fail": None, f"{kind}_status": "ok"}
    values |= {"unit_pass": None, "unit_status": "fail", "build_passed": None, "netcdf_c": "1",
               "netcdf_f": "N/A", "artifacts_hash": "c", "branch_hash": "t", "modified": "-1"}
    types = {k: "bigint" for k in values if k.endswith(("_pass", "_fail"))} | {"build_passed": "boolean"}
    df = spark.createDataFrame(
        [tuple(values.values())], ", ".join(f"{k} {types.get(k, 'string')}" for k in values)
    )
    row = report_rows(df, "https://example.org").first()
    assert list(row.asDict()) == list(K.REPORT_COLUMNS)
    assert (row.u_pass, row.s_pass, row.build, row.netcdf) == ("fail", "pending", "fail", "1 N/A")
    assert row.modified == "-1"
    assert row.artifacts_hash == "[artifacts](https://example.org/tree/c/feat/a/h/x/x/x/x/V1)"
    link = df.select(older_artifact_link("https://example.org")).first()[0]
    assert link == "[artifacts](https://example.org/tree/h/feat_a/h/x/x/x/x/v1)"
