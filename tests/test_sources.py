import json
import os

import pytest
from pyspark.sql import functions as F

from runledger import constants as K
from runledger.functions.parsing import parse_logs, parse_reports, tail_build_passed
from runledger.operators.matching import match_lines, match_texts
from runledger.sources import commits, config, files, lines

HEAD = f"Build for = intel_18_mpi_g_develop, mpi version 1 on hera {K.OS_MARK}: Linux\n"
RESULTS = "".join(f"{k} test results\tPASS 1\tFAIL 0\n" for k in ("unit", "system", "example", "nuopc"))


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("jet_tree")
    leaf = root / "develop/hera/intel/18/g/mpi/1/lay out"
    leaf.mkdir(parents=True)
    (leaf / "summary.dat").write_bytes((HEAD + RESULTS).encode() + b"caf\xe9\r\nv8.5.0\r\n")
    (leaf / "build.log").write_bytes(b"v8.5.0\nbad \xff\xfe byte\n" + K.SUCCESS_MESSAGE.encode())
    (leaf / ".summary.dat.swp").write_bytes(b"x")
    (leaf / "summary.dat.swp").write_bytes(b"x")
    (leaf / "module-build.log").write_bytes(b"x")
    (leaf / "build.log.txt").write_bytes(b"x")
    (leaf / "Summary.DAT").write_bytes(b"y")
    other = root / "elsewhere"
    other.mkdir()
    (other / "summary.dat").write_bytes(b"z")
    os.symlink(leaf, root / "linked")
    return str(root)


def test_reports_and_logs_of_a_tree(spark, tree):
    reports = {r.path: r for r in files.report_tree(spark, tree).collect()}
    path = "/develop/hera/intel/18/g/mpi/1/lay out/summary.dat"
    assert set(reports) == {path, "/elsewhere/summary.dat", "/linked/summary.dat"}
    assert "café" in reports[path].text
    assert "caf\r\n" in reports[path].match_text
    logs = {r.path: r for r in files.log_tree(spark, tree).collect()}
    log = "/develop/hera/intel/18/g/mpi/1/lay out/build.log"
    assert set(logs) == {log, "/linked/build.log"}
    assert not logs[log].text_valid
    assert "bad �" in logs[log].text and "bad  byte" in logs[log].match_text


def test_tree_parses(spark, tree):
    rows = parse_reports(files.report_tree(spark, tree)).where("reject_reason IS NULL")
    assert rows.count() == 2
    assert parse_logs(files.log_tree(spark, tree)).where("build_passed").count() == 2


def test_path_predicates_and_names(spark, tree):
    found = files.scan_tree(spark, tree, ["develop", "summary"], ["swp"])
    assert [r.path.rsplit("/", 1)[1] for r in found.collect()] == ["summary.dat"]
    # The folder above the root holds "jet"; it must not take part.
    assert files.scan_tree(spark, tree, ["jet"]).count() == 0
    named = files.named_files(files.scan_tree(spark, tree)).select("path").collect()
    assert len(named) == 5
    twice = found.unionByName(found)
    assert files.in_path_order(twice).count() == 1


def test_a_file_too_long_for_a_row_fails_no_run(spark, tmp_path):
    with open(tmp_path / "summary.dat", "wb") as f:
        f.truncate(3 * 1024**3)
    (tmp_path / "a").mkdir()
    (tmp_path / "a/summary.dat").write_bytes(b"short")
    root = str(tmp_path)
    assert [r.path for r in files.report_tree(spark, root).collect()] == ["/a/summary.dat"]
    files.pack(files.scan_tree(spark, root), str(tmp_path / "packed"))
    assert files.packed(spark, str(tmp_path / "packed")).count() == 1
    left = files.oversized(spark, root, ["summary"]).collect()
    assert [(r.path, r.length) for r in left] == [("/summary.dat", 3 * 1024**3)]


def test_packing_reads_contents_once(spark, tree):
    plan = files.scan_tree(spark, tree).sortWithinPartitions("path")._jdf.queryExecution()
    text = plan.executedPlan().toString()
    assert "Exchange" not in text and text.count("FileScan") == 1


@pytest.mark.parametrize("split", ["40b", "128m"])
def test_lines_equal_whole_texts(spark, tmp_path, split):
    import random

    rng = random.Random(12)
    pieces = [
        "NetCDF library version: 4.7.2", "x netcdf LIBRARY version:", "NetCDF Fortran version: netCDF 1.22.3 9.9.9",
        K.SUCCESS_MESSAGE, "café", "", "line", "v8.1.0-g1", "  v8.1.0-g12 ", "a" * 90,
    ]
    for i in range(25):
        leaf = tmp_path / f"d+{i} é"
        leaf.mkdir()
        ends = [rng.choice(["\n", "\n", "\r\n", "\r"]) for _ in range(rng.randint(0, 40))]
        text = "".join(rng.choice(pieces) + e for e in ends) + rng.choice(["", "tail"])
        (leaf / "build.log").write_bytes(text.encode() + (b"\xff\n" if i % 5 == 0 else b""))
    (tmp_path / "build.log.swp").write_bytes(b"x")
    root, before = str(tmp_path), spark.conf.get("spark.sql.files.maxPartitionBytes")
    whole = files.log_tree(spark, root).where("length(text) > 0")
    columns = ["path", "build_passed", "netcdf_c", "netcdf_f"]
    tail = tail_build_passed(F.col("text"), 7).alias("tail_passed")
    want = sorted(map(tuple, parse_logs(whole).select(*columns, tail).collect()))
    requests = spark.createDataFrame([("v8.1.0-g1",), ("v8..+g1",)], "branch_hash string")
    pairs = sorted((r.path, r.branch_hash) for r in match_texts(whole, requests).collect())
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        found = lines.log_lines(spark, root)
        got = sorted(map(tuple, lines.fold_logs(found, 7).select(*columns, "tail_passed").collect()))
        blocks = found.select("path", "block").distinct().count()
        lined = match_lines(found.select("path", F.array("line").alias("lines")), requests)
        hits = sorted((r.path, r.branch_hash) for r in lined.collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert got == want and hits == pairs and pairs
    assert (blocks > len(want)) == (split == "40b")


def test_pack_keeps_every_byte(spark, tree, tmp_path):
    scanned = files.scan_tree(spark, tree)
    files.pack(scanned, str(tmp_path / "packed"))
    back = files.packed(spark, str(tmp_path / "packed"))
    as_set = lambda df: {(r.path, r.length, bytes(r.content)) for r in df.collect()}
    assert as_set(back) == as_set(scanned)


def test_commit_lines_and_listing(spark):
    df = spark.createDataFrame([("hera", 1, " a \n\nb\n")], "machine string, pos int, message string")
    got = [(r.at.pos, r.at.line_no, r.line) for r in commits.commit_lines(df).collect()]
    assert got == [(1, 0, "a"), (1, 1, ""), (1, 2, "b")]
    listing = spark.createDataFrame(
        [(0, "ab\trefs/heads/develop"), (1, ""), (2, "cd\trefs/heads/feature/x")], "pos int, line string"
    )
    got = [(r.pos, r.branch) for r in commits.listed_branches(listing).collect()]
    assert got == [(0, "develop"), (2, "feature/x")]


def test_config(spark, tmp_path):
    doc = {
        "machines": [
            {"machine_name": "m1", "hostname_pattern": "m1*", "update_paths": ["/a", "/b"]},
            {"machine_name": "m2", "hostname_pattern": "x.e", "update_paths": []},
        ]
    }
    (tmp_path / "c.json").write_text(json.dumps(doc, indent=2))
    rows = config.read_config(spark, str(tmp_path / "c.json"))
    got = sorted((r.machine_name, r.update_path or "") for r in rows.collect())
    assert got == [("m1", "/a"), ("m1", "/b"), ("m2", "")]
    patterns = config.machine_patterns(rows).orderBy("machine_pos").collect()
    assert [tuple(r) for r in patterns] == [(0, "m1", "m1*"), (1, "m2", "x.e")]


def test_path_filter_prunes_before_content(spark, tree):
    plan = files.scan_tree(spark, tree).select("path").where(F.col("path") != "")
    assert "content" not in plan._jdf.queryExecution().optimizedPlan().toString().split("Relation")[0]


def test_many_folders_are_listed_by_few_tasks(spark, tmp_path):
    from runledger.session import file_tasks

    n = 3 * file_tasks(spark)
    for i in range(n):
        (tmp_path / f"m{i}").mkdir()
        (tmp_path / f"m{i}" / "summary.dat").write_bytes(b"x")
    context, found = spark.sparkContext, {}
    before = spark.conf.get("spark.sql.sources.parallelPartitionDiscovery.parallelism")
    for name, scan in (("files", files.scan_tree), ("lines", lines.scan_lines)):
        context.setJobGroup(f"listing-{name}", "")
        found[name] = scan(spark, str(tmp_path))
        jobs = context.statusTracker().getJobIdsForGroup(f"listing-{name}")
        stages = [s for j in jobs for s in context.statusTracker().getJobInfo(j).stageIds]
        tasks = [context.statusTracker().getStageInfo(s).numTasks for s in stages]
        assert tasks and max(tasks) <= file_tasks(spark)
    context.setLocalProperty("spark.jobGroup.id", None)
    assert found["files"].count() == found["lines"].count() == n
    assert spark.conf.get("spark.sql.sources.parallelPartitionDiscovery.parallelism") == before


def _tree_bytes(root):
    found = {}
    for folder, _, names in os.walk(root):
        for name in names:
            if not name.startswith("_"):
                with open(f"{folder}/{name}", "rb") as f:
                    found[os.path.relpath(folder, root), name.rsplit(".", 1)[1]] = f.read()
    return found


def test_files_made_by_tasks_are_those_of_sparks_writer(spark, tmp_path, monkeypatch):
    from runledger.catalog import samples

    keys = [(1, 0), (1, 0), (1, 1), (2, None), (3, 5), (7, 2), (None, 1), (None, None), (11, 2), (35, 4)]
    rows = spark.createDataFrame(keys, "s_suppkey long, s_nationkey int")
    rows.write.parquet(str(tmp_path / "supplier.parquet"))
    own = _tree_bytes(samples.tree(spark, str(tmp_path)))
    # One file a report or log: no check sums beside them, nothing left unfinished.
    assert {suffix for _, suffix in own} == {"dat", "log", "txt"} and len(own) == 15
    monkeypatch.setattr(samples, "local_path", lambda *a: None)
    theirs = _tree_bytes(samples.tree(spark, str(tmp_path)))
    assert own == {k: v for k, v in theirs.items() if k[1] != "crc"}


def test_rows_of_one_path_follow_one_another_in_its_file(spark, tmp_path):
    rows = spark.createDataFrame([("a/b", b"1"), ("a/b", b"2"), ("c", b"\xff\n")], "path string, content binary")
    files.write_files(rows.coalesce(1).sortWithinPartitions("path", "content"), str(tmp_path / "out"))
    assert (tmp_path / "out/a/b").read_bytes() == b"12" and (tmp_path / "out/c").read_bytes() == b"\xff\n"
    assert sorted(os.listdir(tmp_path / "out")) == ["a", "c"] and os.listdir(tmp_path / "out/a") == ["b"]


def test_files_of_other_paths_are_not_opened(spark, tmp_path):
    (tmp_path / "a é").mkdir()
    (tmp_path / "a é/summary.dat").write_bytes(b"x")
    (tmp_path / "a é/build.log").write_bytes(b"y\n")
    (tmp_path / "other").write_bytes(b"z")
    root = str(tmp_path)
    reports, logs = files.scan_tree(spark, root, ["summary", "é"]), lines.log_lines(spark, root)
    os.remove(tmp_path / "other")
    assert [r.path for r in reports.collect()] == ["/a é/summary.dat"]
    assert [(r.path, r.line) for r in logs.collect()] == [("/a é/build.log", "y")]


def test_many_short_files_are_read_in_few_tasks(spark, tmp_path):
    from runledger.session import file_tasks

    n = 2 * file_tasks(spark)
    for i in range(n):
        (tmp_path / f"{i}-build.log").write_bytes(b"x\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4m")
    try:
        for found in (files.scan_tree(spark, str(tmp_path)), lines.log_lines(spark, str(tmp_path))):
            assert found.rdd.getNumPartitions() <= file_tasks(spark) and found.count() == n
        spark.conf.set("spark.sql.files.maxPartitionBytes", "1b")
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        assert files.scan_tree(spark, str(tmp_path)).rdd.getNumPartitions() == n
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_short_logs_are_cut_from_whole_texts_and_long_ones_read_in_blocks(spark, tmp_path, monkeypatch):
    bodies = [b"\xef\xbb\xbfv8.1\r\nx\ry\n\n", b"\xef\xbb\xbf", b"\n", b"\xff\xe2\x82\nb", b"a\x0bb\xc2\x85c\nv", b"", b"q\n" * 70]
    for i, body in enumerate(bodies):
        (tmp_path / f"{i}-build.log").write_bytes(body)
    (tmp_path / "build.log.txt").write_bytes(b"other suffix\n")
    root = str(tmp_path)

    def rows(found):
        kept = found.orderBy("path", "block", "place").collect()
        return [(r.path, r.line) for r in kept]

    want = rows(lines.scan_lines(spark, root, ["build.log"], glob="*.log"))
    found = lines.log_lines(spark, root)
    assert len(want) > 75 and rows(found) == want
    # Hadoop's reader of lines costs a set-up for every file.
    assert "Format: Text" not in found._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(lines, "SHORT_BYTES", 64)
    found = lines.log_lines(spark, root)
    assert rows(found) == want
    assert "Format: Text" in found._jdf.queryExecution().executedPlan().toString()
    assert "Union" in found._jdf.queryExecution().executedPlan().toString()


def test_a_tree_is_listed_once_for_several_scans(spark, tmp_path):
    (tmp_path / "summary.dat").write_bytes(b"x")
    (tmp_path / "build.log").write_bytes(b"y\n")
    root = str(tmp_path)
    listed = files.list_tree(spark, root)
    (tmp_path / "later-build.log").write_bytes(b"z\n")
    (tmp_path / "later-summary.dat").write_bytes(b"z")
    assert [r.path for r in files.scan_tree(spark, root, ["summary"], listed=listed).collect()] == ["/summary.dat"]
    assert [r.line for r in lines.log_lines(spark, root, listed).collect()] == ["y"]
    assert lines.log_lines(spark, root).count() == 2
