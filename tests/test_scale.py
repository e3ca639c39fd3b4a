"""Steps that every run shares: what they cost must not hang on lambdas, shuffled texts or repeated work."""

import re

from pyspark.sql import functions as F

from runledger.functions.parsing import parse_reports
from runledger.operators import history, matching
from runledger.plans import summarize as plan

REPORT = "Build for = nag_18_mpich_g_develop, mpi version 3.1 on hera esmf_os: Linux\n"
RESULTS = "".join(f"{k} test results \tPASS 7\tFAIL 1\n" for k in ("unit", "system", "example", "nuopc"))


def _files(spark, rows):
    files = spark.createDataFrame(rows, "path string, text string")
    return files.withColumn("match_text", F.col("text"))


def test_numbers_of_results_are_compiled_and_the_last_header_counts(spark):
    texts = [
        RESULTS + REPORT + RESULTS,
        "Build for this\r\nunit test results\t1 2\r\n" + REPORT + RESULTS.replace("\n", "\r\n"),
        REPORT + "x Build for = a_b_c_g_d_e, mpi version 4 on jet esmf_os: Mac\tunit test results",
        RESULTS, "", None,
    ]
    parsed = parse_reports(_files(spark, [(str(i), t) for i, t in enumerate(texts)]))
    tree = parsed._jdf.queryExecution().optimizedPlan().toString()
    assert not re.search(r"regexp_extract\(lambda x_\d+#\d+\.value", tree)
    got = {r.path: (r.branch, r.unit_pass, r.unit_status, r.reject_reason) for r in parsed.collect()}
    assert got["0"] == ("develop", 7, "ok", None)
    assert got["1"] == ("develop", 7, "ok", "bad_header")
    assert got["2"][0] == "d_e" and got["2"][3] == "bad_header"
    assert got["3"] == (None, 7, "ok", "no_header")
    assert got["4"][3] == got["5"][3] == "no_header"


def test_few_jobs_are_tested_without_pairs_and_give_the_same_run(spark, monkeypatch):
    rows = [
        (f"/r/{branch}/{host}/nag/18/g/mpich/3.1/{i}/summary.dat", REPORT + RESULTS + line)
        for i, (branch, host, line) in enumerate(
            [("develop", "hera", "v8.1\n"), ("develop", "hera", "  v8.1 \r\nv8.1 "), ("feat_x", "hera", "v8.1\n"),
             ("other", "hera", "v8.1\n"), ("develop", "Gaea", "v8.1\n"), ("develop", "jet", "av8.1\n")]
        )
    ]
    reports = _files(spark, rows + rows[:1])
    logs = _files(spark, [(p.replace("summary.dat", "build.log"), "v8.1\nESMF library built successfully") for p, _ in rows])
    hashes = spark.createDataFrame(
        [(m, i, b, j, 1, "v8.1") for i, m in enumerate(("hera", "jet")) for j, b in enumerate(("develop", "feat/x"))],
        "machine string, machine_pos int, branch string, branch_pos int, hash_rank int, branch_hash string",
    )
    latest = spark.createDataFrame([], "machine string, path string, artifacts_hash string, modified string")

    def run():
        results, _ = plan.summarize(reports, logs, hashes, latest)
        return sorted((r.machine, r.job_branch, r.source_path, r.unit_pass, r.build_passed) for r in results.collect())

    with monkeypatch.context() as many:
        many.setattr(matching, "_FEW_BRANCHES", 0)
        expected = run()
    assert len(expected) == 3
    monkeypatch.setattr(plan, "paths_of_jobs", None)
    assert run() == expected


def test_lines_found_in_a_text_are_those_of_its_lines(spark):
    tokens = spark.createDataFrame([("v8.1",), ("x2",), ("v8.1-5-gab",)], "branch_hash string")
    texts = ["v8.1", "v8.1-5-gab \r\nx2\r x2z", "a\n\nv8_1 x2\x85x2", "x2", "\n \n", "", None, "yx2\nb v8.1"]
    files = _files(spark, [(str(i), t) for i, t in enumerate(texts)]).drop("text")
    found = sorted(map(tuple, matching.match_texts(files, tokens).collect()))
    lined = files.select("path", F.split(F.regexp_replace("match_text", r"\r\n?", "\n"), "\n").alias("lines"))
    assert found == sorted(map(tuple, matching.match_lines(lined, tokens).collect()))
    assert ("1", "v8.1-5-gab") in found and ("1", "x2") in found
    tree = matching.match_texts(files, tokens)._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all" in tree


def test_equal_lines_fold_before_their_version_is_looked_for(spark):
    rows = [("hera", 5, "a on hera v1.2.3"), ("hera", 3, "b\na on hera v1.2.3"), ("hera", 3, "a on hera v1.2.3"),
            ("jet", 1, "a on hera v1.2.3"), ("hera", None, "c hera v1.2.4")]
    commits = spark.createDataFrame(rows, "machine string, pos long, message string")
    folded = history._folded_lines(commits)
    assert sorted((r.line, tuple(r["at"])) for r in folded.collect()) == [
        ("a on hera v1.2.3", (3, 0)), ("c hera v1.2.4", (None, 0))
    ]
