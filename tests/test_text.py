import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from runledger import constants as K
from runledger.functions import paths, text, versions

SNAP = K.SNAPSHOT_PREFIX


def column(spark, values, expr):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    rows = df.select("i", expr(F.col("v")).alias("r")).collect()
    return [r["r"] for r in sorted(rows, key=lambda r: r["i"])]


def python_lines(value):
    """Lines as a file opened in text mode yields them."""
    parts = value.replace("\r\n", "\n").replace("\r", "\n").split("\n")
    return parts[:-1] if parts[-1] == "" else parts


def test_split_lines_cases(spark):
    cases = ["", "a", "a\n", "a\n\n", "\n", "a\r\nb\rc\nd", "\r\r", "a\r", "x\n\ry", "\r\n\r\n"]
    assert column(spark, cases, text.split_lines) == [python_lines(c) for c in cases]


def test_split_lines_any_text(spark):
    @settings(max_examples=4, deadline=None)
    @given(st.lists(st.text(alphabet="ab\r\n é", max_size=12), min_size=60, max_size=80))
    def check(values):
        assert column(spark, values, text.split_lines) == [python_lines(v) for v in values]

    check()


def test_strip_removes_all_white_space(spark):
    cases = [" a ", "\t a b\n\t", "", "  ", "a"]
    assert column(spark, cases, text.strip) == [c.strip() for c in cases]


def test_after_first(spark):
    assert column(spark, ["a=b=c", "abc", "=", ""], lambda c: text.after_first(c, "=")) == [
        "b=c",
        "abc",
        "",
        "",
    ]


def test_path_predicates(spark):
    cases = ["/a/summary.dat", "/a/.summary.dat.swp", "/b/x"]
    keep = column(spark, cases, lambda c: text.path_selected(c, ["/a/", "summary"], ["swp"]))
    assert keep == [True, False, False]
    assert column(spark, cases, lambda c: text.path_selected(c, [], [])) == [True, True, True]


@pytest.mark.parametrize(
    ("value", "token"),
    [
        (f"{SNAP}8_3_0_beta_snapshot_07-g8913088", f"{SNAP}8_3_0_beta_snapshot_07-g8913088"),
        ("v8.3.0b07-12-g8913088", "v8.3.0b07-12-g8913088"),
        (f"hash v8.3.0b08-5-g64 and {SNAP}8 {SNAP}9", f"{SNAP}8"),
        ("have v1.2 only", ""),
        ("nothing", ""),
    ],
)
def test_hash_token(spark, value, token):
    assert column(spark, [value], versions.hash_token) == [token]


def test_commit_prefix_and_branch_names(spark):
    assert column(spark, ["v8.3.0b07-12-g8913088", "v8"], versions.commit_prefix) == [
        "8913088",
        "8",
    ]
    assert column(spark, ["feature/a/b", "x"], versions.sanitize_branch) == ["feature_a_b", "x"]
    lines = [
        "6a32 update for test of gfortran_8.3.0_mpiuni_O_develop with hash v8 on discover",
        "x_g_feat_O_y with a with b",
        "no branch",
    ]
    assert column(spark, lines, versions.branch_from_log_line) == ["develop", "feat_O_y with a", ""]
    assert column(spark, ["a b c d e f g H i", "short"], versions.message_hash) == ["H", ""]


def test_path_attributes_drop_the_token_everywhere(spark):
    path = "/root/x/Layout_fix/HERA/Intel/18.0.5/g//intelmpi/2018.4.274/out/build.log"
    df = spark.createDataFrame([(path,)], "path string")
    row = df.select(*[c.alias(n) for n, c in paths.path_attributes(F.col("path")).items()]).first()
    assert tuple(row) == ("lay_fix", "hera", "intel", "18.0.5", "g", "intelmpi", "2018.4.274")
    off = paths.path_attributes(F.col("path"), strip_token=None)["branch"]
    assert df.select(off).first()[0] == "layout_fix"


def test_relative_path_and_components(spark):
    cases = ["file:/data/root/develop/hera/summary.dat", "/data/root/a b/x", "/other/x"]
    got = column(spark, cases, lambda c: paths.relative_to(c, "/data/root"))
    assert got == ["/develop/hera/summary.dat", "/a b/x", "/other/x"]
    got = column(spark, got, paths.inner_components)
    assert got == [["develop", "hera"], ["a b"], ["other"]]


def test_file_names(spark):
    cases = ["/a/Summary.DAT", "/a/b.log", "c.log.txt"]
    assert column(spark, cases, lambda c: paths.is_named(c, "summary.dat")) == [True, False, False]
    assert column(spark, cases, paths.has_suffix) == [False, True, False]


def rule(line, token):
    """A line stands for a token: brute force."""
    if re.compile(token).match(line) is None:
        return False
    bare = line.strip()
    return len(bare) >= len(token) if "-g" in token else bare == token


def test_version_match_against_rule(spark):
    tokens = ["v8.5.0", "v8.3.0b1-5-g64", f"{SNAP}8_3_0-8-g60a38ef"]
    lines = [*tokens, " v8.5.0", "v8.5.0 ", "v8x5x0", "v8.5.01", "v8x3x0b1-5-g64", "v8.3.0b1-5-g6"]
    lines += [f"{SNAP}8_3_0-8-g60a38ef462", f"{SNAP}8_3_0-8-g60a38ef and more", "git hash = v8.5.0"]
    pairs = [(line, t) for line in lines for t in tokens]
    df = spark.createDataFrame(pairs, "line string, t string")
    hit = versions.version_match(F.col("line"), F.col("t"))
    got = {(r.line, r.t) for r in df.where(hit).collect()}
    assert got == {p for p in pairs if rule(*p)}
