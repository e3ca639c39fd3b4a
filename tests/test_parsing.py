from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from runledger import constants as K
from runledger.functions import parsing

HEAD = f"Build for = intel_18.0.5_intelmpi_g_feat_x_y, mpi version 2018.4.274-A on Cheyenne {K.OS_MARK}: Linux"
TAIL = (
    "unit test results   \tPASS 8926\tFAIL 0\nsystem test results \tPASS 49 \tFAIL 1\n"
    "example test results \tNo examples ran\nnuopc test results \tPASS -1 \tFAIL -1\n"
)


def parse(spark, *texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    rows = parsing.parse_reports(df).collect()
    return [r.asDict() for r in sorted(rows, key=lambda r: r["i"])]


def test_whole_report(spark):
    (row,) = parse(spark, f"===\n{HEAD}\ngit hash = v8\n\n{TAIL}===\n")
    assert row["reject_reason"] is None
    keys = ("branch", "host", "compiler", "c_version", "mpi", "m_version", "o_g", "os")
    assert [row[k] for k in keys] == [
        "feat_x_y", "Cheyenne", "intel", "18.0.5", "intelmpi", "2018.4.274-a", "g", "Linux",
    ]
    assert (row["unit_pass"], row["unit_fail"], row["unit_status"]) == (8926, 0, "ok")
    assert (row["example_pass"], row["example_fail"], row["example_status"]) == (None, None, "fail")
    assert (row["nuopc_pass"], row["nuopc_fail"]) == (-1, -1)


def test_later_header_discards_and_last_line_wins(spark):
    again = "unit test results\tPASS 7\tFAIL 7\n"
    stale, last = parse(spark, f"{HEAD}\n{again}{HEAD}\n{TAIL}", f"{HEAD}\n{TAIL}{again}")
    assert stale["unit_pass"] == 8926
    assert last["unit_pass"] == 7


def test_reject_reasons(spark):
    cases = {
        "no header": (TAIL, "no_header"),
        "empty": ("", "no_header"),
        "six words": (f"{HEAD.replace(' on Cheyenne', ' Cheyenne')}\n{TAIL}", "bad_header"),
        "double blank": (f"{HEAD.replace(' on ', '  on ')}\n{TAIL}", "bad_header"),
        "blank ends": (f"{HEAD.replace(', mpi', ',   mpi')}  \n{TAIL}", None),
        "four parts": (f"{HEAD.replace('_feat_x_y', '')}\n{TAIL}", "bad_header"),
        "no comma": (f"{HEAD.replace(',', ';')}\n{TAIL}", "bad_header"),
        "earlier bad header": (f"Build for nothing\n{HEAD}\n{TAIL}", "bad_header"),
        "no tab": (f"{HEAD}\n{TAIL}unit test results PASS 1 FAIL 2\n", "bad_result"),
        "unknown": (f"{HEAD}\n{TAIL}perf test results\tPASS 1\tFAIL 2\n", "unknown_kind"),
        "unknown, void": (f"perf test results\tPASS 1\tFAIL 2\n{HEAD}\n{TAIL}", None),
        "missing": (f"{HEAD}\n{TAIL.replace('nuopc test results', 'nuopc')}", "missing_kind"),
        "empty branch": (f"{HEAD.replace('feat_x_y', '')}\n{TAIL}", None),
    }
    rows = parse(spark, *[text for text, _ in cases.values()])
    assert [r["reject_reason"] for r in rows] == [reason for _, reason in cases.values()]


def test_numbers_that_are_none(spark):
    values = ["PASS 1 FAIL", "PASS 1 2 3", "1.0 2", "PASS +3 FAIL 4", " 5   6 ", "99999999999999999999 1"]
    texts = [f"{HEAD}\n{TAIL}unit test results\t{v}\n" for v in values]
    got = [(r["unit_pass"], r["unit_fail"], r["unit_status"]) for r in parse(spark, *texts)]
    none = (None, None, "fail")
    assert got == [none, none, none, (3, 4, "ok"), (5, 6, "ok"), none]


def test_render_then_parse(spark):
    word = st.text(alphabet="abcXYZ019.-", min_size=1, max_size=6)
    number = st.integers(-1, 10**6)
    report = st.tuples(*[word] * 4, st.text(alphabet="ab_", max_size=6), *[word] * 3, number, number)

    @settings(max_examples=3, deadline=None)
    @given(st.lists(report, min_size=40, max_size=60))
    def check(reports):
        texts = []
        for c, v, m, o, b, mv, h, os_, p, f in reports:
            head = f"Build for = {c}_{v}_{m}_{o}_{b}, mpi version {mv} on {h} {K.OS_MARK}: {os_}\n"
            texts.append(head + TAIL + f"unit test results\tPASS {p}\tFAIL {f}\n")
        for row, (c, v, m, o, b, mv, h, os_, p, f) in zip(parse(spark, *texts), reports):
            assert row["reject_reason"] is None
            got = [row[k] for k in ("compiler", "c_version", "mpi", "o_g", "branch", "m_version")]
            assert got == [c, v, m, o, b, mv.lower()]
            assert [row["host"], row["os"], row["unit_pass"], row["unit_fail"]] == [h, os_, p, f]

    check()


def test_build_log(spark):
    texts = [
        "x\nNETCDF library VERSION: 4.7.2\nnetcdf library version: 9.9.9\n"
        f"NetCDF Fortran version: netCDF-Fortran 4.5.2\n{K.SUCCESS_MESSAGE}\n",
        f"NetCDF library version:\nNetCDF library version: 4.7.2\n{K.SUCCESS_MESSAGE.lower()}\n",
        "",
    ]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    rows = sorted(parsing.parse_logs(df).collect(), key=lambda r: r["i"])
    got = [(r["build_passed"], r["netcdf_c"], r["netcdf_f"]) for r in rows]
    assert got == [(True, "4.7.2", "4.5.2"), (False, "", ""), (False, "", "")]


def test_tail_limit(spark):
    texts = [f"{K.SUCCESS_MESSAGE}\n" + "x\n" * n for n in (0, 201, 202)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    rows = df.orderBy("i").select(parsing.tail_build_passed(F.col("text")).alias("r")).collect()
    assert [r["r"] for r in rows] == [True, True, False]


def test_text_report_words(spark):
    df = spark.createDataFrame([(f"{HEAD}\n{TAIL}",)], "text string")
    row = df.select(
        *[c.alias(n) for n, c in parsing.text_report_fields(F.col("text")).items()]
    ).first()
    assert (row.os, row.unit_pass, row.unit_fail) == ("Linux", "8926", "0")
    assert (row.example_pass, row.example_fail) == ("examples", "-")
