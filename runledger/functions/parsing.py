"""Typed records from report and build log texts, one row in, one row out.

Everything happens inside the row with built-in functions, so parsing is one narrow
stage: no explode, no shuffle, no Python worker.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runledger import constants as K
from runledger.functions.text import after_first, bind, newlined, split_lines, strip

_RESULT_KIND = r"\A[^\S\t]*(\S+)[^\t]*\t"
_TWO_NUMBERS = r"\A([+-]?[0-9]+)\s+([+-]?[0-9]+)\z"


def header_parts(line: Column) -> Column:
    """A header line cut up, and whether it has the parts it must have.

    "Build for = c_v_m_o_branch, mpi version V on H <mark>: O": five parts left of the
    comma, the last of which keeps its underscores, and seven words right of it.
    """

    return bind(
        line,
        lambda whole: bind(
            bind(after_first(whole, "="), _cut_header), lambda p: _checked_header(whole, p)
        ),
    )


def _cut_header(rest: Column) -> Column:
    # Without a comma ``instr`` is 0 and the whole text stays, as it does in ``after_first``.
    behind = F.substring(rest, F.instr(rest, ",") + 1, F.length(rest))
    return F.struct(
        F.split(strip(F.substring_index(rest, ",", 1)), "_", 5).alias("left"),
        F.split(strip(behind), " ").alias("right"),
        rest.contains(",").alias("comma"),
    )


def _checked_header(line: Column, parts: Column) -> Column:
    valid = line.contains("=") & parts["comma"]
    valid = valid & (F.size(parts["left"]) == 5) & (F.size(parts["right"]) == 7)
    return F.struct(parts["left"].alias("left"), parts["right"].alias("right"), valid.alias("valid"))


def header_fields(parts: Column) -> dict[str, Column]:
    """The eight attributes; only ``m_version`` is lower-cased."""

    def left(place: int) -> Column:
        return F.try_element_at(parts["left"], F.lit(place))

    def right(place: int) -> Column:
        return F.try_element_at(parts["right"], F.lit(place))

    return {
        "branch": left(5),
        "host": right(5),
        "compiler": left(1),
        "c_version": left(2),
        "mpi": left(3),
        "m_version": F.lower(right(3)),
        "o_g": left(4),
        "os": right(7),
    }


def result_kind(line: Column) -> Column:
    """First word before the first tab, ``''`` when there is no tab or no word."""
    return F.regexp_extract(line, _RESULT_KIND, 1)


def result_value(line: Column) -> Column:
    """Text after the first tab without its PASS and FAIL words."""
    value = F.substring(line, F.instr(line, "\t") + 1, F.length(line))
    value = F.replace(value, F.lit("PASS"), F.lit(""))
    return strip(F.replace(value, F.lit("FAIL"), F.lit("")))


def result_number(value: Column, group: int) -> Column:
    """One of the two numbers of a cleaned result, null when it is not two numbers."""
    return F.regexp_extract(value, _TWO_NUMBERS, group).try_cast("bigint")


def _last_of_kind(results: Column, kind: str) -> Column:
    return F.try_element_at(F.filter(results, lambda r: r["kind"] == kind), F.lit(-1))


def _bad_header(line: Column) -> Column:
    return line.contains(K.HEADER_MARK) & ~header_parts(line)["valid"]


def _bad_result(line: Column) -> Column:
    return line.contains(K.RESULT_MARK) & (result_kind(line) == "")


def _last_holding(lines: Column, mark: str) -> Column:
    return F.try_element_at(F.filter(lines, lambda s: s.contains(mark)), F.lit(-1))


def parse_reports(df: DataFrame, text: str = "text") -> DataFrame:
    """Add the report's attributes, results and ``reject_reason`` (null for a whole report).

    A later header discards what came before it, the last line of a kind wins, and a
    result that is not two numbers is a failed one, with null numbers and status ``fail``.
    """
    # Texts are cut at the marks before they are cut into lines, and only lines that hold a
    # result run through a lambda: lambdas are interpreted, all else is compiled.
    df = df.withColumn("_text", newlined(F.col(text)))
    behind = F.substring_index("_text", K.HEADER_MARK, -1)
    df = df.withColumns({"_headed": F.col("_text").contains(K.HEADER_MARK), "_behind": behind})
    before = F.substring(F.col("_text"), F.lit(1), F.length("_text") - F.length("_behind"))
    df = df.withColumn("_start", F.when(F.col("_headed"), F.substring_index(before, "\n", -1)).otherwise(""))
    df = df.withColumn("_current", F.concat("_start", "_behind"))
    header = F.when(F.col("_headed"), F.substring_index("_current", "\n", 1))
    df = df.withColumns({"_header": header, "_lines": F.split("_current", "\n")})
    results = F.transform(
        F.filter("_lines", lambda line: line.contains(K.RESULT_MARK)),
        lambda line: F.struct(result_kind(line).alias("kind"), line.alias("line")),
    )
    earlier = F.substring(F.col("_text"), F.lit(1), F.length("_text") - F.length("_current"))
    several = earlier.contains(K.HEADER_MARK) | earlier.contains(K.RESULT_MARK)
    df = df.withColumns(
        {
            "_rest": F.substring(F.col("_header"), F.instr("_header", "=") + 1, F.length("_header")),
            "_results": results,
            "_earlier": F.when(several, F.split(earlier, "\n")).otherwise(F.array().cast("array<string>")),
        }
    )
    df = df.withColumns({f"_{kind}": _last_of_kind(F.col("_results"), kind) for kind in K.KINDS})
    df = df.withColumn("_cut", _cut_header(F.col("_rest")))
    df = df.withColumn("_parts", _checked_header(F.col("_header"), F.col("_cut")))
    df = df.withColumns({f"_value_{kind}": result_value(F.col(f"_{kind}.line")) for kind in K.KINDS})
    numbers = {
        f"_{side}_{kind}": result_number(F.col(f"_value_{kind}"), group)
        for kind in K.KINDS
        for group, side in enumerate(("pass", "fail"), start=1)
    }
    df = df.withColumns(numbers)
    columns = header_fields(F.col("_parts"))
    missing = F.lit(False)
    for kind in K.KINDS:
        last, passed, failed = F.col(f"_{kind}"), F.col(f"_pass_{kind}"), F.col(f"_fail_{kind}")
        ok = passed.isNotNull() & failed.isNotNull()
        columns[f"{kind}_pass"] = F.when(ok, passed)
        columns[f"{kind}_fail"] = F.when(ok, failed)
        columns[f"{kind}_status"] = F.when(last.isNotNull(), F.when(ok, "ok").otherwise("fail"))
        missing = missing | last.isNull()
    known = list(K.KINDS)
    columns["reject_reason"] = (
        F.when(F.exists("_earlier", _bad_header) | ~F.col("_parts.valid"), "bad_header")
        .when(
            F.exists("_earlier", _bad_result) | F.exists("_results", lambda r: r["kind"] == ""),
            "bad_result",
        )
        .when(F.col("_parts.valid").isNull(), "no_header")
        .when(F.exists("_results", lambda r: ~r["kind"].isin(known)), "unknown_kind")
        .when(missing, "missing_kind")
    )
    scratch = ["_text", "_headed", "_behind", "_start", "_current", "_header", "_lines", "_rest"]
    scratch += ["_results", "_earlier", "_cut", "_parts", *numbers]
    scratch += [f"{name}_{kind}" for kind in K.KINDS for name in ("", "_value")]
    return df.withColumns(columns).drop(*scratch)


def _topmost_version(text: Column, mark: str) -> Column:
    """Version on the first line holding ``mark`` in any case, ``''`` when it has none."""
    line = F.regexp_extract(text, rf"(?im)^[^\r\n]*?\Q{mark}\E[^\r\n]*", 0)
    return F.regexp_extract(line, K.VERSION_PATTERN, 0)


def parse_logs(df: DataFrame, text: str = "text") -> DataFrame:
    """Add ``build_passed``, ``netcdf_c`` and ``netcdf_f``.

    Works on the undivided text: build logs are the long files, and none of the three
    needs their lines.
    """
    return df.withColumns(
        {
            "build_passed": F.col(text).contains(K.SUCCESS_MESSAGE),
            "netcdf_c": _topmost_version(F.col(text), K.NETCDF_C_MARK),
            "netcdf_f": _topmost_version(F.col(text), K.NETCDF_F_MARK),
        }
    )


def tail_build_passed(text: Column, tail_lines: int = 202) -> Column:
    """Success message among the last ``tail_lines`` lines."""
    tail = F.slice(F.reverse(split_lines(text)), 1, tail_lines)
    return F.exists(tail, lambda line: line.contains(K.SUCCESS_MESSAGE))


def text_report_fields(text: Column) -> dict[str, Column]:
    """Operating system and result words of the older text report.

    The words are taken by place, the fifth and seventh of the last line of a kind, whether
    or not they are numbers; a missing one is ``-`` so that no later column shifts.
    """
    lines = split_lines(text)
    os_line = _last_holding(lines, K.OS_MARK)
    out = {"os": F.coalesce(F.try_element_at(F.split(os_line, ": "), F.lit(2)), F.lit("-"))}
    for kind in K.KINDS:
        line = _last_holding(lines, f"{kind} {K.RESULT_MARK}")
        parts = F.split(strip(line), r"\s+")
        for side, place in (("pass", 5), ("fail", 7)):
            word = F.nullif(F.try_element_at(parts, F.lit(place)), F.lit(""))
            out[f"{kind}_{side}"] = F.coalesce(word, F.lit("-"))
    return out
