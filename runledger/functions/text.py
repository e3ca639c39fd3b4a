"""Decoding, line splitting and substring predicates."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from runledger import constants as K

BLANKS = " \t\n\x0b\x0c\r"


def latin1_text(content: Column) -> Column:
    """Report bytes as text."""
    return F.decode(content, K.REPORT_ENCODING)


def utf8_text(content: Column) -> Column:
    """Build log bytes as text; invalid sequences become U+FFFD instead of failing the job."""
    return F.make_valid_utf8(content.cast("string"))


def utf8_text_dropping(content: Column) -> Column:
    """Bytes as text without the invalid sequences, as line matching reads files."""
    return F.replace(utf8_text(content), F.lit("�"), F.lit(""))


def valid_utf8(content: Column) -> Column:
    return F.is_valid_utf8(content.cast("string"))


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` named once, however often ``body`` uses it.

    Repeating a column expression repeats its whole tree, and trees that repeat each other
    grow exponentially in the optimizer, whose rules trace join keys down to the scan.
    """
    return F.try_element_at(F.transform(F.array(value), body), F.lit(1))


def newlined(text: Column) -> Column:
    """Text under universal newlines; only one that holds a carriage return is rewritten."""
    return F.when(text.contains("\r"), F.regexp_replace(text, r"\r\n?", "\n")).otherwise(text)


def _lines(text: Column) -> Column:
    def cut(body: Column) -> Column:
        ended = F.endswith(body, F.lit("\n"))
        body = F.when(ended, F.substring(body, F.lit(1), F.length(body) - 1)).otherwise(body)
        return F.split(body, "\n")

    lines = bind(newlined(text), cut)
    return F.when(text == "", F.array().cast("array<string>")).otherwise(lines)


def split_lines(text: Column) -> Column:
    """Lines under universal newlines; the end of the last line opens no further one.

    Only texts that hold a carriage return pay for a regular expression, and splitting on
    one plain letter avoids it too.
    """
    return bind(text, _lines)


def after_first(value: Column, mark: str) -> Column:
    """Text after the first ``mark``, the whole text when there is none."""
    return bind(value, lambda v: F.substring(v, _behind(v, mark), F.length(v)))


def _behind(value: Column, mark: str) -> Column:
    return F.when(value.contains(mark), F.instr(value, mark) + len(mark)).otherwise(1)


def strip(value: Column) -> Column:
    """Remove white space of every kind at both ends (``trim`` removes blanks only)."""
    return F.btrim(value, F.lit(BLANKS))


def contains_all(value: Column, needles: Iterable[str]) -> Column:
    """True when ``value`` holds every needle; no needle means true."""
    return reduce(lambda acc, s: acc & value.contains(s), needles, F.lit(True))


def contains_any(value: Column, needles: Iterable[str]) -> Column:
    """True when ``value`` holds at least one needle; no needle means false."""
    return reduce(lambda acc, s: acc | value.contains(s), needles, F.lit(False))


def path_selected(path: Column, needles: Iterable[str], ignore: Iterable[str]) -> Column:
    return contains_all(path, needles) & ~contains_any(path, ignore)


def may_hold(location: Column, needles: Iterable[str]) -> Column:
    """False only for a URI whose path lacks a needle.

    Needles with letters that a URI may write otherwise are not tested. One comparison of
    bytes a needle: Spark tests it where files are listed, one by one, before any is opened.
    """
    return contains_all(location, [n for n in needles if re.fullmatch(r"[A-Za-z0-9._-]+", n)])


def words(value: Column) -> Column:
    """Words between runs of white space, without an empty first one."""
    return F.split(strip(value), r"\s+")
