"""Version tokens, branches and the rules that tie a line to a version."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from runledger import constants as K
from runledger.functions.text import strip


def hash_token(value: Column, patterns: Iterable[str] = K.HASH_PATTERNS) -> Column:
    """First hit of the first pattern that hits; ``''`` when none does."""
    hits = [F.nullif(F.regexp_extract(value, p, 0), F.lit("")) for p in patterns]
    return F.coalesce(*hits, F.lit(""))


def commit_prefix(token: Column) -> Column:
    """Commit abbreviation inside a version: the last dash part without its first letter."""
    return F.substring(F.substring_index(token, "-", -1), 2, 2**31 - 1)


def sanitize_branch(branch: Column) -> Column:
    return F.translate(branch, "/", "_")


def branch_from_log_line(line: Column) -> Column:
    """Branch named in a commit line, ``''`` when the line names none."""
    return F.regexp_extract(line, K.BRANCH_IN_LOG_PATTERN, 2)


def message_hash(message: Column) -> Column:
    """Eighth word of a commit message, the version in the older message form."""
    return F.coalesce(F.try_element_at(F.split(strip(message), r"\s+"), F.lit(8)), F.lit(""))


def is_tagged(token: Column) -> Column:
    return ~token.contains("-g")


def line_starts_with(line: Column, token: Column) -> Column:
    """The token, read as a regular expression, matches at the start of the line."""
    return F.regexp_like(line, F.concat(F.lit("^(?:"), token, F.lit(")")))


def tagged_match(line: Column, token: Column) -> Column:
    return is_tagged(token) & (strip(line) == token)


def untagged_match(line: Column, token: Column) -> Column:
    return ~is_tagged(token) & (F.length(strip(line)) >= F.length(token))


def version_match(line: Column, token: Column, literal: bool = False) -> Column:
    """The whole rule: starts with the token, and equals it or is no shorter."""
    starts = F.startswith(line, token) if literal else line_starts_with(line, token)
    return (tagged_match(line, token) | untagged_match(line, token)) & starts
