"""Files and lines against requested versions and jobs, without all-pairs joins."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runledger.functions.paths import inner_components
from runledger.functions.text import BLANKS, newlined, split_lines, strip
from runledger.functions.versions import is_tagged, sanitize_branch, version_match
from runledger.operators.postings import candidate_pairs
from runledger.session import stage

# Untagged tokens whose literal end stands within so many letters meet lines at that place, by
# so many letters at most; the full rule is checked after the join. The bounds keep the number
# of shapes fixed, and other tokens are posted by their grams.
_PLACES = 64
_LENGTH = 32
_PLAIN = r"\A[A-Za-z0-9_.-]+\z"
# So many branches and jobs are tested where a path is read; more meet the paths in a join.
_FEW_BRANCHES = 128
_FEW_JOBS = 4096


def _block(token: Column, literal: bool) -> Column:
    """Where a line must agree with the token, as ``struct(kind, at, size, key)``.

    ``whole``: a tagged token equals the stripped line. ``part``: of an untagged token
    made of letters, digits, dots, dashes and underscores, everything after the last dot
    is literal and stands at a fixed place; a ``literal`` one is literal from its start.
    ``gram``: any other token.
    """
    tail = F.substring_index(F.regexp_replace(token, r"\.+\z", ""), ".", -1)
    at = F.length(F.regexp_replace(token, r"\.+\z", "")) - F.length(tail) + 1

    def block(kind: str, at: Column, size: Column, key: Column) -> Column:
        return F.struct(
            F.lit(kind).alias("kind"), at.alias("at"), size.alias("size"), key.alias("key")
        )

    def part(at: Column, piece: Column) -> Column:
        size = F.least(F.length(piece), F.lit(_LENGTH))
        return block("part", at, size, F.substring(piece, 1, _LENGTH))

    whole = block("whole", F.lit(0), F.lit(0), token)
    if literal:
        return F.when(is_tagged(token), whole).otherwise(part(F.lit(1), token))
    gram = block("gram", F.lit(0), F.lit(0), F.lit(""))
    plain = F.regexp_like(token, F.lit(_PLAIN)) & (at <= _PLACES)
    return F.when(is_tagged(token), whole).when(plain, part(at, tail)).otherwise(gram)


def _first_letter(line: Column) -> Column:
    return F.substring(F.ltrim(line, F.lit(BLANKS)), 1, 1)


def _lines_opening(text: Column, firsts: Sequence[str]) -> Column:
    """Distinct lines whose first letter behind blanks is one of ``firsts``.

    Found in the undivided text, so that the many lines of a log that cannot match are never
    made into values of their own.
    """
    letters = "".join(rf"\x{{{ord(f):x}}}" for f in firsts)
    opening = rf"(?dm)^[ \t\x0b\x0c]*+[{letters}].*"
    return F.array_distinct(F.regexp_extract_all(newlined(text), F.lit(opening), F.lit(0)))


def _offered_keys(shapes: Sequence[tuple[str, int, int]]) -> Column:
    """Block keys the line in ``_line`` offers: itself stripped, and one per fitting shape."""
    line = F.col("_line")

    def offer(kind: str, at: int, size: int, key: Column) -> Column:
        return F.struct(
            F.lit(kind).alias("kind"), F.lit(at).alias("at"), F.lit(size).alias("size"), key.alias("key")
        )

    offers = [
        offer("whole", 0, 0, strip(line))
        if kind == "whole"
        else F.when(F.length(line) >= at + size - 1, offer(kind, at, size, F.substring(line, at, size)))
        for kind, at, size in shapes
    ]
    return F.filter(F.array(*offers), lambda o: o.isNotNull())


def match_lines(
    files: DataFrame,
    requests: DataFrame,
    lines: str = "lines",
    key: Sequence[str] = ("path",),
    literal: bool = False,
    text: str | None = None,
    once: bool = True,
) -> DataFrame:
    """Files with every requested ``branch_hash`` one of their lines stands for, each once.

    ``files`` carries an array of lines, or an undivided ``text``, which the result drops;
    ``requests`` has ``branch_hash``. Without ``once`` a file may come more than once with a
    version, which spares callers that fold files the shuffle. A token is a regular expression unless ``literal``. Lines and tokens
    meet in equi-joins, so nothing is compared with everything. Tokens made of plain signs
    meet them at a fixed place; the few shapes these have (2,048 at most) steer which keys a
    line offers. Tokens with further regular-expression signs are posted by the letters
    they require.
    """
    wanted = requests.select("branch_hash").distinct()
    wanted = stage(wanted.withColumn("_block", _block(F.col("branch_hash"), literal)), "tokens")
    shapes = wanted.select("_block.kind", "_block.at", "_block.size").distinct().collect()
    shapes = sorted((s["kind"], s["at"], s["size"]) for s in shapes)
    carried = [c for c in files.columns if c != (text or lines)]
    listed = split_lines(F.col(text)) if text else F.col(lines)
    distinct = F.array_distinct(listed)
    hit = version_match(F.col("_line"), F.col("branch_hash"), literal)
    found = []
    placed = [s for s in shapes if s[0] != "gram"]
    if placed:
        plain = wanted.where("_block.kind <> 'gram'")
        first = F.substring("branch_hash", 1, 1).alias("first")
        firsts = {r["first"] for r in plain.select(first).distinct().collect()}
        near = distinct
        if literal or "." not in firsts:
            if text and firsts.isdisjoint({"", None}):
                near = _lines_opening(F.col(text), sorted(firsts))
            else:
                near = F.filter(listed, lambda line: _first_letter(line).isin(*sorted(firsts)))
                near = F.array_distinct(near)
        mine = files.select(*carried, F.explode(near).alias("_line"))
        mine = mine.withColumn("_offer", F.explode(_offered_keys(placed)))
        found.append(mine.join(plain, F.col("_offer") == F.col("_block")))
    if len(placed) < len(shapes):
        general = wanted.where("_block.kind = 'gram'")
        every = files.select(*carried, F.explode(distinct).alias("_line"))
        found.append(candidate_pairs(every, general, "_line", "branch_hash"))
    if not found:
        none = files.select(*carried, F.explode(distinct).alias("_line"))
        found.append(none.where(F.lit(False)).withColumn("branch_hash", F.lit("")))
    hits = [f.where(hit).select(*carried, "branch_hash") for f in found]
    matched = reduce(DataFrame.unionByName, hits)
    return matched.dropDuplicates([*key, "branch_hash"]) if once else matched


def match_texts(
    files: DataFrame,
    requests: DataFrame,
    text: str = "match_text",
    literal: bool = False,
    once: bool = True,
) -> DataFrame:
    """``match_lines`` for files ``(path, ...)`` that carry their undivided text."""
    return match_lines(files, requests, literal=literal, text=text, once=once)


def _of_machine(inner: Column, exact: bool) -> Column:
    if exact:
        return F.array_contains(inner, F.col("machine"))
    return F.col("path").contains(F.col("machine"))


def _inner(key_value: bool) -> Column:
    inner = inner_components(F.col("path"))
    if key_value:
        inner = F.array_distinct(F.transform(inner, lambda c: F.regexp_replace(c, r"\A[^=]*=", "")))
    return inner


def few_jobs(requests: DataFrame) -> dict[str, frozenset[str]] | None:
    """Machines per branch component of a path, None where there are too many to list."""
    jobs = requests.select("machine", sanitize_branch(F.col("job_branch")).alias("part"))
    jobs = jobs.where("machine IS NOT NULL AND part IS NOT NULL").distinct()
    rows = jobs.limit(_FEW_JOBS + 1).collect()
    branches = {part for _, part in rows}
    if len(rows) > _FEW_JOBS or len(branches) > _FEW_BRANCHES:
        return None
    return {b: frozenset(m for m, part in rows if part == b) for b in sorted(branches)}


def _literals(values) -> Column:
    return F.array(*[F.lit(v) for v in sorted(values)]).cast("array<string>")


def owned_by(jobs: dict[str, frozenset[str]], exact: bool = False, key_value: bool = False) -> Column:
    """Whether ``path`` names a branch and a machine of ``few_jobs``, tested in its own row.

    True for every path some job owns, and for hardly another; ``matches_of_few_jobs``
    applies the whole rule to what is found. The path is named as few times as can be, as
    a filter may carry it down to where it is put together, once for each time it is named.
    """
    machines = frozenset().union(*jobs.values())
    parts = F.split(F.col("path"), "/")
    if key_value:
        parts = F.transform(parts, lambda c: F.regexp_replace(c, r"\A[^=]*=", ""))
    branches = F.arrays_overlap(parts, _literals(jobs))
    if exact:
        return branches & F.arrays_overlap(parts, _literals(machines))
    quoted = ["".join(rf"\x{{{ord(c):x}}}" for c in m) for m in sorted(machines)]
    return branches & F.regexp_like("path", F.lit("|".join(quoted)))


def paths_of_jobs(
    paths: DataFrame, jobs: DataFrame, exact: bool = False, key_value: bool = False
) -> DataFrame:
    """Pairs of ``paths(path, ...)`` and ``jobs(machine, branch, ...)``, each pair once.

    Joins on the branch component; the machine is tested on the pairs that leaves. It may
    stand anywhere in the path, with ``exact`` it must be a component too. ``key_value``
    takes the values of ``name=value`` components.
    """
    parts = paths.withColumn("_inner", _inner(key_value))
    parts = parts.withColumn("_part", F.explode("_inner"))
    joined = parts.join(jobs, F.col("_part") == sanitize_branch(F.col("branch")))
    return joined.where(_of_machine(F.col("_inner"), exact)).drop("_part", "_inner")


def matches_of_jobs(matches: DataFrame, owned: DataFrame, requests: DataFrame) -> DataFrame:
    """Files matched to a version, with every job that requests it and owns the path.

    ``owned`` pairs paths with jobs as ``paths_of_jobs`` gives them, ``requests`` has
    ``machine``, ``job_branch`` and ``branch_hash``. Files meet their jobs by path, which no
    other file has, so a version that most files hold is no hot key.
    """
    jobs = owned.select("path", "machine", F.col("branch").alias("job_branch"))
    return matches.join(jobs, "path").join(requests, ["machine", "job_branch", "branch_hash"])


def matches_of_few_jobs(
    matches: DataFrame,
    jobs: dict[str, frozenset[str]],
    requests: DataFrame,
    exact: bool = False,
    key_value: bool = False,
) -> DataFrame:
    """``matches_of_jobs`` from the paths themselves; requests of ``few_jobs`` are few rows."""
    named = matches.withColumn("_inner", _inner(key_value))
    named = named.withColumn("_part", F.explode(F.array_intersect("_inner", _literals(jobs))))
    wanted = requests.withColumn("_part", sanitize_branch(F.col("job_branch")))
    joined = named.join(wanted, ["_part", "branch_hash"])
    return joined.where(_of_machine(F.col("_inner"), exact)).drop("_part", "_inner")


def lines_matching(df: DataFrame, text: str, pattern: str) -> DataFrame:
    """Lines that match ``pattern`` from their start, with their number."""
    carried = [c for c in df.columns if c != text]
    lines = df.select(*carried, F.posexplode(split_lines(F.col(text))).alias("line_no", "line"))
    return lines.where(F.regexp_like(F.col("line"), F.lit(f"^(?:{pattern})")))


def containing_mark(
    files: DataFrame, requests: DataFrame, mark: str, text: str = "text"
) -> DataFrame:
    """Files whose text holds ``mark`` followed by a requested ``branch_hash``, each pair once.

    What follows each mark is cut to the first letters of the tokens, at most 32 of them, so
    this too is an equi-join and offers a bounded number of cuts per mark whatever lengths
    the tokens have; the rest of a token is tested on what the join leaves.
    """
    size = F.least(F.length("branch_hash"), F.lit(_LENGTH))
    sizes = sorted(r[0] for r in requests.select(size).distinct().collect())
    wanted = requests.withColumn("_head", F.substring("branch_hash", 1, _LENGTH))
    pieces = F.split(F.col(text), rf"\Q{mark}\E", -1)
    behind = F.array_distinct(F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0))))
    marked = files.withColumn("_rest", F.explode(behind)).drop(text)
    heads = F.array(*[F.substring("_rest", 1, n) for n in sizes]).cast("array<string>")
    offered = marked.withColumn("_offer", F.explode(F.array_distinct(heads)))
    joined = offered.join(wanted, F.col("_offer") == F.col("_head"))
    hits = joined.where(F.startswith("_rest", F.col("branch_hash")))
    return hits.drop("_offer", "_head", "_rest").distinct()
