"""Lines and patterns brought together by letters a pattern cannot do without."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runledger.functions.text import bind
from runledger.session import stage

GRAM = 3
# So many grams are each looked for in a line; of more, the line's own grams are looked up.
_FEW = 128
_GAP = "\x01"
_NESTING = 8
_ESCAPE = (
    r"(?s)\\(?:[pPxN]\{[^}]*\}|x[0-9A-Fa-f]{2}|u[0-9A-Fa-f]{4}|0[0-7]{1,3}|c.|k<[^>]*>|.)"
)
_CLASS = r"\[\^?\]?[^\[\]]*\]"
_GROUP = r"\([^()]*\)"
_OPTIONAL = r"(?s).(?:[*?]|\{[^}]*\})[+?]?"
_UNREAD = r"\\Q|\(\?[^:=!<]"


def _pieces(alternative: Column) -> Column:
    """Runs of letters of one alternative that every match holds, as they stand."""
    fixed = F.regexp_replace(alternative, _OPTIONAL, _GAP)
    fixed = F.regexp_replace(fixed, r"\+[+?]?", _GAP)
    fixed = F.regexp_replace(fixed, r"[.^$]", _GAP)
    return F.filter(F.split(fixed, _GAP), lambda p: F.length(p) > 0)


def required_pieces(pattern: Column) -> Column:
    """The alternatives of a regular expression, each with pieces its matches must hold.

    Escapes, classes, groups and whatever may be left out are gaps; what remains between
    gaps is literal. Patterns with inline flags, quoting or deeper nesting than eight give
    one alternative without pieces, which rules nothing out.
    """
    bare = F.regexp_replace(pattern, _ESCAPE, _GAP)
    for _ in range(3):
        bare = F.regexp_replace(bare, _CLASS, _GAP)
    for _ in range(_NESTING):
        bare = F.regexp_replace(bare, _GROUP, _GAP)
    unread = F.regexp_like(pattern, F.lit(_UNREAD))
    unsure = F.array(F.array().cast("array<string>"))
    return F.when(unread, unsure).otherwise(
        bind(
            bare,
            lambda b: F.when(F.regexp_like(b, F.lit(r"[()\[\]]")), unsure).otherwise(
                F.transform(F.split(b, r"\|", -1), _pieces)
            ),
        )
    )


def _grams_of(text: Column, size: int) -> Column:
    """All runs of ``size`` letters."""
    if size == 0:
        return F.array(F.lit(""))
    places = F.sequence(F.lit(1), F.length(text) - size + 1)
    grams = F.transform(places, lambda i: F.substring(text, i, F.lit(size)))
    return F.when(F.length(text) >= size, grams).otherwise(F.array().cast("array<string>"))


def piece_grams(pieces: Column) -> Column:
    """Grams any one of which a match must hold: of three letters where a piece is long enough.

    Otherwise the longest pieces themselves, and the empty text where there is none.
    """

    def of_size(size: int) -> Column:
        return F.flatten(F.transform(pieces, lambda p: _grams_of(p, size)))

    grams = of_size(GRAM)
    for size in range(GRAM - 1, -1, -1):
        shorter = F.array(F.lit("")) if size == 0 else of_size(size)
        grams = F.when(F.size(grams) > 0, grams).otherwise(shorter)
    return F.array_distinct(grams)


def _offered(lines: DataFrame, line: str, posted: DataFrame) -> DataFrame:
    """``lines`` with every gram they hold as ``_gram``; of few posted grams only these."""
    few = [r[0] for r in posted.select("_gram").distinct().limit(_FEW + 1).collect()]
    if 0 < len(few) <= _FEW:
        listed = F.array(*[F.lit(g) for g in sorted(few)])
        held = F.filter(listed, lambda g: F.contains(F.col(line), g))
        return lines.withColumn("_gram", F.explode(held))
    # At most GRAM + 1 numbers.
    sizes = sorted(r[0] for r in posted.select(F.length("_gram")).distinct().collect())
    grams = F.array().cast("array<string>")
    if sizes:
        grams = F.array_distinct(F.flatten(F.array(*[_grams_of(F.col(line), n) for n in sizes])))
    return lines.withColumn("_gram", F.explode(grams))


def candidate_pairs(
    lines: DataFrame,
    patterns: DataFrame,
    line: str = "line",
    pattern: str = "pattern",
    scope: Sequence[str] = (),
) -> DataFrame:
    """Rows of ``lines`` with every pattern that may match somewhere in ``line``.

    ``patterns`` has ``pattern`` and the ``scope`` columns, on which both sides must agree.
    Every alternative of a pattern is posted under the gram of its required pieces that the
    fewest lines hold, and lines meet patterns in an equi-join on the grams they hold, so
    only patterns without a single required letter are tried on every line. Where few grams
    are posted, a line is not cut into its own: it is searched for those. A pattern one
    of whose grams no line holds is out. No pattern is missed; a pair can come twice, once
    for each alternative, and the caller tests the whole pattern.
    """
    keys = [*scope, "_gram"]
    wanted = patterns.select(*scope, pattern).where(F.col(pattern).isNotNull()).distinct()
    posted = wanted.select("*", F.posexplode(required_pieces(F.col(pattern))).alias("_alt", "_pieces"))
    posted = posted.select(*scope, pattern, "_alt", F.explode(piece_grams(F.col("_pieces"))).alias("_gram"))
    posted = stage(posted, "grams")
    counts = _offered(lines, line, posted).select(*keys).join(posted.select(*keys).distinct(), keys, "left_semi")
    counts = counts.groupBy(*keys).agg(F.count("*").alias("_n"))
    rated = posted.join(counts, keys, "left").withColumn("_n", F.coalesce("_n", F.lit(0)))
    rarest = F.min_by(F.struct("_n", "_gram"), F.struct("_n", "_gram")).alias("_rarest")
    chosen = rated.groupBy(*scope, pattern, "_alt").agg(rarest).where("_rarest._n > 0")
    chosen = stage(chosen.select(*scope, pattern, F.col("_rarest._gram").alias("_gram")).distinct(), "posted")
    return _offered(lines, line, chosen).join(chosen, keys).drop("_gram")
