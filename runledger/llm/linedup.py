"""Repeated runs of lines, by a suffix array over line numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runledger.llm.bloom import may_be_among
from runledger.llm.ranking import positions
from runledger.session import stage

_FULL = r"[^\x20\x09-\x0D]"
_WORD = r"[^\x20\x09-\x0D]+"


def split_lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


# What a line stands in: rows that share an id are one document only if their texts are equal.
_DOC = ("doc_id", "text_id")


def text_id(text: Column) -> Column:
    return F.xxhash64(text)


def line_sequence(docs: DataFrame) -> DataFrame:
    """``(doc_id, text_id, at, line_no, line, n_words)``: hashes of the lines that are not blank, numbered anew."""
    lines = F.transform(
        split_lines(F.col("text")),
        lambda line, no: F.struct(
            no.alias("line_no"),
            F.xxhash64(line).alias("line"),
            F.rlike(line, F.lit(_FULL)).alias("full"),
            F.regexp_count(line, F.lit(_WORD)).alias("n_words"),
        ),
    )
    full = F.filter(lines, lambda x: x["full"])
    named = docs.where("doc_id IS NOT NULL AND text IS NOT NULL")
    rows = named.select(
        F.col("doc_id").cast("long"), text_id(F.col("text")).alias("text_id"), F.posexplode(full).alias("at", "x")
    )
    return rows.select(*_DOC, "at", "x.line_no", "x.line", "x.n_words")


def _ranked(keyed: DataFrame, keys: list[str]) -> DataFrame:
    """``keyed`` with the place of its key among the sorted keys that occur repeatedly.

    Rows whose key occurs once are dropped: no repeated run starts there. Keys are counted
    in the map tasks and ranked as ranges of distinct keys, so a key that most rows share
    is one row.
    """
    tied = keyed.groupBy(*keys).agg(F.count("*").alias("__n")).where("__n > 1").drop("__n")
    ranks, _ = positions(tied, keys, "place")
    ranked = keyed.join(ranks, keys).select(*_DOC, "at", F.col("place").alias("rank"))
    return stage(ranked, "suffixes")


def suffix_ranks(
    lines: DataFrame, depth: int, ranked: DataFrame | None = None, reach: int = 1
) -> DataFrame:
    """``(doc_id, text_id, at, rank)`` of the suffixes that share their first ``depth`` lines with others.

    Prefix doubling: ranks by one line, then by pairs of ranks one apart, two apart and so
    on until ``depth`` lines are told apart; equal ranks are an interval of the suffix
    array whose longest common prefix is at least ``depth``. A suffix alone in its rank
    leaves, as does one that runs into such, so each round joins only what is still tied.
    ``ranked`` are ranks by ``reach`` lines to go on from.
    """
    if ranked is None:
        ranked, reach = _ranked(lines, ["line"]), 1
    while reach < depth:
        step = min(reach, depth - reach)
        ahead = ranked.select(
            *_DOC, (F.col("at") - step).alias("at"), F.col("rank").alias("next")
        )
        ranked = _ranked(ranked.join(ahead, [*_DOC, "at"]), ["rank", "next"])
        reach += step
    return ranked


def _longer_than(first: DataFrame, lines: DataFrame, depth: int, min_words: int) -> DataFrame:
    """``first`` for the ranks whose ``depth`` lines have more than ``min_words`` words."""
    spots = first.select(
        "rank", *[f"first.{c}" for c in _DOC], F.explode(F.sequence("first.at", F.col("first.at") + (depth - 1))).alias("at")
    )
    words = spots.join(lines.select(*_DOC, "at", "n_words"), [*_DOC, "at"])
    long = words.groupBy("rank").agg(F.sum("n_words").alias("n")).where(F.col("n") > min_words)
    return first.join(long.select("rank"), "rank")


def repeated_lines(docs: DataFrame, min_lines: int = 3, min_words: int | None = None) -> DataFrame:
    """``(doc_id, text_id, removed)``: numbers of the lines that lie in later copies of a run.

    A run of at least ``min_lines`` lines that has occurred before, in order of ``doc_id``,
    text and line, is a later copy, in another document or the same; maximal runs come out
    as neighbouring lines. Reads ``doc_id, text``. Lines end at ``\\n``; blank ones count in
    no run and are never removed. Texts without such a run give no row; null texts and rows
    without an id neither. Rows that share an id and text count as one document; rows that
    share an id only are documents of their own, told apart by ``text_id``, a text's hash.
    With ``min_words`` a shorter run counts as well if its lines have more words than that.
    """
    lines = stage(line_sequence(docs).distinct(), "lines")
    spot = F.struct(*_DOC, "at")
    ranked, reach, inside = None, 1, None
    for depth in [min_lines] if min_words is None else range(1, min_lines + 1):
        ranked = suffix_ranks(lines.select(*_DOC, "at", "line"), depth, ranked, reach)
        reach = depth
        # Read back, so that the rows of a rank that most suffixes share can be split.
        first = stage(ranked.groupBy("rank").agg(F.min(spot).alias("first")), "first")
        if depth < min_lines:
            first = stage(_longer_than(first, lines, depth, min_words), "first")
        later = ranked.join(first, "rank").where(spot > F.col("first"))
        spots = later.select(*_DOC, F.explode(F.sequence("at", F.col("at") + (depth - 1))).alias("at"))
        inside = spots if inside is None else inside.union(spots)
    gone = inside.distinct().join(lines.select(*_DOC, "at", "line_no"), [*_DOC, "at"])
    return gone.groupBy(*_DOC).agg(F.sort_array(F.collect_set("line_no")).alias("removed"))


def without_repeated_lines(
    docs: DataFrame, min_lines: int = 3, min_words: int | None = None
) -> DataFrame:
    """``docs`` with later copies of repeated runs of lines cut out of ``text``.

    Adds ``n_lines`` (0 for null) and ``n_removed``; input columns of these names are
    replaced, others kept. Only documents that lose lines are shuffled with their text.
    """
    columns = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    gone = stage(repeated_lines(docs, min_lines, min_words), "removed")
    lines = split_lines(F.col("text"))
    counted = docs.select(*columns, F.coalesce(F.size(lines), F.lit(0)).alias("n_lines"))
    counted = counted.withColumn("n_lines", F.greatest("n_lines", F.lit(0)))
    touched = F.coalesce(may_be_among(F.col("doc_id").cast("long"), gone, "doc_id"), F.lit(False))
    clear = counted.where(~touched).withColumn("n_removed", F.lit(0))
    keys = {"__id": F.col("doc_id").cast("long"), "__text": text_id(F.col("text"))}
    gone = gone.withColumnsRenamed({"doc_id": "__id", "text_id": "__text"})
    cut = counted.where(touched).withColumns(keys).join(gone, list(keys), "left")
    kept = F.filter(lines, lambda line, no: ~F.array_contains("removed", no))
    short = F.when(F.col("removed").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    cut = cut.withColumns(
        {"text": short, "n_removed": F.coalesce(F.size("removed"), F.lit(0))}
    )
    cut = cut.withColumn("n_removed", F.greatest("n_removed", F.lit(0)))
    return clear.union(cut.select(*columns, "n_lines", "n_removed"))
