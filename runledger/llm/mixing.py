"""Mixing sources to target weights by capped water-filling."""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from runledger.llm.ranking import positions
from runledger.session import stage

WORD = r"[^\x20\x09-\x0D]+"
_BUCKET_DIGITS = 3
ADDED = ("size", "source_size", "target", "repeats", "taken")


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def draw_key(seed: int) -> Column:
    """The place of a document in the seeded draw, as text that sorts evenly.

    A document without an id is drawn by its text.
    """
    name = F.coalesce(F.col("doc_id").cast("string"), F.md5("text"), F.lit(""))
    return F.md5(F.concat(F.lit(f"{seed}:"), name))


def source_key(source: Column) -> Column:
    """Code-point order with null last."""
    return F.when(source.isNull(), F.lit("w")).otherwise(F.concat(F.lit("v"), source))


def _exact(column: str) -> Column:
    return F.col(column).cast("decimal(38,0)")


def water_level(
    sources: DataFrame, share: tuple[int, int], max_epochs: int
) -> tuple[int, int]:
    """Words per unit of weight of the sources below their cap, as ``(words, weight)``.

    ``sources`` has ``size`` and ``weight``. Clamps every source whose share is above its
    cap and shares the rest out again by weight, until none is above: a Newton iteration
    on a concave function, which only climbs and ends exactly. All sums are whole
    numbers; two of them come back to the driver each round.
    """
    top, bottom = share
    cap, weight = _exact("size") * max_epochs * bottom, _exact("weight")
    total, words, free = sources.agg(
        F.sum(_exact("size")), F.sum(_exact("size")) * top, F.sum(weight)
    ).first()
    words, free, left = int(words or 0), int(free or 0), int((total or 0) * top)
    while True:
        above = weight * F.lit(Decimal(words)) > cap * F.lit(Decimal(max(free, 1)))
        capped, under = sources.agg(
            F.sum(F.when(above, cap)), F.sum(F.when(~above, weight))
        ).first()
        words_now, free_now = left - int(capped or 0), int(under or 0)
        if free_now == 0 or (words_now, free_now) == (words, free):
            return words, max(free, 1)
        words, free = words_now, free_now


def mixing_plan(
    sized: DataFrame, weights: Sequence[int], share: tuple[int, int], max_epochs: int
) -> DataFrame:
    """One row per source: its size, target, whole repetitions and where the last one ends.

    ``sized`` has ``__source, __key, size``. Sizes are summed per source and leading
    digits of the key; the digits at which the running sum crosses the fractional
    repetition are found from those sums, and only the documents below them are put in
    order one by one, a 4096th of a source.
    """
    digits = F.substring("__key", 1, _BUCKET_DIGITS)
    sums = sized.groupBy("__source", digits.alias("__digits")).agg(F.sum("size").alias("__words"))
    sums = stage(sums, "buckets")
    totals = sums.groupBy("__source").agg(F.sum("__words").alias("size"))
    ranked, _ = positions(totals, ["__source"], "__rank")
    cycle = F.array(*[F.lit(w) for w in weights])
    weight = F.element_at(cycle, (F.col("__rank") % len(weights) + 1).cast("int"))
    sources = stage(ranked.withColumn("weight", weight), "sources")
    words, free = water_level(sources, share, max_epochs)
    bottom = share[1]
    cap = _exact("size") * max_epochs
    ask = _exact("weight") * F.lit(Decimal(words))
    clamped = ask > cap * F.lit(Decimal(free * bottom))
    target = F.when(clamped, cap.cast("double")).otherwise(
        ask.cast("double") / F.lit(float(free * bottom))
    )
    sources = sources.withColumn("target", target)
    whole = F.when(F.col("size") > 0, F.floor(F.col("target") / F.col("size"))).otherwise(F.lit(0))
    sources = sources.withColumn("whole", whole.cast("int"))
    sources = sources.withColumn("need", F.col("target") - F.col("whole") * F.col("size"))
    sources = sources.select("__source", F.col("size").alias("source_size"), "target", "whole", "need")
    until = W.partitionBy("__source").orderBy("__digits")
    running = sums.withColumn("__upto", F.sum("__words").over(until))
    running = running.withColumn("__from", F.col("__upto") - F.col("__words"))
    edge = running.join(sources.select("__source", "need"), "__source").where(
        (F.col("__from") < F.col("need")) & (F.col("need") <= F.col("__upto"))
    )
    edge = stage(edge.select("__source", "__digits", "__from", "need"), "edges")
    inside = sized.withColumn("__digits", digits).join(edge, ["__source", "__digits"])
    inside = inside.groupBy("__source", "__key", "__from", "need").agg(F.sum("size").alias("size"))
    upto = F.col("__from") + F.sum("size").over(W.partitionBy("__source").orderBy("__key"))
    taken = 2 * upto - F.col("size") <= 2 * F.col("need")
    last = inside.withColumn("__taken", taken).where("__taken")
    last = last.groupBy("__source").agg(F.max("__key").alias("__last"))
    ends = edge.join(last, "__source", "left").select(
        "__source", F.coalesce("__last", "__digits").alias("__last")
    )
    return sources.join(ends, "__source", "left").drop("need")


def mix_sources(
    docs: DataFrame,
    weights: Sequence[int] = (5, 2, 1),
    share: tuple[int, int] = (3, 2),
    max_epochs: int = 2,
    seed: int = 17,
) -> DataFrame:
    """``docs`` with how often the mix takes each document.

    Reads ``doc_id, text, source``. Sources in code-point order, null last, weigh
    ``weights``, repeating; together they get ``share`` (a fraction) of all words, none
    more than ``max_epochs`` times its own. Adds ``size`` (words), ``source_size``,
    ``target``, ``repeats`` and ``taken = repeats * size``; input columns of these names
    are replaced, others kept.

    A source is repeated as often as fits whole; the rest is filled by documents in the
    order of a seeded digest, up to the one whose middle passes the target, so a source
    misses its target by at most half a document. Rows with one ``doc_id`` fare alike.
    Null and empty texts have size 0, a source of only such has target 0; an empty table
    gives an empty result.
    """
    docs = docs.drop(*ADDED)
    drawn = docs.withColumns(
        {
            "size": word_count(F.col("text")),
            "__key": draw_key(seed),
            "__source": source_key(F.col("source")),
        }
    )
    sized = stage(drawn.select("__source", "__key", "size"), "sized")
    plan = stage(mixing_plan(sized, weights, share, max_epochs), "plan")
    extra = F.coalesce(F.col("__key") <= F.col("__last"), F.lit(False)).cast("int")
    repeats = F.when(F.col("size") > 0, F.least(F.col("whole") + extra, F.lit(max_epochs)))
    mixed = drawn.join(plan, "__source").withColumn(
        "repeats", F.coalesce(repeats, F.col("whole")).cast("int")
    )
    mixed = mixed.withColumn("taken", (F.col("repeats") * F.col("size")).cast("long"))
    return mixed.select(*docs.columns, *ADDED)


def repeat_documents(mixed: DataFrame) -> DataFrame:
    """Each document as often as the mix takes it, without the added columns."""
    times = F.explode(F.sequence(F.lit(1), F.col("repeats"))).alias("__time")
    kept = mixed.where(F.col("repeats") > 0)
    return kept.select(*[c for c in mixed.columns if c not in ADDED], times).drop("__time")


def mix_documents(docs: DataFrame) -> DataFrame:
    """``docs`` as often as the mix of its sources takes them, in the columns it has.

    Columns named like those ``mix_sources`` adds, in any case, are carried unchanged.
    """
    held = [c for c in docs.columns if c.lower() in ADDED]
    packed = docs.withColumn("__held", F.struct(*held)) if held else docs
    out = repeat_documents(mix_sources(packed))
    return out.select(*[F.col("__held")[c].alias(c) if c in held else c for c in docs.columns])
