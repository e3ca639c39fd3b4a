"""Dialogues seen by each of their speakers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from runledger.llm.ranking import positions
from runledger.session import stage

SYSTEM = "system"
UNNAMED = "unknown"
_CHUNK = 1024


def _running(df: DataFrame, groups: list[str], place: str, value: str, name: str) -> DataFrame:
    """``df`` with the sum of ``value`` over the rows of its group before it, as ``name``.

    Summed within stretches of 1024 places, then over the stretches before, so no task
    sorts a whole group.
    """
    df = df.withColumn("__stretch", F.floor(F.col(place) / _CHUNK))
    whole = df.groupBy(*groups, "__stretch").agg(F.sum(value).alias("__sum"))
    before = W.partitionBy(*groups).orderBy("__stretch").rowsBetween(W.unboundedPreceding, -1)
    starts = whole.select(
        *groups, "__stretch", F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__from")
    )
    own = W.partitionBy(*groups, "__stretch").orderBy(place).rowsBetween(W.unboundedPreceding, -1)
    within = df.withColumn("__within", F.coalesce(F.sum(value).over(own), F.lit(0)))
    joined = within.join(starts, [*groups, "__stretch"])
    summed = (F.col("__from") + F.col("__within")).cast("long")
    return joined.withColumn(name, summed).drop("__stretch", "__from", "__within")


def escaped(text: Column) -> Column:
    """``text`` with a backslash in every ``<|``, so that it opens no mark of the format."""
    return F.replace(text, F.lit("<|"), F.lit("<\\|"))


def _head(role: Column, name: Column) -> Column:
    one_line = F.regexp_replace(escaped(name), r"[\r\n]+", " ")
    named = F.when(name.isNull(), F.lit("")).otherwise(F.concat(F.lit(" name="), one_line))
    return F.concat(F.lit("<|im_start|>"), role, named, F.lit("\n"))


def rendered_dialogues(messages: DataFrame) -> DataFrame:
    """``(conv_id, perspective, rendered, spans)``: whole dialogues with their training spans.

    ``messages`` is what ``rotate_perspectives`` gives. One row holds a dialogue, so this is
    for dialogues that fit a row.
    """
    parts = F.sort_array(F.collect_list(F.struct("place", "rendered", "train_start", "train_stop")))
    spans = F.filter("parts", lambda p: p["train_start"].isNotNull())
    whole = messages.groupBy("conv_id", "perspective").agg(parts.alias("parts"))
    return whole.select(
        "conv_id",
        "perspective",
        F.array_join(F.transform("parts", lambda p: p["rendered"]), "").alias("rendered"),
        F.transform(spans, lambda p: F.struct(p["train_start"].alias("start"), p["train_stop"].alias("stop"))).alias("spans"),
    )


def rotate_perspectives(conversations: DataFrame) -> DataFrame:
    """Every dialogue once per participant, a row per message, with what to learn from.

    Reads ``conv_id, turn, role, text``. A participant is a speaker (a ``role``) other
    than ``system``; a null or empty role is ``unknown``. Seen by participant
    ``perspective``, their own messages are the assistant's, all others users' under the
    speaker's name, and system messages stay. Returns ``conv_id, perspective, place``
    (of the message, from 0 in order of turn, null first, then role and digest of the
    text), ``turn, speaker, role, name, rendered``, the span ``start, stop`` of the message
    in the rendered dialogue in signs, and the mask ``train_start, train_stop``: text and
    end mark of the assistant's messages, null elsewhere and where there is no text.

    Texts and names cannot forge a mark: every ``<|`` in them is rendered as ``<\\|``, and
    a line break in a name as a blank. ``rendered_dialogues`` joins the rows to texts.

    A dialogue is the rows of one key in order of ``place``, so one that holds much of the
    table is never gathered. A null text is empty. Repeated messages stay. Rows without
    ``conv_id``, and dialogues without a participant, give no row. Other columns are not
    read.
    """
    speaker = F.coalesce(F.nullif(F.col("role"), F.lit("")), F.lit(UNNAMED))
    turns = conversations.where("conv_id IS NOT NULL").select(
        "conv_id",
        "turn",
        speaker.alias("speaker"),
        escaped(F.coalesce("text", F.lit(""))).alias("text"),
        F.md5(F.coalesce("text", F.lit(""))).alias("__digest"),
    )
    placed, _ = positions(turns, ["conv_id", "turn", "speaker", "__digest"], "__spot")
    placed = stage(placed.drop("__digest"), "turns")
    # Read back, so that the rows of a hot dialogue can be split over tasks.
    first = stage(placed.groupBy("conv_id").agg(F.min("__spot").alias("__first")), "first")
    placed = placed.join(first, "conv_id")
    placed = placed.withColumn("place", F.col("__spot") - F.col("__first")).drop("__spot", "__first")
    people = placed.where(F.col("speaker") != SYSTEM).select(
        "conv_id", F.col("speaker").alias("perspective")
    )
    seen = placed.join(stage(people.distinct(), "people"), "conv_id")
    own = F.col("speaker") == F.col("perspective")
    role = F.when(F.col("speaker") == SYSTEM, SYSTEM).when(own, "assistant").otherwise("user")
    seen = seen.withColumn("role", role)
    seen = seen.withColumn("name", F.when(F.col("role") == "user", F.col("speaker")))
    head, end = _head(F.col("role"), F.col("name")), "<|im_end|>\n"
    seen = seen.withColumns(
        {
            "rendered": F.concat(head, F.col("text"), F.lit(end)),
            "__head": F.char_length(head),
            "__text": F.char_length("text"),
        }
    )
    seen = seen.withColumn("__size", F.char_length("rendered"))
    seen = _running(seen, ["conv_id", "perspective"], "place", "__size", "start")
    learned = (F.col("role") == "assistant") & (F.col("__text") > 0)
    from_ = F.col("start") + F.col("__head")
    to = from_ + F.col("__text") + (len(end) - 1)
    return seen.select(
        "conv_id",
        "perspective",
        "place",
        "turn",
        "speaker",
        "role",
        "name",
        "rendered",
        "start",
        (F.col("start") + F.col("__size")).alias("stop"),
        F.when(learned, from_).alias("train_start"),
        F.when(learned, to).alias("train_stop"),
    )
