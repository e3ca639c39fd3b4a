"""Hard negatives by coordinate pruning over length buckets."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from runledger.llm.coordinates import CoordinateLists
from runledger.llm.ranking import positions
from runledger.session import stage

_LENGTHS = 1024
_ANY = -(2**62)


def whole_vectors(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """``(vec_id, label, vector)`` with components ``floor(scale * x)``.

    Left out are rows without id or label, vectors that are null, empty or hold a null or
    non-finite component, and those whose length is not the commonest one.
    """
    cast = vectors.select(
        F.col("vec_id").cast("long"),
        F.col("label").cast("long"),
        F.col("embedding").cast("array<double>").alias("vector"),
    )
    sound = cast.where(
        "vec_id IS NOT NULL AND label IS NOT NULL AND size(vector) > 0"
        " AND forall(vector, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity'))"
    )
    sizes = sound.groupBy(F.size("vector").alias("n")).agg(F.count("*").alias("rows"))
    common = sizes.orderBy(F.desc("rows"), "n").first()
    own = sound.where(F.size("vector") == (common["n"] if common else 0))
    return own.withColumn("vector", F.transform("vector", lambda x: F.floor(scale * x)))


def _matrix(table: pa.Table) -> np.ndarray:
    flat = table.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(table.num_rows, -1)


class _Best:
    """The first ``k`` by score, then id, of each of a task's searches."""

    def __init__(self, k: int) -> None:
        self.k = k
        self.parts: list[tuple] = []

    def add(self, anchor: int, group: int, ids: np.ndarray, scores: np.ndarray) -> None:
        order = np.lexsort((ids, -scores))[: self.k]
        size = len(order)
        self.parts.append((np.full(size, anchor), np.full(size, group), ids[order], scores[order]))

    def table(self) -> pa.Table:
        empty = [np.zeros(0, dtype=np.int64)]
        columns = [np.concatenate([p[i] for p in self.parts] or empty) for i in range(4)]
        names = ("anchor", "aim", "vec_id", "score")
        return pa.table([pa.array(c, pa.int64()) for c in columns], names=list(names))


def _search(same: bool, k: int, focus: int):
    """Rows of a bucket for each anchor of a block: of its label, or of others within aims.

    An aim is a score of the anchor's positives with the lowest and highest score its
    negatives may have; positives have one aim without a highest score.
    """

    def search(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        best = _Best(k)
        if anchors.num_rows and rows.num_rows:
            bucket = CoordinateLists(_matrix(rows), focus)
            place, ids, labels = (rows.column(c).to_numpy() for c in ("place", "vec_id", "label"))
            own, own_labels = (anchors.column(c).to_numpy() for c in ("place", "label"))
            aims = anchors.column("aims").to_pylist()
            for at, query in enumerate(_matrix(anchors)):
                found, scores = bucket.reaching(query, min(a["low"] for a in aims[at]))
                alike = labels[found] == own_labels[at]
                fits = alike & (place[found] != own[at]) if same else ~alike
                found, scores = found[fits], scores[fits]
                for aim in aims[at]:
                    within = (scores >= aim["low"]) & (scores <= aim["high"])
                    best.add(own[at], aim["aim"], ids[found[within]], scores[within])
        return best.table()

    return search


def _first(found: DataFrame, k: int) -> DataFrame:
    order = W.partitionBy("anchor", "aim").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


class _Buckets:
    """Rows in buckets of ``size`` by descending length, and blocks of anchors that meet them."""

    def __init__(self, rows: DataFrame, n: int, size: int, block: int, focus: int) -> None:
        self.rows, self.size, self.focus = rows, size, focus
        self.last = max(0, (n - 1) // size)
        self.block = block
        step = -(-max(n, 1) // _LENGTHS)
        steps = F.floor(F.col("place") / step).alias("step")
        # At most _LENGTHS rows: the greatest length from each such place on.
        tops = rows.groupBy(steps).agg(F.max("squares").alias("top")).orderBy("step").collect()
        self.tops = [r["top"] for r in tops]
        self.step = step

    def reach(self) -> Column:
        """The last bucket with a row long enough for an anchor's lowest aim, by Cauchy-Schwarz."""
        low = F.array_min(F.transform("aims", lambda a: a["low"])).cast("double")
        need = F.when(low > 0, low * low * (1 - 1e-9)).otherwise(0.0)
        tops = F.array(*[F.lit(float(t)) for t in self.tops]).cast("array<double>")
        steps = F.size(F.filter(tops, lambda t: t * F.col("squares") >= need))
        return F.floor((steps * self.step - 1) / self.size).cast("int")

    def meet(self, anchors: DataFrame, first: int, last: int, same: bool, k: int) -> DataFrame:
        """The best rows of buckets ``first`` to ``last`` for each anchor and aim."""
        n = anchors.count() if last >= first else 0
        blocks = max(1, -(-n // self.block))
        own = F.pmod(F.xxhash64("place"), F.lit(blocks)).cast("int").alias("block")
        until = F.least(self.reach(), F.lit(last))
        sought = anchors.where(until >= first).select(
            own, F.explode(F.sequence(F.lit(first), until)).alias("bucket"), "place", "label", "vector", "aims"
        )
        bucket = F.floor(F.col("place") / self.size).cast("int")
        every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block")
        dealt = self.rows.where(bucket.between(first, last)).select(
            every, bucket.alias("bucket"), "place", "vec_id", "label", "vector"
        )
        keys = ("block", "bucket")
        met = sought.groupBy(*keys).cogroup(dealt.groupBy(*keys))
        schema = "anchor long, aim long, vec_id long, score long"
        return met.applyInArrow(_search(same, k, self.focus), schema)

    def search(self, anchors: DataFrame, same: bool, k: int) -> DataFrame:
        """The best ``k`` rows of all buckets for each of ``aims``.

        The longest rows come first: an aim they fill ``k`` times needs no score below its
        ``k``-th, which tightens the ranges and spares whole buckets of the rest.
        """
        anchors = stage(anchors, "anchors")
        longest = stage(_first(self.meet(anchors, 0, 0, same, k), k), "longest")
        if not self.last:
            return longest
        full = longest.where(F.col("rank") == k).select(
            F.col("anchor").alias("place"), "aim", F.col("score").alias("least")
        )
        full = full.groupBy("place").agg(F.map_from_entries(F.collect_list(F.struct("aim", "least"))).alias("full"))
        raised = F.transform(
            "aims",
            lambda a: F.struct(
                a["aim"].alias("aim"),
                F.greatest(a["low"], F.try_element_at("full", a["aim"])).alias("low"),
                a["high"].alias("high"),
            ),
        )
        narrowed = anchors.join(full, "place", "left").withColumn("aims", raised).drop("full")
        rest = self.meet(stage(narrowed, "anchors"), 1, self.last, same, k)
        both = longest.select("anchor", "aim", "vec_id", "score").unionByName(rest)
        return stage(_first(both, k), "best")


def mine_hard_negatives(
    rows: DataFrame,
    is_anchor: Column,
    positives: int = 5,
    negatives: int = 10,
    low: int = 30,
    high: int = 90,
    size: int = 4096,
    block: int = 4096,
    focus: int = 4,
) -> DataFrame:
    """Rows of another label that score close below each positive of each anchor.

    ``rows`` is ``(vec_id, label, vector)`` with whole-number vectors of one length and no
    nulls, as ``whole_vectors`` gives; ``is_anchor`` is a condition on it. A row's score is
    its inner product with the anchor, higher first, equal ones by ``vec_id``. An anchor's
    positives are its first ``positives`` other rows of the same label; the negatives of a
    positive are the first ``negatives`` rows of other labels whose score is ``low`` to
    ``high`` percent of the positive's. Returns ``anchor_id, positive_id, rank`` (from 1),
    ``negative_id, positive_score, negative_score``; all where there are fewer.

    Rows are sorted by length and cut into buckets of ``size``, in which every coordinate
    has a sorted list. An anchor skips buckets whose rows are too short for its bound; in
    the others the feasible ranges of its ``focus`` largest coordinates leave candidates,
    which are multiplied out exactly. Blocks of anchors meet buckets, so a task holds one
    of each. Nothing is approximate: the ranges only leave out rows that cannot qualify.

    A repeated row is a row of its own: it is another row to its copy, and as an anchor it
    has results of its own. A positive score below 0 admits no negative, one of 0 those of
    score 0. Products beyond 64 bits are not defined. Empty tables give an empty result.
    """
    squares = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x)
    sized = rows.select("vec_id", "label", "vector", squares.alias("squares"))
    order = [F.desc("squares"), "vec_id", "label", "vector"]
    placed, n = positions(sized, order, "place")
    placed = stage(placed, "rows")
    buckets = _Buckets(placed, n, size, block, focus)
    any_score = F.struct(
        F.lit(0).cast("long").alias("aim"),
        F.lit(_ANY).cast("long").alias("low"),
        F.lit(-_ANY).cast("long").alias("high"),
    )
    anchors = placed.where(is_anchor)
    near = buckets.search(anchors.withColumn("aims", F.array(any_score)), True, positives)
    near = near.select("anchor", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    aim = F.struct(
        F.col("positive_score").alias("aim"),
        F.expr(f"({low} * positive_score + 99) div 100").alias("low"),
        F.expr(f"({high} * positive_score) div 100").alias("high"),
    )
    aims = near.where("positive_score >= 0").groupBy(F.col("anchor").alias("place"))
    sought = anchors.join(aims.agg(F.collect_set(aim).alias("aims")), "place")
    found = buckets.search(sought, False, negatives)
    names = anchors.select(F.col("place").alias("anchor"), F.col("vec_id").alias("anchor_id"))
    found = found.withColumnRenamed("aim", "positive_score").join(near, ["anchor", "positive_score"])
    return found.join(names, "anchor").select(
        "anchor_id",
        "positive_id",
        F.col("rank").cast("int").alias("rank"),
        F.col("vec_id").alias("negative_id"),
        "positive_score",
        F.col("score").alias("negative_score"),
    )
