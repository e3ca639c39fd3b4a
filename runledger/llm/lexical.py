"""Ranked lexical search of many items at once over shared partial scores."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from runledger.llm.sharing import SharingPlan, sharing_plan
from runledger.llm.words import BY_LETTERS, word_lists
from runledger.session import stage

_CELLS = 1 << 21
_WAITING = 1 << 17
_SALTS = 64


def item_terms(items: DataFrame) -> DataFrame:
    """Distinct ``(item_id, term)`` of the items that have an id."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("item_id").to_pylist()
            texts = batch.column("text").to_pylist()
            for item, text in zip(ids, texts, strict=True):
                for words in word_lists(text, BY_LETTERS):
                    terms = sorted(set(words))
                    yield pa.record_batch(
                        [pa.array([item] * len(terms), pa.int64()), pa.array(terms, pa.binary())],
                        names=["item_id", "term"],
                    )

    texts = items.where("item_id IS NOT NULL").select(
        F.col("item_id").cast("long"), F.col("text").cast("binary").alias("text")
    )
    return texts.mapInArrow(split, "item_id long, term binary").distinct()


def term_counts(docs: DataFrame, vocabulary: list[bytes]) -> DataFrame:
    """Per document its number of terms, and number and count of each one in ``vocabulary``."""
    places = {term: i for i, term in enumerate(vocabulary)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = places.keys()
        for batch in batches:
            sizes, terms, counts = [], [], []
            for text in batch.column("text"):
                size, own = 0, Counter()
                for words in word_lists(text.as_py(), BY_LETTERS):
                    size += len(words)
                    found = Counter(words)
                    own.update({t: found[t] for t in found.keys() & known})
                sizes.append(size)
                terms.append([places[t] for t in own])
                counts.append(list(own.values()))
            yield pa.record_batch(
                [
                    batch.column("doc_id"),
                    pa.array(sizes, pa.int64()),
                    pa.array(terms, pa.list_(pa.int32())),
                    pa.array(counts, pa.list_(pa.int64())),
                ],
                names=["doc_id", "n", "terms", "counts"],
            )

    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text"))
    counted = texts.mapInArrow(count, "doc_id long, n long, terms array<int>, counts array<long>")
    return counted.where("n > 0")


class Accumulators:
    """Partial scores of a chunk of documents along a sharing plan, and the best ones per item."""

    def __init__(
        self, plan: SharingPlan, vocabulary: list[bytes], weights: np.ndarray, k: int
    ) -> None:
        self.plan, self.k, self.weights = plan, k, weights
        self.items = sorted(plan.parts)
        self.leaf = np.array([plan.leaf_of[t] for t in vocabulary], dtype=np.int64)
        self.least = np.ones(len(self.items), dtype=np.int64)
        self.found: list[tuple[np.ndarray, ...]] = []
        self.waiting = 0

    def nodes(self, terms: pa.ListArray, counts: pa.ListArray, m: np.ndarray) -> np.ndarray:
        """Sums of all nodes, one row each, for documents in columns; each is added up once."""
        doc = pc.list_parent_indices(terms).to_numpy()
        term = terms.flatten().to_numpy().astype(np.int64)
        tf = counts.flatten().to_numpy()
        gain = self.weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 20 * m[doc]))
        sums = np.zeros((self.plan.n_nodes, len(m)), dtype=np.int64)
        np.add.at(sums, (self.leaf[term], doc), gain)
        for new, (a, b) in enumerate(self.plan.sums, self.plan.n_leaves):
            np.add(sums[a], sums[b], out=sums[new])
        return sums

    def offer(self, ids: np.ndarray, sums: np.ndarray) -> None:
        """Take in a chunk; scores that cannot be among an item's best are left."""
        for place, item in enumerate(self.items):
            scores = sums[self.plan.parts[item]].sum(axis=0)
            at = np.flatnonzero(scores >= self.least[place])
            if len(at):
                self.found.append((np.full(len(at), place), ids[at], scores[at]))
                self.waiting += len(at)
        if self.waiting > _WAITING:
            self.settle()

    def settle(self) -> None:
        """Keep the best ``k`` of each item, equal scores by id."""
        if not self.found:
            return
        place, ids, scores = (np.concatenate(x) for x in zip(*self.found, strict=True))
        order = np.lexsort((ids, -scores, place))
        place, ids, scores = place[order], ids[order], scores[order]
        first = np.searchsorted(place, np.arange(len(self.items) + 1))
        rank = np.arange(len(place)) - first[place]
        full = np.flatnonzero(np.diff(first) >= self.k)
        self.least[full] = np.maximum(scores[first[full] + self.k - 1], 1)
        kept = rank < self.k
        self.found = [(place[kept], ids[kept], scores[kept])]
        self.waiting = int(kept.sum())

    def best(self) -> pa.RecordBatch:
        self.settle()
        empty = np.zeros(0, dtype=np.int64)
        place, ids, scores = self.found[0] if self.found else (empty, empty, empty)
        items = np.array(self.items, dtype=np.int64)
        return pa.record_batch(
            [pa.array(items[place], pa.int64()), pa.array(ids, pa.int64()), pa.array(scores, pa.int64())],
            names=["item_id", "doc_id", "score"],
        )


def _ranked_block(docs: DataFrame, terms: dict[int, list[bytes]], k: int) -> DataFrame | None:
    """The best documents of every task for each item of a block; None where none has a term."""
    vocabulary = sorted({t for own in terms.values() for t in own})
    counted = stage(term_counts(docs, vocabulary), "counts")
    n_docs, n_terms = counted.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    if not n_docs:
        return None
    held = counted.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    df = dict(held.collect())
    weights = [
        math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df.get(i, 0) + 1)))
        for i in range(len(vocabulary))
    ]
    plan = sharing_plan(terms)
    plain = (plan.leaf_of, plan.n_leaves, plan.sums, plan.parts)
    shared = docs.sparkSession.sparkContext.broadcast((plain, vocabulary, weights))

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plain, vocabulary, weights = shared.value
        plan = SharingPlan(*plain)
        sums = Accumulators(plan, vocabulary, np.array(weights, dtype=np.int64), k)
        step = max(1, _CELLS // max(plan.n_nodes, 1))
        for batch in batches:
            for start in range(0, batch.num_rows, step):
                part = batch.slice(start, step)
                m = 50 + (50 * part.column("n").to_numpy() * n_docs) // n_terms
                nodes = sums.nodes(part.column("terms"), part.column("counts"), m)
                sums.offer(part.column("doc_id").to_numpy(), nodes)
        yield sums.best()

    named = counted.where("doc_id IS NOT NULL AND size(terms) > 0")
    return named.mapInArrow(rank, "item_id long, doc_id long, score long")


def _item_blocks(terms: DataFrame, budget: int) -> Iterator[dict[int, list[bytes]]]:
    """Items with their terms, in blocks of about ``budget`` pairs of terms of one item."""
    sizes = terms.groupBy("item_id").agg(F.count("*").alias("n"))
    pairs = sizes.agg(F.coalesce(F.sum(F.col("n") * F.col("n")), F.lit(0))).first()[0]
    blocks = -(-int(pairs) // budget)
    block = F.pmod(F.xxhash64("item_id"), F.lit(max(blocks, 1)))
    lists = terms.groupBy("item_id").agg(F.collect_list("term").alias("terms"))
    for number in range(blocks):
        rows = lists.where(block == number).collect()
        if rows:
            yield {r["item_id"]: [bytes(t) for t in r["terms"]] for r in rows}


def _top(found: DataFrame, k: int, *by: str | Column) -> DataFrame:
    order = W.partitionBy(*by).orderBy(F.desc("score"), "doc_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def ranked_documents(
    docs: DataFrame, items: DataFrame, k: int = 50, budget: int = 1 << 23
) -> DataFrame:
    """The ``k`` documents with the highest scores for each item: ``item_id, rank, doc_id, score``.

    Reads ``doc_id, text`` and ``item_id, text``. Terms are runs of 0-9, a-z, A-Z (as
    a-z) and signs beyond U+007F. A term of an item weighs ``floor(1000 ln((2N + 2) / (2
    df + 1)))`` and adds that times ``10**9 tf div (1000 tf + 20 m)``, where ``m = 50 + 50
    n N div L``; N counts the documents with a term, L all their terms, n those of the
    document. All else is whole numbers. Only scores above 0 are ranked, equal ones by
    ``doc_id``.

    Items are taken in blocks whose terms and plan fit one broadcast (``budget`` bounds
    the pairs of terms within items; blocks are by the id's digest), each a pass over all
    documents. In a block, terms the same items hold are one node, and nodes that items
    have in common are joined pair by pair into shared sums. A task adds up each node once
    per chunk of documents, then the items from their nodes, and keeps ``k`` documents of
    an item; those lists meet in two salted steps.

    A null or empty text has no term: as an item it gets no rows, as a document it counts
    nowhere. Rows of one ``item_id`` are one item, of one ``doc_id`` a document each. A
    document without an id counts in N, L and df and cannot be ranked; an item without an
    id is left out. Empty tables give an empty result. Other columns are not read.
    """
    terms = stage(item_terms(items), "terms")
    found = docs.sparkSession.createDataFrame([], "item_id long, doc_id long, score long")
    for block in _item_blocks(terms, budget):
        ranked = _ranked_block(docs, block, k)
        if ranked is not None:
            found = found.unionByName(ranked)
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(_SALTS))
    best = _top(_top(found, k, "item_id", salt), k, "item_id")
    return best.select("item_id", "rank", "doc_id", "score")
