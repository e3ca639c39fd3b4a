"""Benchmark items inside documents, by containment search."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runledger.llm.bloom import bloom_bits, might_hold, without_ids
from runledger.llm.hashing import U64, chunks, mix, shingle_hashes, short_run_hashes
from runledger.session import stage

_WORD = r"[^\x20\x09-\x0D]+"
_ORDER = U64(0xA0761D6478BD642F)


def item_sketches(items: DataFrame, k: int, part: tuple[int, int]) -> DataFrame:
    """``(item_id, hash, sketched)``: the shingles of each item, its least by MinHash marked.

    Items are partitioned by size into powers of two. Within a partition a sketch is as
    long as its largest member needs: one more than the shingles a document may lack, so
    every document that holds enough of an item holds a value of its sketch.
    """
    num, den = part

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, texts in chunks(batch):
                names = chunk.column("item_id").to_pylist()
                rows: list[list] = [[], [], []]
                for name, shingles in zip(names, shingle_hashes(texts, k), strict=True):
                    values = np.unique(shingles)
                    values = values[np.argsort(mix(values ^ _ORDER))]
                    n = len(values)
                    largest = (1 << n.bit_length()) - 1
                    length = largest - -(-num * largest // den) + 1
                    rows[0] += [name] * n
                    rows[1] += values.view(np.int64).tolist()
                    rows[2] += [place < length for place in range(n)]
                kinds = [pa.int64(), pa.int64(), pa.bool_()]
                yield pa.record_batch(
                    [pa.array(r, t) for r, t in zip(rows, kinds, strict=True)],
                    names=["item_id", "hash", "sketched"],
                )

    schema = "item_id long, hash long, sketched boolean"
    named = items.where("item_id IS NOT NULL").select(F.col("item_id").cast("long"), "text")
    rows = named.mapInArrow(sketch, schema)
    return rows.groupBy("item_id", "hash").agg(F.bool_or("sketched").alias("sketched"))


def contained_items(
    docs: DataFrame, items: DataFrame, k: int = 5, part: tuple[int, int] = (4, 5)
) -> DataFrame:
    """Pairs of a document and an item most of whose ``k``-word shingles it holds.

    Reads ``doc_id, text`` and ``item_id, text``; returns ``doc_id, item_id, n_shingles``
    (distinct ones of the item) and ``n_shared`` where ``den * n_shared >= num * n_shingles``.

    A scan of the documents keeps the shingles that pass a filter of fixed size made of
    all items; those meet the sketches of the items' size partitions, which finds every
    pair that can qualify; candidates are then verified by counting shared shingles.
    Shingles are compared by 64-bit hashes of lower-cased words.

    An item of fewer than ``k`` words is one shingle, its whole sequence of words; it is
    found wherever a document has these words in a row. Texts without words, rows without an id, and repeated rows (counted
    once) add nothing; several texts under one ``item_id`` count as one item of all
    their shingles, searched by all their sketches. Other columns are not read.
    """
    num, den = part
    length = F.regexp_count("text", F.lit(_WORD))
    # At most k - 1 numbers.
    short = sorted(r[0] for r in items.select(length).where(length.between(1, k - 1)).distinct().collect())
    sketched = stage(item_sketches(items, k, part), "items")
    shared = docs.sparkSession.sparkContext.broadcast(bloom_bits(sketched, F.col("hash")))

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = shared.value
        for batch in batches:
            for chunk, texts in chunks(batch):
                names = chunk.column("doc_id").to_numpy(zero_copy_only=False)
                runs = [shingle_hashes(texts, k), *(short_run_hashes(texts, n) for n in short)]
                own = [np.concatenate(r) for r in zip(*runs, strict=True)]
                held = [np.unique(s[might_hold(bitmap, s)]) for s in own]
                yield pa.record_batch(
                    [
                        pa.array(np.repeat(names, [len(h) for h in held]), pa.int64()),
                        pa.array(np.concatenate([*held, np.zeros(0, U64)]).view(np.int64)),
                    ],
                    names=["doc_id", "hash"],
                )

    named = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long"), "text")
    hits = stage(named.mapInArrow(probe, "doc_id long, hash long").distinct(), "hits")
    sketches = sketched.where("sketched").select("item_id", "hash")
    candidates = hits.join(sketches, "hash").select("doc_id", "item_id").distinct()
    # Only shingles of candidate pairs are counted, not all pairs that share a common one.
    pairs = stage(candidates, "candidates").join(hits, "doc_id")
    common = pairs.join(sketched.select("item_id", "hash"), ["item_id", "hash"])
    counted = common.groupBy("doc_id", "item_id").agg(F.count("*").alias("n_shared"))
    sizes = stage(sketched.groupBy("item_id").agg(F.count("*").alias("n_shingles")), "sizes")
    found = counted.join(sizes, "item_id")
    enough = found.where(F.col("n_shared") * den >= F.col("n_shingles") * num)
    return enough.select("doc_id", "item_id", "n_shingles", "n_shared")


def drop_contaminated(
    docs: DataFrame, items: DataFrame, k: int = 5, part: tuple[int, int] = (4, 5)
) -> DataFrame:
    """``docs`` without those that hold an item; rows without an id stay."""
    return without_ids(docs, contained_items(docs, items, k, part).select("doc_id"))
