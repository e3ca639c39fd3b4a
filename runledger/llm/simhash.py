"""Near-duplicate documents by SimHash fingerprints."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from runledger.llm.bktree import links_within
from runledger.llm.graph import connected_components
from runledger.llm.words import BY_BLANKS, word_lists
from runledger.session import stage

_SEED = 42


def shingle_numbers(text: bytes | None, k: int) -> Iterator[np.ndarray]:
    """Hashes of the runs of ``k`` words, in order and with repeats, in arrays of bounded size."""
    tail: list[bytes] = []
    whole = True
    for words in word_lists(text, BY_BLANKS):
        words = tail + words
        if len(words) >= k:
            whole = False
            yield _hashes(words, k)
        tail = words[1 - k :] if k > 1 else []
    if whole and tail:
        yield _hashes(tail, len(tail))


def _hashes(words: list[bytes], k: int) -> np.ndarray:
    joined = b" ".join(words)
    ends = list(accumulate(len(w) + 1 for w in words))
    starts = [0, *ends]
    pieces = [joined[a : b - 1] for a, b in zip(starts, ends[k - 1 :], strict=False)]
    return np.array([xxh64_intdigest(p, _SEED) for p in pieces], dtype=np.uint64)


def fingerprint(text: bytes | None, k: int) -> int:
    """64 bits, each set where it is set in over half of the shingles' hashes; 0 without words."""
    counts, n = np.zeros(64, dtype=np.int64), 0
    for hashes in shingle_numbers(text, k):
        bits = np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        counts += bits.sum(axis=0, dtype=np.int64)
        n += len(hashes)
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, k: int = 3) -> DataFrame:
    """``(doc_id, number)``: each row's fingerprint as a signed number."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text")
            numbers = [fingerprint(t.as_py(), k) for t in texts]
            yield pa.record_batch(
                [batch.column("doc_id"), pa.array(numbers, pa.int64())], names=["doc_id", "number"]
            )

    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text"))
    return texts.mapInArrow(sign, "doc_id long, number long")


def near_fingerprints(docs: DataFrame, k: int = 3, radius: int = 3) -> DataFrame:
    """The group of near copies each row of ``docs`` belongs to, by fingerprint.

    Words are lower-cased in A-Z and end at blanks; a fingerprint is taken from all runs
    of ``k`` words of the whole text, repeats included. Two documents are linked when
    their fingerprints differ in at most ``radius`` bits. Reads ``doc_id, text``; returns
    ``doc_id, fingerprint`` (16 hexadecimal digits) and ``component_id``, the least
    ``doc_id`` reachable over links, a row for each row. Other columns are not read.

    Equal fingerprints are folded before BK-trees search for near ones. A text of fewer
    than ``k`` words is one run; an empty or null text has fingerprint zero, which is
    linked like any other. Rows that share an id are each a document of that id. A row
    without an id names no component but takes part; where no row of a component has an
    id its name is null. An empty table gives an empty result.
    """
    signed = stage(fingerprints(docs, k), "signed")
    held = stage(signed.groupBy("number").agg(F.min("doc_id").alias("least")), "numbers")
    links = stage(links_within(held.select("number"), radius), "links")
    groups = stage(connected_components(links).withColumnRenamed("node", "number"), "groups")
    met = held.join(groups, "number").groupBy("component").agg(F.min("least").alias("name"))
    met = groups.join(stage(met, "names"), "component").select("number", "name")
    named = held.join(met, "number", "left")
    # Read back, so that the rows of a hot fingerprint can be split over tasks.
    named = stage(named.select("number", F.coalesce("name", "least").alias("component_id")), "named")
    digits = F.lower(F.lpad(F.hex("number"), 16, "0"))
    return signed.join(named, "number").select(
        "doc_id", digits.alias("fingerprint"), "component_id"
    )
