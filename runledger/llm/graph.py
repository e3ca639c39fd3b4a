"""Connected components of a graph that no task holds whole."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runledger.session import stage

_EDGE = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find over one partition's edges; each node once, with its root."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while parent.setdefault(top, top) != top:
            top = parent[top]
        while parent[x] != top:
            parent[x], x = top, parent[x]
        return top

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = root(a), root(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
    nodes = [x for x in parent if root(x) != x]
    roots = [root(x) for x in nodes]
    for at in range(0, len(nodes), 100_000):
        part = slice(at, at + 100_000)
        yield pa.record_batch([pa.array(roots[part], pa.int64()), pa.array(nodes[part], pa.int64())], schema=_EDGE)


def _stars(edges: DataFrame) -> DataFrame:
    """One large and one small star step: neighbours move to the least node they know."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
    large = both.join(least, "a").where("b > a").select(F.col("low").alias("a"), "b")
    large = stage(large.where("a < b").distinct(), "stars")
    least = large.groupBy("b").agg(F.min("a").alias("low"))
    moved = large.join(least, "b")
    small = moved.select(F.col("low").alias("a"), F.col("a").alias("b")).union(
        moved.select(F.col("low").alias("a"), "b")
    )
    return stage(small.where("a < b").distinct(), "stars")


def connected_components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` for every node of ``edges(a, b)``; the least node names it.

    Union-find shrinks each partition's edges to a forest, then star steps join the
    forests until nothing moves (Kiveris et al. 2014), a number of rounds that grows with
    the logarithm of the graph. Least neighbours fold in the map tasks, edges meet them
    in joins whose hot nodes can be split. Every round is written to the shared folder.
    """
    pairs = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    forest = pairs.where("a < b").mapInArrow(_forest, "a long, b long")
    now, seen = stage(forest.distinct(), "stars"), None
    while True:
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(state) == seen or not state[0]:
            break
        now, seen = _stars(now), tuple(state)
    members = now.select(F.col("b").alias("node"), F.col("a").alias("component"))
    roots = now.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct()
    return members.union(roots)
