"""BK-trees over 64-bit fingerprints, built shard by shard."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runledger.session import stage

BITS = 64
_LEVELS = 3
_EDGES = "a long, b long"


class BkTree:
    """Numbers by Hamming distance.

    A node is ``(number, children)``; its child at distance ``d`` is the root of all
    numbers below it that differ from it in ``d`` bits.
    """

    def __init__(self) -> None:
        self.root: tuple[int, dict] | None = None

    def add(self, number: int) -> None:
        if self.root is None:
            self.root = (number, {})
            return
        value, children = self.root
        while distance := (value ^ number).bit_count():
            child = children.get(distance)
            if child is None:
                children[distance] = (number, {})
                return
            value, children = child

    def within(self, number: int, radius: int) -> list[int]:
        """Numbers that differ from ``number`` in at most ``radius`` bits.

        By the triangle inequality only children whose distance from their parent is
        within ``radius`` of the parent's own distance can hold one.
        """
        found = []
        still = [self.root] if self.root else []
        while still:
            value, children = still.pop()
            distance = (value ^ number).bit_count()
            if distance <= radius:
                found.append(value)
            for edge in range(max(distance - radius, 1), distance + radius + 1):
                if edge in children:
                    still.append(children[edge])
        return found


def _unsigned(numbers: list[int]) -> list[int]:
    return [n & 0xFFFFFFFFFFFFFFFF for n in numbers]


def _signed(number: int) -> int:
    return number - (1 << 64) if number >> 63 else number


def shard_links(members: list[int], queries: list[int], radius: int) -> list[tuple[int, int]]:
    """A forest that joins what links within ``radius`` join, of members to members and queries.

    Only links between different components are returned, so a shard of m numbers gives
    fewer than m of them however many lie close together.
    """
    parent: dict[int, int] = {}

    def top(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    tree = BkTree()
    links = []

    def meet(number: int) -> None:
        for other in tree.within(number, radius):
            a, b = top(number), top(other)
            if a != b:
                parent[a] = b
                links.append((number, other))

    for number in members:
        meet(number)
        tree.add(number)
    for number in queries:
        meet(number)
    return links


def _search(radius: int):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            links = []
            columns = (batch.column(c).to_pylist() for c in ("members", "queries"))
            for members, queries in zip(*columns, strict=True):
                links += shard_links(_unsigned(members), _unsigned(queries), radius)
            yield pa.record_batch(
                [pa.array([_signed(link[i]) for link in links], pa.int64()) for i in (0, 1)],
                names=["a", "b"],
            )

    return search


def _pieces(width: int, radius: int) -> Column:
    """``radius + 1`` pieces of the ``width`` bits in ``rest``: shard, and the bits beside the piece.

    Numbers within ``radius`` agree on one of them at least. A shard's number is a
    digest; shards that fall together only share a tree.
    """
    size = width // (radius + 1)
    rest = F.col("rest")
    pieces = []
    for i in range(radius + 1):
        low = i * size
        piece = F.shiftrightunsigned(rest, low).bitwiseAND(F.lit((1 << size) - 1))
        below = rest.bitwiseAND(F.lit((1 << low) - 1))
        above = F.shiftrightunsigned(rest, low + size)
        pieces.append(
            F.struct(
                F.xxhash64("shard", F.lit(i), piece).alias("shard"),
                F.shiftleft(above, low).bitwiseOR(below).alias("rest"),
            )
        )
    return F.explode(F.array(*pieces)).alias("piece")


def _trees(shards: DataFrame, keys: list[str]) -> DataFrame:
    """One row per shard with the numbers of its tree and those that only search it."""
    lists = shards.groupBy(*keys).agg(
        F.collect_list(F.when(F.col("posted"), F.col("number"))).alias("members"),
        F.collect_list(F.when(~F.col("posted"), F.col("number"))).alias("queries"),
    )
    return lists.where("size(members) + size(queries) > 1").select("members", "queries")


def links_within(numbers: DataFrame, radius: int = 3, limit: int = 1024) -> DataFrame:
    """Links ``(a, b)`` that connect every two of ``numbers(number)`` within ``radius`` bits.

    ``numbers`` are distinct 64-bit numbers, none null. They are dealt into shards by the
    value of one of ``radius + 1`` pieces of their bits, on which two of a link agree;
    each shard's BK-tree is built in the task where its numbers are and searched with
    them. A shard of more than ``limit`` numbers is dealt again by pieces of its
    remaining bits; after three such levels, which leave at most 27 free bits at radius 3,
    what is still larger is cut into parts of ``limit`` that meet in pairs, one as a tree and one as
    its queries. So a task holds at most ``2 limit`` numbers of a shard, no link is lost,
    and of the links inside a shard only a spanning forest comes out.
    """
    dealt = numbers.select("number", F.lit(0).alias("shard"), F.col("number").alias("rest"))
    width, found = BITS, []
    for _ in range(_LEVELS):
        dealt = dealt.select("number", _pieces(width, radius)).select("number", "piece.*")
        dealt = stage(dealt, "shards")
        width -= width // (radius + 1)
        sizes = dealt.groupBy("shard").agg(F.count("*").alias("n")).where("n > 1")
        sizes = stage(sizes, "sizes")
        small = dealt.join(sizes.where(F.col("n") <= limit), "shard", "left_semi")
        found.append(_trees(small.withColumn("posted", F.lit(True)), ["shard"]))
        large = sizes.where(F.col("n") > limit)
        dealt = dealt.join(large, "shard")
        if large.limit(1).count() == 0:
            break
    else:
        parts = F.ceil(F.col("n") / limit).cast("int")
        own = F.pmod(F.xxhash64("number"), parts).cast("int")
        cut = dealt.select("shard", "number", own.alias("own"), parts.alias("parts"))
        met = cut.withColumn("other", F.explode(F.expr("sequence(0, parts - 1)")))
        met = met.select(
            "shard",
            "number",
            F.least("own", "other").alias("i"),
            F.greatest("own", "other").alias("j"),
            (F.col("own") <= F.col("other")).alias("posted"),
        )
        found.append(_trees(met, ["shard", "i", "j"]))
    links = found[0]
    for more in found[1:]:
        links = links.unionByName(more)
    return links.mapInArrow(_search(radius), _EDGES).distinct()
