"""Approximate nearest neighbours by a permutation index."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from runledger.session import stage


def usable_vectors(df: DataFrame) -> DataFrame:
    """``(vec_id, vector)`` of the rows that take part, one per id.

    Left out are rows without id, vectors that are null, empty, all zero or hold a null or
    non-finite component, and those whose length is not the commonest one. Of several
    rows with one id the least vector stands.
    """
    cast = df.select(
        F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("vector")
    )
    sound = F.expr(
        "vec_id IS NOT NULL AND size(vector) > 0"
        " AND forall(vector, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity'))"
        " AND exists(vector, x -> x <> 0)"
    )
    sound_rows = cast.where(sound)
    sizes = sound_rows.groupBy(F.size("vector").alias("n")).agg(F.count("*").alias("rows"))
    common = sizes.orderBy(F.desc("rows"), "n").first()
    own = sound_rows.where(F.size("vector") == (common["n"] if common else 0))
    return own.groupBy("vec_id").agg(F.min("vector").alias("vector"))


def choose_pivots(vectors: DataFrame, n: int) -> np.ndarray:
    """Up to ``n`` different vectors, the first of a fixed sample of ``8 n`` by the id's digest."""
    sample = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(8 * n).collect()
    different = list(dict.fromkeys(tuple(r["vector"]) for r in sample))[:n]
    return np.array(different, dtype=np.float64) if different else np.zeros((0, 0))


def greatest_length(vectors: DataFrame) -> tuple[float, float]:
    """Greatest component, and greatest length when all are divided by it; no square overflows."""
    top = vectors.agg(F.max(F.array_max(F.transform("vector", F.abs)))).first()[0] or 1.0
    squares = F.aggregate("vector", F.lit(0.0), lambda s, x: s + (x / top) * (x / top))
    return top, float(np.sqrt(vectors.agg(F.max(squares)).first()[0] or 1.0))


def lifted(matrix: np.ndarray, reach: tuple[float, float]) -> np.ndarray:
    """Vectors with one more component, which gives all of them the same length.

    The inner product with a query that has 0 there is as before, so among lifted vectors
    the largest product is the smallest angle (Bachrach et al. 2014).
    """
    short = matrix / reach[0] / reach[1]
    rest = np.maximum(1.0 - (short * short).sum(axis=1, keepdims=True), 0.0)
    return np.hstack([short, np.sqrt(rest)])


def _scaled(matrix: np.ndarray) -> np.ndarray:
    top = np.abs(matrix).max(axis=1, keepdims=True, initial=0.0)
    matrix = matrix / np.where(top > 0, top, 1.0)
    length = np.sqrt((matrix * matrix).sum(axis=1, keepdims=True))
    return matrix / np.where(length > 0, length, 1.0)


def _matrix(table: pa.Table, dim: int) -> tuple[np.ndarray, np.ndarray]:
    ids = table.column("vec_id").to_numpy()
    order = np.argsort(ids, kind="stable")
    column = table.column("vector").combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
    return ids[order], flat[order]


class PivotLists:
    """Inverted files of one block of unit vectors: under each pivot those that rank it high."""

    def __init__(self, matrix: np.ndarray, pivots: np.ndarray, depth: int) -> None:
        near = np.argsort(-(matrix @ pivots.T), axis=1, kind="stable")[:, :depth]
        pivot = near.ravel()
        order = np.argsort(pivot, kind="stable")
        self.rows = np.repeat(np.arange(len(near)), near.shape[1])[order]
        self.places = np.tile(np.arange(near.shape[1]), len(near))[order]
        self.ends = np.searchsorted(pivot[order], np.arange(len(pivots) + 1))
        self.depth, self.n = near.shape[1], len(matrix)

    def footrule(self, ranked: np.ndarray) -> np.ndarray:
        """Distance of every vector's order of pivots from ``ranked``; absent counts as last."""
        far = np.full(self.n, int(np.abs(np.arange(len(ranked)) - self.depth).sum()))
        for place, pivot in enumerate(ranked.tolist()):
            post = slice(self.ends[pivot], self.ends[pivot + 1])
            far[self.rows[post]] += np.abs(self.places[post] - place) - abs(place - self.depth)
        return far


def nearest_neighbours(
    vectors: DataFrame,
    is_query: Column,
    k: int = 20,
    n_pivots: int = 128,
    depth: int = 64,
    probes: int = 32,
    share: float = 0.35,
    block: int = 4096,
) -> DataFrame:
    """The ``k`` vectors of largest inner product found for each query: exact scores.

    Reads ``vec_id, embedding`` (an array of numbers); ``is_query`` is a condition on
    ``vec_id``. Returns ``query_id, rank`` (from 1), ``vec_id, score``; equal scores go by
    ``vec_id``; a query is no neighbour of itself. Other columns are not read, and
    ``usable_vectors`` says which rows take part; none gives an empty result.

    A vector is represented by its ``depth`` nearest pivots in order. For that, vectors and
    pivots are lifted to equal lengths, so that nearness by angle is nearness by inner
    product whatever lengths they have. Vectors and queries
    are dealt into blocks of about ``block`` rows which meet in pairs, so a task holds two
    blocks. There the vectors are posted under their pivots, the lists of a query's first
    ``probes`` pivots give footrule distances, and the nearest ``share`` of the block, at
    least ``4 k``, is ranked again by inner product in double precision. Every row is
    indexed; no list is cut. ``share`` sets recall: see the README for measured values.
    """
    usable = stage(usable_vectors(vectors), "vectors")
    queries = usable.where(is_query)
    n, n_queries = usable.count(), queries.count()
    pivots, reach = choose_pivots(usable, n_pivots), greatest_length(usable)
    dim = pivots.shape[1]
    pivots = lifted(pivots, reach)
    v_blocks, q_blocks = max(1, -(-n // block)), max(1, -(-n_queries // block))

    def dealt(df: DataFrame, own: str, blocks: int, other: str, others: int) -> DataFrame:
        number = F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias(own)
        every = F.explode(F.sequence(F.lit(0), F.lit(others - 1))).alias(other)
        return df.select(number, every, "vec_id", "vector")

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        q_ids, q_matrix = _matrix(left, dim)
        ids, matrix = _matrix(right, dim)
        out: list[tuple[np.ndarray, np.ndarray]] = []
        names: list[np.ndarray] = []
        if len(q_ids) and len(ids):
            lists = PivotLists(lifted(matrix, reach), pivots, depth)
            flat = np.hstack([_scaled(q_matrix), np.zeros((len(q_matrix), 1))])
            ranked = np.argsort(-(flat @ pivots.T), axis=1, kind="stable")
            keep = min(len(ids), max(int(np.ceil(share * len(ids))), 4 * k))
            for name, vector, order in zip(q_ids, q_matrix, ranked[:, :probes], strict=True):
                short = np.argsort(lists.footrule(order), kind="stable")[:keep]
                short = np.sort(short[ids[short] != name])
                scores = (matrix[short] * vector).sum(axis=1)
                best = np.argsort(-scores, kind="stable")[:k]
                out.append((ids[short[best]], scores[best]))
                names.append(np.full(len(best), name))
        empty = [np.zeros(0, np.int64)]
        found = np.concatenate([o[0] for o in out] or empty)
        scores = np.concatenate([o[1] for o in out] or [np.zeros(0)])
        return pa.table(
            {
                "query_id": pa.array(np.concatenate(names or empty), pa.int64()),
                "vec_id": pa.array(found, pa.int64()),
                "score": pa.array(scores, pa.float64()),
            }
        )

    left = dealt(queries, "q_block", q_blocks, "v_block", v_blocks)
    right = dealt(usable, "v_block", v_blocks, "q_block", q_blocks)
    met = left.groupBy("v_block", "q_block").cogroup(right.groupBy("v_block", "q_block"))
    found = met.applyInArrow(search, "query_id long, vec_id long, score double")
    place = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    best = found.withColumn("rank", place).where(F.col("rank") <= k)
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
