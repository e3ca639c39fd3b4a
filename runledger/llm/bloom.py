"""A filter of fixed size for the members of a set of 64-bit numbers."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runledger.session import stage

PROBES = (0, 21, 42)


def bloom_bits(df: DataFrame, number: Column, log_bits: int = 22) -> np.ndarray:
    """Bitmap with the bits of every ``number`` set, ``2**log_bits`` bits whatever the input.

    Folded in the map tasks; at most one row per 64 bits comes to the driver.
    """
    mask = (1 << log_bits) - 1
    places = F.explode(
        F.array(*[F.shiftrightunsigned("__n", p).bitwiseAND(F.lit(mask)) for p in PROBES])
    )
    bits = df.select(number.alias("__n")).distinct().select(places.alias("at")).groupBy(F.shiftright("at", 6).alias("word"))
    folded = bits.agg(F.expr("bit_or(shiftleft(1L, int(at & 63)))").alias("b"))
    bitmap = np.zeros(1 << (log_bits - 6), dtype=np.int64)
    table = folded.toPandas()
    bitmap[table["word"].to_numpy(dtype=np.int64)] = table["b"].to_numpy(dtype=np.int64)
    return bitmap.view(np.uint64)


def might_hold(bitmap: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    """Which of ``numbers`` (uint64) may be members; never wrong about a member."""
    mask = np.uint64(len(bitmap) * 64 - 1)
    held = np.ones(len(numbers), dtype=bool)
    for p in PROBES:
        at = (numbers >> np.uint64(p)) & mask
        held &= (bitmap[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) > 0
    return held


def may_be_among(value: Column, members: DataFrame, name: str) -> Column:
    """Whether ``value`` may occur in column ``name`` of ``members``; true for every one that does."""
    bitmap = bloom_bits(members, F.xxhash64(name))
    shared = members.sparkSession.sparkContext.broadcast(bitmap)

    @F.pandas_udf("boolean")
    def held(hashes: pd.Series) -> pd.Series:
        return pd.Series(might_hold(shared.value, hashes.to_numpy(np.int64).view(np.uint64)))

    return held(F.xxhash64(value))


def without_ids(docs: DataFrame, ids: DataFrame, name: str = "doc_id") -> DataFrame:
    """``docs`` without the rows whose ``name`` is in ``ids``; null is never in it.

    Only rows that pass a filter of fixed size are shuffled for the exact anti-join.
    """
    ids = stage(ids.distinct(), "ids")
    suspect = may_be_among(F.col(name), ids, name)
    clear = docs.where(~suspect)
    return clear.union(docs.where(suspect).join(ids, name, "left_anti").select(docs.columns))
