"""SuperMinHash signatures."""

from __future__ import annotations

import numpy as np

from runledger.llm.hashing import U64, constants, mix

_NEVER = U64(0xFFFFFFFFFFFFFFFF)


def superminhash(elements: np.ndarray, m: int) -> np.ndarray:
    """Signature of a set of distinct 64-bit hashes: ``m`` values of level and fraction.

    Every element walks through the ``m`` places in its own random order and brings to
    its j-th place a value in [j, j + 1); a place keeps its least value (Ertl 2017).
    Values rise with the step, so once every place has one the walk can stop: sets much
    larger than ``m`` take one step. All elements step together.
    """
    signature = np.full(m, _NEVER, dtype=U64)
    n = len(elements)
    if not n:
        return signature
    draws, picks = constants(m, 303), constants(m, 404)
    rows = np.arange(n)
    order = None
    for level in range(m):
        value = (mix(elements ^ draws[level]) >> U64(8)) | U64(level << 56)
        spread = ((mix(elements ^ picks[level]) >> U64(32)) * U64(m - level)) >> U64(32)
        pick = spread.astype(np.int64) + level
        if level == 0:
            place = first = pick
        else:
            if order is None:
                order = np.tile(np.arange(m, dtype=np.int32), (n, 1))
                order[rows, first] = 0
                order[:, 0] = first
            place = order[rows, pick]
            order[rows, pick] = order[:, level]
            order[:, level] = place
        np.minimum.at(signature, place, value)
        if signature.max() != _NEVER:
            break
    return signature


def short_signature(signature: np.ndarray) -> bytes:
    """Two bytes of each value, enough to tell values apart."""
    return mix(signature).astype(np.uint16).tobytes()
