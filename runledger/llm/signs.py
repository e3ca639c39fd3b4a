"""Codes of signs, inside Spark tasks."""

from __future__ import annotations

import numpy as np

_PLANE = 1 << 16
_MARK = _PLANE - 1


def _code(sign: int, space: int, other: int) -> int:
    letter = chr(sign)
    if letter.isalpha():
        folded = sign & 0x7FFF | 1 if sign >= _PLANE - 2 else sign
        return folded
    return space if letter.isspace() else other


class _Plane:
    """Codes of the first 65,536 signs, made once per task and kind."""

    tables: dict[tuple[int, int], np.ndarray] = {}


def sign_codes(signs: np.ndarray, space: int, other: int) -> np.ndarray:
    """16-bit codes of code points: letters nearly themselves, ``space`` and ``other`` else."""
    table = _Plane.tables.get((space, other))
    if table is None:
        made = (_code(c, space, other) for c in range(_PLANE))
        table = _Plane.tables[space, other] = np.fromiter(made, np.uint16, _PLANE)
    codes = table[np.minimum(signs, _MARK)]
    far = signs >= _PLANE
    if far.any():
        names, back = np.unique(signs[far], return_inverse=True)
        own = np.array([_code(int(c), space, other) for c in names], dtype=np.uint16)
        codes[far] = own[back]
    return codes
