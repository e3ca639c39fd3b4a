"""Vectors of one length bucket under sorted coordinate lists."""

from __future__ import annotations

import numpy as np

_EXACT = 2**53
_SLACK = 1e-9


class CoordinateLists:
    """A bucket of whole-number vectors, each coordinate's values sorted.

    ``reaching`` finds the rows whose inner product with a query is at least a bound. The
    bound, over the lengths of query and longest row, bounds the angle between them, and
    an angle to the query bounds the angle to each axis: so every coordinate of a row that
    qualifies lies in a range around the query's own. Rows in the ranges of all focus
    coordinates, the query's largest, are multiplied out.
    """

    def __init__(self, matrix: np.ndarray, focus: int = 4) -> None:
        self.matrix = matrix
        self.exact = matrix.astype(np.float64)
        self.most = float(np.abs(self.exact).max(initial=0.0))
        lengths = np.sqrt((self.exact**2).sum(axis=1))
        self.longest = float(lengths.max(initial=0.0))
        unit = self.exact / np.where(lengths > 0, lengths, 1.0)[:, None]
        self.order = np.argsort(unit, axis=0, kind="stable").T.copy()
        self.values = np.take_along_axis(unit, self.order.T, axis=0).T.copy()
        self.focus = min(focus, matrix.shape[1])

    def candidates(self, query: np.ndarray, bound: float) -> np.ndarray:
        """Rows in all feasible ranges, ascending; all rows where the bound is not above 0."""
        n = len(self.matrix)
        if bound <= 0:
            return np.arange(n)
        length = float(np.sqrt((query.astype(np.float64) ** 2).sum()))
        if length * self.longest <= 0:
            return np.zeros(0, dtype=np.int64)
        cosine = bound / (length * self.longest)
        if cosine > 1 + _SLACK:
            return np.zeros(0, dtype=np.int64)
        widest = np.arccos(min(cosine, 1.0)) + _SLACK
        own = np.clip(query / length, -1.0, 1.0)
        met = np.zeros(n, dtype=np.int16)
        for axis in np.argsort(-np.abs(own), kind="stable")[: self.focus]:
            angle = np.arccos(own[axis])
            low = np.cos(min(np.pi, angle + widest)) - _SLACK
            high = np.cos(max(0.0, angle - widest)) + _SLACK
            start = np.searchsorted(self.values[axis], low, side="left")
            stop = np.searchsorted(self.values[axis], high, side="right")
            met[self.order[axis, start:stop]] += 1
        return np.flatnonzero(met == self.focus)

    def reaching(self, query: np.ndarray, bound: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows with an inner product of at least ``bound``, and the exact products."""
        rows = self.candidates(query, float(bound))
        top = float(np.abs(query.astype(np.float64)).max(initial=0.0))
        if self.most * top * len(query) < _EXACT:
            scores = (self.exact[rows] @ query.astype(np.float64)).astype(np.int64)
        else:
            scores = self.matrix[rows] @ query
        enough = scores >= bound
        return rows[enough], scores[enough]
