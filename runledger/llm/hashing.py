"""Word and shingle hashes of many texts at once, inside Spark tasks."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa

U64 = np.uint64
_CHUNK = 1 << 19
_GOLDEN = U64(0x9E3779B97F4A7C15)
_BASE = 0x2545F4914F6CDD1D
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit numbers over the whole range, one to one."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def constants(n: int, seed: int) -> np.ndarray:
    """``n`` odd numbers without a pattern."""
    return mix(np.arange(1, n + 1, dtype=U64) * _GOLDEN + U64(seed)) | U64(1)


_SIGNS = constants(256, 101)
_PLACES = constants(64, 202)


class Powers:
    """Powers of the base and of its inverse, grown on demand."""

    up = np.ones(1, dtype=U64)
    down = np.ones(1, dtype=U64)

    @classmethod
    def reach(cls, n: int) -> None:
        if len(cls.up) < n:
            n = 1 << (n - 1).bit_length()
            for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
                steps = np.full(n, base, dtype=U64)
                steps[0] = 1
                setattr(cls, name, np.multiply.accumulate(steps))


def chunks(
    batch: pa.RecordBatch, text: str = "text", limit: int = _CHUNK
) -> Iterator[tuple[pa.RecordBatch, list]]:
    """Runs of rows whose texts together stay near ``limit`` bytes, with those texts."""
    column = batch.column(text)
    sizes = np.cumsum(
        np.asarray(pa.compute.binary_length(column).fill_null(0), dtype=np.int64), dtype=np.int64
    )
    start = 0
    while start < batch.num_rows:
        done = sizes[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(sizes, done + limit, side="right")))
        part = batch.slice(start, stop - start)
        yield part, part.column(text).to_pylist()
        start = stop


def word_hashes(texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and the number of words of each text.

    Words are runs of signs other than space and U+0009 to U+000D; A-Z count as a-z. A
    word's hash is a polynomial of its bytes, taken from running sums over all texts.
    """
    blobs = [b"" if t is None else t.encode("utf-8", "surrogatepass").lower() for t in texts]
    data = np.frombuffer(b" ".join(blobs) + b" ", dtype=np.uint8)
    sizes = np.fromiter((len(b) + 1 for b in blobs), dtype=np.int64, count=len(blobs))
    gap = _BLANK[data]
    before = np.concatenate([[True], gap[:-1]])
    begin = np.flatnonzero(before & ~gap)
    end = np.flatnonzero(gap & ~before)
    Powers.reach(len(data))
    sums = np.concatenate(
        [np.zeros(1, U64), np.cumsum(_SIGNS[data] * Powers.up[: len(data)], dtype=U64)]
    )
    words = mix((sums[end] - sums[begin]) * Powers.down[begin])
    upto = np.searchsorted(begin, np.cumsum(sizes))
    return words, np.diff(upto, prepend=0)


def shingle_hashes(texts: Sequence[str | None], k: int) -> list[np.ndarray]:
    """Hashes of each text's runs of ``k`` words, in order and with repeats.

    A text of fewer words has its whole sequence as one shingle, one without words none.
    """
    words, counts = word_hashes(texts)
    runs = np.zeros(max(len(words) - k + 1, 0), dtype=U64)
    for j in range(k):
        runs += words[j : j + len(runs)] * _PLACES[j]
    runs = mix(runs)
    out, at = [], 0
    for n in counts.tolist():
        if n >= k:
            out.append(runs[at : at + n - k + 1])
        elif n:
            own = words[at : at + n] * _PLACES[:n]
            out.append(mix(own.sum(dtype=U64, keepdims=True) + _PLACES[-n:][:1]))
        else:
            out.append(np.zeros(0, dtype=U64))
        at += n
    return out


def short_run_hashes(texts: Sequence[str | None], n: int) -> list[np.ndarray]:
    """Hashes of each text's runs of ``n`` words, as ``shingle_hashes`` has texts of just ``n`` words."""
    words, counts = word_hashes(texts)
    runs = np.full(max(len(words) - n + 1, 0), _PLACES[-n], dtype=U64)
    for j in range(n):
        runs += words[j : j + len(runs)] * _PLACES[j]
    runs = mix(runs)
    ends = np.cumsum(counts)
    return [runs[max(e - c, 0) : max(e - n + 1, e - c)] for e, c in zip(ends.tolist(), counts.tolist(), strict=True)]


def set_digest(distinct: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for a set of hashes, as two signed numbers."""
    one = mix(distinct ^ U64(0x5851F42D4C957F2D)).sum(dtype=U64)
    two = mix(mix(distinct) + _GOLDEN).sum(dtype=U64)
    return int(one.astype(np.int64)), int(two.astype(np.int64))
