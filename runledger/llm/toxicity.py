"""Toxicity by a gap-tolerant subsequence kernel with Nyström landmarks."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runledger.llm.hashing import U64, Powers, chunks, mix
from runledger.llm.signs import sign_codes

_CHUNK = 1 << 19
_LOG_CELLS = 20
_DECAY = 0.5
_LEAST = 0.5
_POWER = 4
# Words outside these lengths are scored but no landmarks.
_SHORTEST, _LONGEST = 3, 24
_GAP, _DROP = 0, 0xFFFF
_MIXERS = (np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D))
# Places of the second and third sign of a subsequence, seen from the first.
_SHAPES = ((1, 2), (1, 3), (2, 3), (1, 4), (2, 4), (3, 4))
ADDED = ("score", "predicted")


def sign_stream(texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Letters of all texts with single gaps between words, and the text of each sign.

    Texts are lower-cased; signs other than letters inside a word are dropped and letters
    standing alone are joined to one word, so spelt-out and broken-up words come whole.
    """
    low = ["\n" + t.lower() + "\n" if t else "\n" for t in texts]
    signs = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    owner = np.repeat(np.arange(len(low)), [len(t) for t in low])
    codes = sign_codes(signs, _GAP, _DROP)
    stays = codes != _DROP
    codes, owner = codes[stays], owner[stays]
    letter = codes != _GAP
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    keep[0] = True
    codes, owner, letter = codes[keep], owner[keep], letter[keep]
    alone = np.zeros(len(codes), dtype=bool)
    alone[1:-1] = letter[1:-1] & ~letter[:-2] & ~letter[2:]
    joins = np.zeros(len(codes), dtype=bool)
    joins[1:-1] = ~letter[1:-1] & alone[:-2] & alone[2:] & (owner[:-2] == owner[2:])
    return codes[~joins], owner[~joins]


def subsequences(codes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
    """Per shape: the cell of the subsequence from each sign, whether it is one, its weight.

    Gaps between words may stand at either end but not inside, so no subsequence crosses
    a word's edge and those at an edge say so.
    """
    first, second, third = (codes.astype(np.uint32) * m for m in _MIXERS)
    inner = codes != _GAP
    whole = inner[1:-1]
    reach = 2
    for a, b in _SHAPES:
        n = max(len(codes) - b, 0)
        if b > reach:
            whole = whole[:n] & inner[b - 1 : b - 1 + n]
            reach = b
        cell = first[:n] + second[a : a + n]
        cell += third[b : b + n]
        cell >>= np.uint32(32 - _LOG_CELLS)
        yield cell, whole[:n], _DECAY ** (b - 2)


def kernel_map(word: str) -> dict[int, float]:
    """Weights of the subsequences of ``word``, in which ``^`` and ``$`` are its edges."""
    signs = np.array([ord(" " if c in "^$" else c) for c in word], dtype=np.uint32)
    out: Counter[int] = Counter()
    for cells, whole, weight in subsequences(sign_codes(signs, _GAP, _DROP)):
        for cell in cells[whole].tolist():
            out[cell] += weight
    return dict(out)


def landmark_candidates(labelled: DataFrame, n: int) -> list[str]:
    """The ``n`` words, edges marked, that tell toxic texts best (G-test)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: dict[str, list[int]] = {}
            for part, texts in chunks(batch, limit=_CHUNK):
                codes, owner = sign_stream(texts)
                toxic = part.column("toxic").to_pylist()
                stops = np.searchsorted(owner, np.arange(len(texts) + 1))
                for i, label in enumerate(toxic):
                    own = codes[stops[i] : stops[i + 1]]
                    words = set("".join(map(chr, own)).split("\0"))
                    for word in words:
                        if _SHORTEST <= len(word) <= _LONGEST:
                            seen.setdefault(f"^{word}$", [0, 0])[label] += 1
            yield pa.record_batch(
                [
                    pa.array(list(seen), pa.string()),
                    pa.array([v[0] for v in seen.values()], pa.int64()),
                    pa.array([v[1] for v in seen.values()], pa.int64()),
                ],
                names=["word", "clean", "toxic"],
            )

    counted = labelled.mapInArrow(count, "word string, clean long, toxic long")
    counted = counted.groupBy("word").agg(F.sum("clean").alias("c"), F.sum("toxic").alias("t"))
    sums = labelled.agg(F.sum("toxic"), F.count("*")).first()
    share = float(sums[0] or 0) / max(sums[1], 1)
    total = F.col("c") + F.col("t")
    gain = F.col("t") * F.log(F.col("t") / (total * share)) + F.when(
        F.col("c") > 0, F.col("c") * F.log(F.col("c") / (total * (1 - share)))
    ).otherwise(0.0)
    told = counted.where((F.col("t") >= 2) & (F.col("t") > total * min(4 * share, 0.6)))
    top = told.orderBy(gain.desc(), "word").limit(n)
    return [r[0] for r in top.select("word").collect()]


def spread_landmarks(candidates: Sequence[str], n: int) -> tuple[list[str], np.ndarray]:
    """Up to ``n`` candidates no two of which are nearly the same, and their kernel matrix."""
    chosen: list[str] = []
    maps: list[dict[int, float]] = []
    rows: list[list[float]] = []
    for word in candidates:
        own = kernel_map(word)
        size = sum(v * v for v in own.values())
        if not size:
            continue
        row = []
        for other in maps:
            both = sum(v * other.get(c, 0.0) for c, v in own.items())
            row.append(both / np.sqrt(size * sum(v * v for v in other.values())))
        if max(row, default=0.0) < 0.95:
            chosen.append(word)
            maps.append(own)
            rows.append(row)
        if len(chosen) == n:
            break
    kernel = np.eye(len(chosen))
    for i, row in enumerate(rows):
        kernel[i, :i] = kernel[:i, i] = row
    return chosen, kernel**_POWER


def words_of(codes: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, ...]:
    """Digest, start, stop and text of every word of a sign stream."""
    inner = np.concatenate([[False], codes != _GAP, [False]])
    start = np.flatnonzero(inner[1:-1] & ~inner[:-2])
    stop = np.flatnonzero(inner[1:-1] & ~inner[2:]) + 1
    Powers.reach(len(codes) + 1)
    signs = mix(codes.astype(U64) + U64(_CHUNK)) * Powers.up[: len(codes)]
    sums = np.concatenate([np.zeros(1, U64), np.cumsum(signs, dtype=U64)])
    return mix((sums[stop] - sums[start]) * Powers.down[start]), start, stop, owner[start]


class LandmarkTable:
    """Which landmarks a subsequence speaks for, and how much, by cell.

    A word's values depend on the word alone, so they are worked out once per word and
    kept, by a 64-bit digest, until ``held`` words are known; then the table starts anew.
    """

    def __init__(self, landmarks: Sequence[str], held: int = 1 << 20) -> None:
        entries = []
        for j, word in enumerate(landmarks):
            own = kernel_map(word)
            size = sum(v * v for v in own.values())
            entries += [(cell, j, v / size) for cell, v in own.items()]
        entries.sort()
        cells = np.array([e[0] for e in entries], dtype=np.int64)
        self.n = len(landmarks)
        self.mark = np.array([e[1] for e in entries], dtype=np.int64)
        self.weight = np.array([e[2] for e in entries])
        self.start = np.searchsorted(cells, np.arange((1 << _LOG_CELLS) + 1)).astype(np.int32)
        self.most = np.zeros(1 << _LOG_CELLS, dtype=np.float32)
        np.maximum.at(self.most, cells, self.weight.astype(np.float32))
        self.met = self.most > 0
        self.held = held
        self._forget()

    def _forget(self) -> None:
        self.known = np.zeros(0, dtype=U64)
        # Where the values of a word begin and end; words without values have an empty range.
        self.spans = np.zeros((0, 2), dtype=np.int64)
        self.marks = np.zeros(0, dtype=np.int32)
        self.values = np.zeros(0, dtype=np.float64)

    def _compared(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Word (by its place), landmark and kernel value of at least a half, sorted.

        ``codes`` are words with single gaps around them. A word's mass, what its
        subsequences give any landmark at most, bounds its values; only words that can
        reach a half are compared with single landmarks.
        """
        word = np.cumsum(codes == _GAP, dtype=np.int32) - 1
        found = []
        for cell, whole, weight in subsequences(codes):
            cell = cell.astype(np.intp)
            at = np.flatnonzero(np.take(self.met, cell) & whole)
            found.append((word[at + 1], cell[at], np.full(len(at), weight, dtype=np.float32)))
        inside, cell, weight = (np.concatenate(x) for x in zip(*found, strict=True))
        n_words = int(word[-1]) + 1
        able = np.bincount(inside, self.most[cell] * weight, n_words) >= _LEAST
        words = np.flatnonzero(able)
        place = np.zeros(n_words, dtype=np.int64)
        place[words] = np.arange(len(words))
        kept = np.flatnonzero(able[inside])
        inside, cell, weight = place[inside[kept]], cell[kept], weight[kept]
        first = self.start[cell]
        number = self.start[cell + 1] - first
        row = np.repeat(np.arange(len(cell)), number)
        entry = np.arange(len(row)) - np.repeat(np.cumsum(number) - number - first, number)
        spot = inside[row] * self.n + self.mark[entry]
        values = np.bincount(spot, self.weight[entry] * weight[row], len(words) * self.n)
        strong = np.flatnonzero(values >= _LEAST)
        return words[strong // self.n], strong % self.n, np.minimum(values[strong], 1.0)

    def _learn(self, names: np.ndarray, codes: np.ndarray, start: np.ndarray, stop: np.ndarray) -> None:
        """Work out the values of new words, given sorted by digest."""
        sizes = stop - start + 1
        ends = np.cumsum(sizes)
        stream = np.full(int(ends[-1]) + 1, _GAP, dtype=codes.dtype)
        letters = sizes - 1
        at = np.arange(letters.sum()) - np.repeat(np.cumsum(letters) - letters, letters)
        stream[np.repeat(ends - letters, letters) + at] = codes[np.repeat(start, letters) + at]
        word, mark, value = self._compared(stream)
        spans = len(self.marks) + np.searchsorted(word, np.stack([np.arange(len(names)), np.arange(len(names)) + 1], axis=1))
        self.marks = np.concatenate([self.marks, mark.astype(np.int32)])
        self.values = np.concatenate([self.values, value**_POWER])
        places = np.searchsorted(self.known, names)
        self.known = np.insert(self.known, places, names)
        self.spans = np.insert(self.spans, places, spans, axis=0)

    def _find(self, names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self.known, names)
        at[at == len(self.known)] = 0
        return at, (self.known[at] == names) if len(self.known) else np.zeros(len(names), dtype=bool)

    def nearest(self, texts: Sequence[str | None]) -> np.ndarray:
        """Fourth power of the largest kernel value of a text's words with each landmark.

        Values below a half count as 0.
        """
        out = np.zeros((len(texts), self.n))
        codes, owner = sign_stream(texts)
        names, start, stop, text = words_of(codes, owner)
        if not len(names):
            return out
        different, first, inverse = np.unique(names, return_index=True, return_inverse=True)
        if len(self.known) + len(different) > self.held:
            self._forget()
        new = first[~self._find(different)[1]]
        if len(new):
            self._learn(names[new], codes, start[new], stop[new])
        spans = self.spans[self._find(different)[0]]
        valued = np.flatnonzero((spans[:, 1] > spans[:, 0])[inverse])
        # Each word that has values once per text.
        pairs = np.unique(text[valued] * len(different) + inverse[valued])
        begin, end = spans[pairs % len(different)].T
        number = end - begin
        entry = np.arange(number.sum()) - np.repeat(np.cumsum(number) - number - begin, number)
        row = np.repeat(pairs // len(different), number)
        np.maximum.at(out.reshape(-1), row * self.n + self.marks[entry], self.values[entry])
        return out


def _words_of_landmarks(docs: DataFrame, landmarks: Sequence[str]) -> DataFrame:
    """``docs`` with ``nearest``, the values of their landmarks."""
    held: dict[str, LandmarkTable] = {}

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = held.setdefault("table", LandmarkTable(landmarks))
        for batch in batches:
            for part, texts in chunks(batch, limit=_CHUNK):
                near = table.nearest(texts).tolist()
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(near, pa.list_(pa.float64()))],
                    names=[*part.schema.names, "nearest"],
                )

    added = T.StructField("nearest", T.ArrayType(T.DoubleType()))
    return docs.mapInArrow(compare, T.StructType([*docs.schema.fields, added]))


def fit_svm(x: np.ndarray, y: np.ndarray, penalty: float = 1.0) -> tuple[np.ndarray, float]:
    """Linear support vector machine with squared hinge loss, by Newton steps."""
    ones = np.hstack([x, np.ones((len(x), 1))])
    sign = np.where(y > 0, 1.0, -1.0)
    share = np.where(y > 0, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9))
    w = np.zeros(ones.shape[1])
    ridge = np.full(len(w), 1.0 / penalty)
    ridge[-1] = 1e-6
    for _ in range(50):
        margin = sign * (ones @ w)
        wrong = margin < 1
        own = ones[wrong]
        slope = ridge * w - own.T @ (share[wrong] * sign[wrong] * (1 - margin[wrong]))
        bend = np.diag(ridge) + (own * share[wrong, None]).T @ own
        step = np.linalg.solve(bend, slope)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return w[:-1], float(w[-1])


def fit_odds(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset that turn margins into probabilities."""
    a, b = 1.0, 0.0
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))
        q = np.maximum(p * (1 - p), 1e-6)
        slope = np.array([((p - y) * margin).sum() + 1e-3 * a, (p - y).sum()])
        bend = np.array([[(q * margin**2).sum() + 1e-3, (q * margin).sum()], [(q * margin).sum(), q.sum()]])
        step = np.linalg.solve(bend + 1e-9 * np.eye(2), slope)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return float(a), float(b)


def trained_on(name: str = "doc_id") -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col(name).cast("string")), F.lit(3)) != 1, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, most: int) -> DataFrame:
    """Texts and labels of about ``most`` labelled documents of the training fold.

    Chosen by the id's digest, all of them where there are fewer; only their labels, a
    bounded number, are sent to the scan of the texts.
    """
    known = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").where(trained_on())
    known = known.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    share = min(1.0, most / max(known.count(), 1))
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(share * (1 << 20))
    chosen = known.where(place)
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "toxic")


def score_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    landmarks: int = 256,
    most: int = 8000,
    cut: float = 0.7,
) -> DataFrame:
    """``docs`` with ``score`` (0 to 1, higher: likelier toxic) and ``predicted``.

    Reads ``doc_id, text`` of ``docs`` and ``doc_id, toxic`` of ``labels``; input columns
    of the added names are replaced, others kept. A text is its words; words are compared
    by subsequences of three signs that span at most five, each missing sign halving the
    weight, so gapped and padded spellings stay near the plain one, and values are raised
    to the fourth power. Landmarks are the words that tell toxic training texts best; a
    text is represented by the largest value any of its words reaches with each landmark,
    whitened by the landmarks' own kernel matrix, and scored by a support vector machine whose margins are turned
    into probabilities.

    Fitted on about ``most`` labelled documents of the training fold, whole texts, in the
    driver; every text is scored. Null and empty texts score as texts that meet no
    landmark. Without labels of both kinds all scores are the share of toxic ones (one
    half without any label). Repeated labels of a document count once, toxic if any is.
    """
    kept = docs.drop(*ADDED)
    sample = labelled_sample(docs, labels, most).persist()
    sums = sample.agg(F.coalesce(F.sum("toxic"), F.lit(0)), F.count("*")).first()
    words: list[str] = []
    if 0 < sums[0] < sums[1]:
        words, kernel = spread_landmarks(landmark_candidates(sample, 6 * landmarks), landmarks)
    if not words:
        sample.unpersist()
        prior = (sums[0] + 1) / (sums[1] + 2)
        flat = kept.withColumn("score", F.lit(prior))
        return flat.withColumn("predicted", (F.col("score") >= cut).cast("int"))
    near = _words_of_landmarks(sample, words).select("toxic", "nearest").toPandas()
    sample.unpersist()
    x = np.array(near["nearest"].tolist(), dtype=float)
    y = near["toxic"].to_numpy(dtype=float)
    values, vectors = np.linalg.eigh(kernel)
    white = vectors @ np.diag(1 / np.sqrt(np.maximum(values, 1e-3))) @ vectors.T
    weight, offset = fit_svm(x @ white, y)
    slope, shift = fit_odds(x @ white @ weight + offset, y)
    linear = slope * (white @ weight)
    constant = slope * offset + shift
    held: dict[str, LandmarkTable] = {}

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = held.setdefault("table", LandmarkTable(words))
        for batch in batches:
            for part, texts in chunks(batch, limit=_CHUNK):
                margin = np.clip(table.nearest(texts) @ linear + constant, -30, 30)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(1 / (1 + np.exp(-margin)))],
                    names=[*part.schema.names, "score"],
                )

    added = T.StructField("score", T.DoubleType())
    scored = kept.mapInArrow(score, T.StructType([*kept.schema.fields, added]))
    return scored.withColumn("predicted", (F.col("score") >= cut).cast("int"))
