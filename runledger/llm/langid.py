"""Language identification by interpolated Kneser-Ney character models."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runledger.llm.hashing import U64, chunks, mix
from runledger.llm.signs import sign_codes
from runledger.session import stage

ORDER = 4
SIGN_BITS = 16
UNDETERMINED = "und"
_GAP = 0
_CHUNK = 1 << 18
_FLUSH = 1 << 21
_ALPHABET = float(1 << SIGN_BITS)
ADDED = ("lang_pred", "score", "cross_entropy", "n_signs", "rejected")


def grams(texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Every run of four signs, packed in 64 bits, with their number and the letters per text.

    Texts are lower-cased; whatever is no letter counts as one gap between words. A text
    starts after three gaps and ends in one. A text without letters has no run.
    """
    low = ["\n" + t.lower() + "\n" if t else "\n" for t in texts]
    signs = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    sizes = np.fromiter((len(t) for t in low), np.int64, len(low))
    codes = sign_codes(signs, _GAP, _GAP)
    letter = codes != 0
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    starts = np.cumsum(sizes) - sizes
    keep[starts] = True
    owner = np.repeat(np.arange(len(low)), sizes)
    letters = np.bincount(owner[letter], minlength=len(low))
    kept_owner = owner[keep]
    kept = np.bincount(kept_owner, minlength=len(low))
    padded = np.zeros(len(kept_owner) + 2 * len(low), dtype=U64)
    padded[np.arange(len(kept_owner)) + 2 * (kept_owner + 1)] = codes[keep]
    packed = padded[: max(len(padded) - 3, 0)].copy()
    for j in range(1, ORDER):
        packed <<= U64(SIGN_BITS)
        packed |= padded[j : j + len(packed)]
    numbers = kept - 1
    at = np.cumsum(kept + 2) - (kept + 2)
    real = np.repeat(at, numbers) + np.arange(numbers.sum()) - np.repeat(
        np.cumsum(numbers) - numbers, numbers
    )
    return packed[real], numbers, letters


def _folded(found: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    names = np.concatenate([f[0] for f in found])
    counts = np.concatenate([f[1] for f in found])
    order = np.argsort(names, kind="stable")
    names, counts = names[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], names[1:] != names[:-1]]))
    return names[first], np.add.reduceat(counts, first)


def count_grams(labelled: DataFrame) -> DataFrame:
    """``(lang, gram, n)`` over all of ``labelled(lang, text)``, folded in the map tasks."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}

        def emit() -> Iterator[pa.RecordBatch]:
            for lang, found in held.items():
                names, counts = _folded(found)
                yield pa.record_batch(
                    [
                        pa.array([lang] * len(names), pa.string()),
                        pa.array(names.view(np.int64)),
                        pa.array(counts.astype(np.int64)),
                    ],
                    names=["lang", "gram", "n"],
                )
            held.clear()

        for batch in batches:
            for part, texts in chunks(batch, limit=_CHUNK):
                packed, numbers, _ = grams(texts)
                langs = np.array(part.column("lang").to_pylist(), dtype=object)
                owner = np.repeat(langs, numbers)
                for lang in set(langs.tolist()):
                    own = packed[owner == lang]
                    if len(own):
                        held.setdefault(lang, []).append(np.unique(own, return_counts=True))
            for lang, found in held.items():
                if len(found) > 8:
                    held[lang] = [_folded(found)]
            if sum(len(f[0]) for found in held.values() for f in found) > _FLUSH:
                yield from emit()
        yield from emit()

    rows = labelled.select("lang", "text").mapInArrow(count, "lang string, gram long, n long")
    return rows.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def _tail(gram: str, signs: int) -> Column:
    return F.col(gram).bitwiseAND(F.lit((1 << (SIGN_BITS * signs)) - 1))


def _smoothed(counts: DataFrame, order: int, lower: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """Probabilities of the runs of one order and weights of what their heads leave over."""
    once = F.sum((F.col("n") == 1).cast("long"))
    twice = F.sum((F.col("n") == 2).cast("long"))
    rates = counts.groupBy("lang").agg(
        F.coalesce(once / F.nullif(once + 2 * twice, F.lit(0)), F.lit(0.5)).alias("d")
    )
    head = F.shiftrightunsigned("gram", SIGN_BITS)
    heads = counts.groupBy("lang", head.alias("head")).agg(
        F.sum("n").alias("total"), F.count("*").alias("kinds")
    )
    heads = heads.join(rates, "lang")
    left = F.greatest("d", F.lit(0.1)) * F.col("kinds") / F.col("total")
    heads = heads.select("lang", "head", "total", "d", left.alias("left"))
    own = counts.withColumn("head", head).join(heads, ["lang", "head"])
    if lower is None:
        base = F.lit(1.0 / _ALPHABET)
    else:
        own = own.withColumn("tail", _tail("gram", order - 1)).join(
            lower.select("lang", F.col("gram").alias("tail"), F.col("p").alias("base")),
            ["lang", "tail"],
        )
        base = F.col("base")
    p = F.greatest(F.col("n") - F.greatest("d", F.lit(0.1)), F.lit(0.0)) / F.col("total")
    own = own.select("lang", "gram", "n", (p + F.col("left") * base).alias("p"))
    return own, heads.select("lang", F.col("head").alias("gram"), F.col("total").alias("n"), F.col("left").alias("p"))


def _kind(order: int, head: bool = False) -> int:
    """Number of a table: runs of an order, or what their heads leave over."""
    return 2 * order + int(head)


class LanguageModels:
    """Log-probabilities of all languages, each kind's runs in one sorted hash array.

    Under a run stand the languages that have it, and no other: ``parts`` holds per kind
    the sorted digests, where the entries of each begin, and language and value of every
    entry. Rows worked out for a run of the highest order are kept until ``held`` numbers
    are, then the memory starts anew.
    """

    def __init__(self, langs: Sequence[str], parts: dict[int, tuple[np.ndarray, ...]], held: int = 1 << 20) -> None:
        self.langs, self.parts = list(langs), parts
        self.held = max(held // max(len(self.langs), 1), 1)
        self._forget()

    def _forget(self) -> None:
        self.known = np.zeros(0, dtype=U64)
        self.rows = np.zeros((0, len(self.langs)), dtype=np.float32)

    @staticmethod
    def parts_of(table: pa.Table) -> dict[int, tuple[np.ndarray, ...]]:
        """Sorted arrays of ``table(kind, gram, place, logp)``, ``place`` that of the language."""
        kinds, grams, places, logs = (table.column(c).to_numpy() for c in ("kind", "gram", "place", "logp"))
        names = mix(grams.view(np.uint64))
        order = np.lexsort((places, names, kinds))
        kinds, names, places, logs = (x[order] for x in (kinds, names, places, logs))
        parts = {}
        for kind in np.unique(kinds).tolist():
            own = slice(*np.searchsorted(kinds, [kind, kind + 1]))
            keys, start = np.unique(names[own], return_index=True)
            start = np.append(start, len(names[own]))
            parts[kind] = (keys, start, places[own].astype(np.int32), logs[own].astype(np.float32))
        return parts

    def _put(self, kind: int, names: np.ndarray, out: np.ndarray, add: bool) -> None:
        """Add to ``out``, or write into it, the entries its rows' runs have."""
        if kind not in self.parts:
            return
        keys, start, place, logs = self.parts[kind]
        wanted = mix(names)
        at = np.searchsorted(keys, wanted)
        at[at == len(keys)] = 0
        row = np.flatnonzero(keys[at] == wanted)
        first = start[at[row]]
        number = start[at[row] + 1] - first
        entry = np.arange(number.sum()) - np.repeat(np.cumsum(number) - number - first, number)
        cells = (np.repeat(row, number), place[entry])
        out[cells] = out[cells] + logs[entry] if add else logs[entry]

    def log_probability(self, order: int, names: np.ndarray) -> np.ndarray:
        """A row per run, a column per language: its own entry, else what its head leaves for shorter runs."""
        if order == 0:
            return np.full((len(names), len(self.langs)), -np.log(_ALPHABET), dtype=np.float32)
        tails = names & U64((1 << (SIGN_BITS * (order - 1))) - 1)
        out = self.log_probability(order - 1, tails)
        self._put(_kind(order, True), names >> U64(SIGN_BITS), out, True)
        self._put(_kind(order), names, out, False)
        return out

    def _rows(self, names: np.ndarray) -> np.ndarray:
        """Rows of different runs, given sorted."""
        if len(self.known) + len(names) > self.held:
            self._forget()
        at = np.searchsorted(self.known, names)
        new = np.ones(len(names), dtype=bool)
        inside = at < len(self.known)
        new[inside] = self.known[at[inside]] != names[inside]
        if new.any():
            self.known = np.insert(self.known, at[new], names[new])
            self.rows = np.insert(self.rows, at[new], self.log_probability(ORDER, names[new]), axis=0)
        return self.rows[np.searchsorted(self.known, names)]

    def cross_entropy(self, packed: np.ndarray, numbers: np.ndarray) -> np.ndarray:
        """Bits per sign, a row per text and a column per language."""
        sums = np.zeros((len(numbers), len(self.langs)))
        ends = np.cumsum(numbers)
        step = max(1, 4 * _CHUNK // max(len(self.langs), 4))
        for start in range(0, len(packed), step):
            different, place = np.unique(packed[start : start + step], return_inverse=True)
            logs = self._rows(different)[place]
            stop = start + len(logs)
            first, last = np.searchsorted(ends, [start, stop - 1], side="right")
            cuts = np.maximum(ends[first : last + 1] - numbers[first : last + 1], start) - start
            filled = np.flatnonzero(numbers[first : last + 1] > 0)
            sums[first + filled] += np.add.reduceat(logs, cuts[filled], axis=0, dtype=np.float64)
        return -sums / np.maximum(numbers, 1)[:, None] / np.log(2)


@dataclass
class LanguageTable:
    """Trained models as a table ``(kind, gram, place, logp)`` of so many ``entries``.

    ``limits`` says how many bits per sign a text may need, by the logarithm of its length.
    """

    langs: list[str]
    rows: DataFrame | None = None
    entries: int = 0
    limits: dict[int, float] = field(default_factory=dict)


def learned_fold(name: str = "doc_id", folds: int = 5) -> Column:
    """Documents to learn from: the checksum of the id is no multiple of ``folds``."""
    return F.coalesce(F.pmod(F.crc32(F.col(name).cast("string")), F.lit(folds)) != 0, F.lit(False))


def _smoothed_models(counts: DataFrame) -> LanguageTable:
    """Models from counts ``(lang, gram, n)`` of runs of the highest order; every run is kept."""
    langs = sorted(r[0] for r in counts.select("lang").distinct().collect())
    if not langs:
        return LanguageTable([])
    tables = {ORDER: counts}
    for order in range(ORDER - 1, 0, -1):
        above = tables[order + 1].select("lang", _tail("gram", order).alias("gram"))
        tables[order] = stage(above.groupBy("lang", "gram").agg(F.count("*").alias("n")), "grams")
    place = F.array_position(F.array(*[F.lit(x) for x in langs]), F.col("lang")).cast("int") - 1
    lower, parts = None, []
    for order in range(1, ORDER + 1):
        runs, heads = _smoothed(tables[order], order, lower)
        lower = stage(runs, "runs")
        for kind, table in ((_kind(order), lower), (_kind(order, True), heads)):
            logp = F.log("p").cast("float").alias("logp")
            parts.append(table.select(F.lit(kind).alias("kind"), "gram", place.alias("place"), logp))
    rows = stage(reduce(DataFrame.unionByName, parts), "models")
    return LanguageTable(langs, rows, rows.count())


def train_language_models(
    labelled: DataFrame, calibration: int = 16, slack: float = 2.0
) -> LanguageTable:
    """Models of the languages in ``labelled(doc_id, lang, text)``.

    Counts of runs of four signs cover all rows and are summed by Spark; lower orders
    count the different signs seen before a run. Nothing counted is left out, so the
    probabilities after any head sum to one and the models grow with what they have read.

    How many bits per sign a text of a given length may need comes from models without one
    row in ``calibration``, chosen by the id's checksum: the 99.9th percentile of those
    rows and longer ones, plus ``slack``. Their counts then go into the models as well.
    """
    rows = labelled.where("lang IS NOT NULL AND text IS NOT NULL")
    rows = rows.withColumn("lang", F.col("lang").cast("string"))
    tried = F.coalesce(F.pmod(F.floor(F.crc32(F.col("doc_id").cast("string")) / 5), F.lit(calibration)) == 0, F.lit(False))
    counts = stage(count_grams(rows.where(~tried)), "grams")
    trial = _smoothed_models(counts)
    scored = identify_languages(rows.where(tried).select("doc_id", "text"), trial)
    bins = scored.where("n_signs > 0 AND cross_entropy IS NOT NULL")
    bins = bins.groupBy(F.floor(F.log2("n_signs")).cast("int").alias("bin"))
    limits = bins.agg(F.percentile_approx("cross_entropy", 0.999, 10_000).alias("top")).collect()
    more = counts.unionByName(count_grams(rows.where(tried)))
    models = _smoothed_models(stage(more.groupBy("lang", "gram").agg(F.sum("n").alias("n")), "grams"))
    worst = 0.0
    for r in sorted(limits, key=lambda r: -r["bin"]):
        worst = max(worst, r["top"])
        models.limits[r["bin"]] = worst + slack
    return models


def _scored(batch: pa.RecordBatch, m: LanguageModels, limits: dict[int, float]) -> Iterator[pa.RecordBatch]:
    """The rows of ``batch`` with the columns of ``ADDED``."""
    longest = max(limits, default=0)
    highest = max(limits.values(), default=float("inf"))
    for part, texts in chunks(batch, limit=_CHUNK):
        packed, numbers, letters = grams(texts)
        known = (letters > 0) & bool(m.langs)
        names = np.full(len(texts), UNDETERMINED, dtype=object)
        share, least = np.zeros(len(texts)), np.full(len(texts), np.nan)
        barred = ~known
        if m.langs:
            bits = m.cross_entropy(packed, numbers)
            best = bits.argmin(axis=1)
            low = bits.min(axis=1)
            odds = np.exp2(-8.0 * (bits - low[:, None])).sum(axis=1)
            names[known] = np.array(m.langs, dtype=object)[best[known]]
            share[known], least[known] = 1.0 / odds[known], low[known]
            size = np.log2(np.maximum(numbers, 1)).astype(int)
            allowed = np.array(
                [
                    limits.get(b, highest if b < longest else limits.get(longest, highest))
                    for b in size.tolist()
                ]
            )
            barred = barred | (known & (low > allowed))
        added = [
            pa.array(names.tolist(), pa.string()),
            pa.array(share, pa.float64()),
            pa.array(least, pa.float64(), mask=~known),
            pa.array(np.where(known, numbers, 0), pa.int64()),
            pa.array(barred, pa.bool_()),
        ]
        yield pa.RecordBatch.from_arrays([*part.columns, *added], names=[*part.schema.names, *ADDED])


def _needed_entries(rows: DataFrame) -> DataFrame:
    """``(__chunk, kind, gram)``: what the texts of each chunk may look up, each once."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in chunks(batch, limit=_CHUNK):
                packed, numbers, _ = grams(texts)
                chunk = np.repeat(part.column("__chunk").to_numpy(), numbers)
                pairs = np.unique(np.stack([chunk.astype(np.uint64), packed]), axis=1)
                yield pa.record_batch(
                    [pa.array(pairs[0].astype(np.int64)), pa.array(pairs[1].view(np.int64))],
                    names=["__chunk", "gram"],
                )

    runs = rows.select("__chunk", "text").mapInArrow(find, "__chunk long, gram long").distinct()
    wanted = []
    for order in range(1, ORDER + 1):
        run = _tail("gram", order) if order < ORDER else F.col("gram")
        head = F.shiftrightunsigned(run, SIGN_BITS)
        wanted.append(F.struct(F.lit(_kind(order)).alias("kind"), run.alias("gram")))
        wanted.append(F.struct(F.lit(_kind(order, True)).alias("kind"), head.alias("gram")))
    return runs.select("__chunk", F.explode(F.array(*wanted)).alias("w")).select("__chunk", "w.*").distinct()


def _identified_by_chunks(
    kept: DataFrame, models: LanguageTable, schema: T.StructType, size: int
) -> DataFrame:
    """Scores where the models are too large to send to every task.

    Texts are dealt into chunks of about ``size`` bytes; the entries a chunk's texts may look up are
    joined from the models' table and meet the chunk in one task.
    """
    total = kept.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    place = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(-(-total // size) or 1))
    # Written once: places given while reading must not change when a task is repeated.
    dealt = stage(kept.withColumn("__chunk", place), "chunks")
    entries = _needed_entries(dealt).join(models.rows, ["kind", "gram"])
    langs, limits = models.langs, models.limits

    def score(texts: pa.Table, found: pa.Table) -> pa.Table:
        m = LanguageModels(langs, LanguageModels.parts_of(found))
        out = [
            part
            for batch in texts.drop_columns(["__chunk"]).to_batches()
            for part in _scored(batch, m, limits)
        ]
        return pa.Table.from_batches(out)

    met = dealt.groupBy("__chunk").cogroup(entries.groupBy("__chunk"))
    return met.applyInArrow(score, schema)


def identify_languages(
    docs: DataFrame, models: LanguageTable, most: int = 1 << 22, size: int = 1 << 26
) -> DataFrame:
    """``docs`` with the language whose model needs the fewest bits per sign of the text.

    Reads ``text`` and adds ``lang_pred``, ``score`` (0 to 1, the share of the best
    language when bits are turned back into odds), ``cross_entropy`` in bits per sign,
    ``n_signs`` and ``rejected``; input columns of these names are replaced, others kept.
    A text that is null or has no letter is ``und`` with score 0 and rejected; one that
    needs more bits than calibration allows is rejected but keeps its language. Equal
    bits go to the first language by name. Without any learned language all are ``und``.

    Models of up to ``most`` entries (14 bytes each) are sent to every task; of larger
    ones each chunk of texts, about ``size`` bytes, gets the entries it needs by a join. Both give the same.
    """
    kept = docs.drop(*ADDED)
    added = T.StructType.fromDDL(
        "lang_pred string, score double, cross_entropy double, n_signs long, rejected boolean"
    )
    schema = T.StructType([*kept.schema.fields, *added.fields])
    if models.entries > most:
        return _identified_by_chunks(kept, models, schema, size)
    parts = LanguageModels.parts_of(models.rows.toArrow()) if models.rows is not None else {}
    shared = docs.sparkSession.sparkContext.broadcast(parts)
    langs, limits = models.langs, models.limits

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = LanguageModels(langs, shared.value)
        for batch in batches:
            yield from _scored(batch, m, limits)

    return kept.mapInArrow(score, schema)


def languages_of(docs: DataFrame) -> DataFrame:
    """Learn from the labelled documents of the learned fold and identify all of ``docs``.

    Reads ``doc_id, text, lang``; a row without an id is never learned from. Adds
    ``held_out`` to what ``identify_languages`` adds.
    """
    learned = docs.where(learned_fold()).select("doc_id", "text", "lang")
    models = train_language_models(learned)
    found = identify_languages(docs, models)
    return found.withColumn("held_out", ~learned_fold())


def keep_identified(docs: DataFrame) -> DataFrame:
    """``docs`` without those whose language is rejected."""
    return languages_of(docs).where("NOT rejected").select(*docs.columns)
