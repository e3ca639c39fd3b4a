"""Secrets in texts: candidates, and a random forest that tells false findings."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runledger.functions.text import bind
from runledger.session import stage

CANDIDATE = r"[A-Za-z0-9+/_=-]{16,}"
# Names that announce a secret where they stand just before one.
ANNOUNCING = r"(?i)(token|secret|passw|api_?key|auth|credential)"
_BLANKS = r"[\x20\x09-\x0D]+"
_BUCKETS = 32
_LONGEST = 32
_SIGNS = "abcdefghijklmnopqrstuvwxyz0123456789"
_KINDS = len(_SIGNS) + 1
# What a candidate is like by itself and where its document comes from.
OWN_FEATURES = (
    "f_length",
    "f_digits",
    "f_upper",
    "f_hex",
    "f_switches",
    "f_variety",
    "f_transitions",
    "f_words",
    "f_path",
    "f_path_length",
)
# What stands around it.
NEAR_FEATURES = ("f_before", "f_before_far", "f_after", "f_announced", "f_assigned", "f_quoted")
FEATURES = OWN_FEATURES + NEAR_FEATURES


def secret_candidates(docs: DataFrame, path: str = "source") -> DataFrame:
    """``(doc_id, path, word_no, runs, word, before, before_far, after)``, a row per word.

    Candidates are the runs of at least 16 signs used by keys that hold a digit; whole
    texts are searched, and ``runs`` has every one with its place among the word's runs,
    ``(run_no, candidate)``. ``before``, ``before_far`` and ``after`` are the neighbouring
    words. They stand once per word, as one without blanks can hold thousands of runs.
    """
    def keys(word: Column) -> Column:
        runs = F.transform(
            F.regexp_extract_all(word, F.lit(CANDIDATE), F.lit(0)),
            lambda c, n: F.struct(n.alias("run_no"), c.alias("candidate")),
        )
        return F.filter(runs, lambda r: F.rlike(r["candidate"], F.lit("[0-9]")))

    def found(words: Column) -> Column:
        long = F.filter(
            F.transform(words, lambda w, i: F.struct(w.alias("w"), i.alias("i"))),
            lambda x: (F.length(x["w"]) >= 16) & F.rlike(x["w"], F.lit(CANDIDATE)),
        )
        near = F.transform(
            long,
            lambda x: F.struct(
                x["i"].alias("word_no"),
                keys(x["w"]).alias("runs"),
                x["w"].alias("word"),
                F.coalesce(F.get(words, x["i"] - 1), F.lit("")).alias("before"),
                F.coalesce(F.get(words, x["i"] - 2), F.lit("")).alias("before_far"),
                F.coalesce(F.get(words, x["i"] + 1), F.lit("")).alias("after"),
            ),
        )
        return F.filter(near, lambda x: F.size(x["runs"]) > 0)

    # Bound, so that a text is split once and not again for every neighbour.
    words = bind(F.split(F.col("text"), _BLANKS, -1), found)
    rows = docs.select("doc_id", F.col(path).cast("string").alias("path"), F.explode(words).alias("x"))
    return rows.select("doc_id", "path", "x.*")


def word_counts(docs: DataFrame) -> DataFrame:
    """``(word, n)``: how often each run of letters and digits stands in the texts, lower-cased."""
    runs = F.regexp_extract_all(F.lower(F.col("text")), F.lit("[a-z0-9]+"), F.lit(0))
    words = docs.select(F.explode(F.filter(runs, lambda w: F.length(w).between(2, _LONGEST))).alias("word"))
    return words.groupBy("word").agg(F.count("*").alias("n"))


def dictionary_of(counts: DataFrame, n: int = 500) -> list[str]:
    """The ``n`` commonest words of four letters and more."""
    plain = counts.where(F.rlike("word", F.lit("^[a-z]{4,}$")))
    return [r["word"] for r in plain.orderBy(F.desc("n"), "word").limit(n).collect()]


def _sign(text: Column, place: Column | int) -> Column:
    """The kind of a sign: one of 26 letters, ten digits, and the rest."""
    return F.instr(F.lit(_SIGNS), F.substring(text, place, F.lit(1)))


def transition_model(counts: DataFrame) -> list[float]:
    """Log-probability of each kind of sign after each other, over all words of the corpus.

    A row of ``len(_SIGNS) + 1`` numbers per first sign, one after the other; one is added to every count, so nothing is
    impossible. What stands in no word has the lowest value of its row.
    """
    places = F.sequence(F.lit(1), F.length("word") - 1)
    pairs = F.transform(places, lambda i: _sign(F.col("word"), i) * _KINDS + _sign(F.col("word"), i + 1))
    seen = counts.select("n", F.explode(pairs).alias("pair")).groupBy("pair").agg(F.sum("n").alias("n"))
    # At most _KINDS * _KINDS rows.
    found = {r["pair"]: r["n"] for r in seen.collect()}
    out = []
    for first in range(_KINDS):
        row = [found.get(first * _KINDS + second, 0) + 1 for second in range(_KINDS)]
        out += [math.log(n / sum(row)) for n in row]
    return out


def _share(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)) / F.length(text)


def _bucket(text: Column) -> Column:
    return F.pmod(F.crc32(F.lower(text)), F.lit(_BUCKETS)).cast("double")


def with_features(
    candidates: DataFrame, dictionary: list[str], transitions: list[float] | None = None
) -> DataFrame:
    """A row per run: length, kinds of signs, transitions, dictionary cover, path, neighbours.

    ``f_transitions`` is the mean log-probability of the run's signs, each after the one
    before, under ``transition_model``: low for keys, high for words.

    What depends on the word is computed before its runs are exploded; ``stated`` is the
    label of ``assigned_labels``.
    """
    c = F.col("candidate")
    cover = F.lit(0.0)
    if dictionary:
        longest = sorted(dictionary, key=lambda w: (-len(w), w))
        rest = F.regexp_replace(F.lower(c), "|".join(longest), "")
        cover = 1 - F.length(rest) / F.length(c)
    switch = "(?<=[a-z])(?=[^a-z])|(?<=[A-Z])(?=[^A-Z])|(?<=[0-9])(?=[^0-9])|(?<=[+/_=-])(?=[^+/_=-])"
    low = F.lower(c)
    logs = F.array(*[F.lit(x) for x in transitions or [0.0] * _KINDS * _KINDS])
    steps = F.transform(
        F.sequence(F.lit(1), F.length(c) - 1),
        lambda i: F.get(logs, _sign(low, i) * _KINDS + _sign(low, i + 1)),
    )
    likely = F.aggregate(steps, F.lit(0.0), lambda total, x: total + x) / (F.length(c) - 1)
    path = F.coalesce(F.col("path"), F.lit(""))
    signs = F.array_distinct(F.split(c, ""))
    own = {
        "f_length": F.length(c).cast("double"),
        "f_digits": _share(c, "[0-9]"),
        "f_upper": _share(c, "[A-Z]"),
        "f_hex": _share(c, "[0-9a-fA-F]"),
        "f_switches": F.regexp_count(c, F.lit(switch)) / F.length(c),
        "f_variety": F.size(signs) / F.length(c),
        "f_transitions": likely,
        "f_words": cover,
    }
    shared = {
        "f_path": _bucket(path),
        "f_path_length": F.length(path).cast("double"),
        "f_before": _bucket(F.col("before")),
        "f_before_far": _bucket(F.col("before_far")),
        "f_after": _bucket(F.col("after")),
        "f_announced": F.rlike(F.concat_ws(" ", "before_far", "before", "word"), F.lit(ANNOUNCING)).cast("double"),
        "f_assigned": F.rlike(F.concat(F.col("before"), F.col("word")), F.lit("[=:]")).cast("double"),
        "f_quoted": F.rlike("word", F.lit("[\"'`]")).cast("double"),
    }
    context = F.concat_ws(" ", "before_far", "before")
    stated = F.rlike(context, F.lit(ANNOUNCING + r"\S*\s*[=:]")) & F.rlike("word", F.lit("[\"'`]"))
    words = candidates.select(
        "doc_id",
        "word_no",
        "runs",
        *[v.cast("double").alias(k) for k, v in shared.items()],
        stated.alias("stated"),
    )
    runs = words.select("*", F.inline("runs")).drop("runs")
    return runs.withColumns({k: v.cast("double") for k, v in own.items()})


def assigned_labels(findings: DataFrame) -> DataFrame:
    """Findings labelled by how they stand: assigned to an announcing name and in quotes or not."""
    return findings.withColumn("label", F.col("stated").cast("int"))


def train_forest(
    findings: DataFrame,
    most: int = 20_000,
    trees: int = 20,
    depth: int = 6,
    seed: int = 11,
    features: Sequence[str] = FEATURES,
) -> PipelineModel | None:
    """A random forest on ``findings`` with ``features`` and ``label`` (1: secret).

    Fitted on at most about ``most`` findings, half of them of each label where there are
    more, chosen by digest; none, or labels of one kind only, give no forest.
    """
    known = findings.where("label IS NOT NULL").select("candidate", "run_no", "word_no", "doc_id", "label", *FEATURES)
    counts = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(counts) < 2:
        return None
    place = F.pmod(F.xxhash64("doc_id", "word_no", "run_no", "candidate"), F.lit(1 << 20))
    chosen = F.lit(False)
    for label, n in counts.items():
        share = int(min(1.0, most / len(counts) / n) * (1 << 20))
        chosen = chosen | ((F.col("label") == label) & (place < share))
    forest = RandomForestClassifier(
        numTrees=trees, maxDepth=depth, seed=seed, labelCol="label", featuresCol="features"
    )
    assembler = VectorAssembler(inputCols=list(features), outputCol="features")
    return Pipeline(stages=[assembler, forest]).fit(known.where(chosen))


def scan_secrets(
    docs: DataFrame, findings: DataFrame | None = None, path: str = "source", cut: float = 0.5
) -> DataFrame:
    """Candidates in ``docs`` with the probability that each is a secret.

    Reads ``doc_id, text`` and ``path``. ``findings`` are labelled ones,
    ``(doc_id, word_no, run_no, label)``, 1 for a secret; without ``run_no`` they name the
    first run of the word. With no ``findings`` the labels are those of ``assigned_labels``,
    which come from what stands around a candidate; the forest then sees only what the
    candidate is like by itself, so it does not repeat the rule but tells by form what the
    rule's findings have in common, wherever it stands. Transitions and dictionary are
    counted over all texts.
    Returns ``doc_id, word_no, run_no, candidate, probability, is_secret``.
    All is SQL functions and Spark's own forest; texts are scanned for words and for
    candidates, and only word counts and candidates with their neighbours go on. Null and empty texts have no candidate; a null
    path or neighbour counts as empty; repeated rows are found repeatedly. Without labels
    of both kinds the probability is null and nothing is dropped (``is_secret`` true).
    """
    found = stage(secret_candidates(docs, path), "candidates")
    counts = stage(word_counts(docs), "words")
    features, dictionary = FEATURES, dictionary_of(counts)
    featured = stage(with_features(found, dictionary, transition_model(counts)), "findings")
    if findings is None:
        labelled, features = assigned_labels(featured), OWN_FEATURES
    else:
        keys = ["doc_id", "word_no", "run_no"]
        if "run_no" not in findings.columns:
            findings = findings.withColumn("run_no", F.lit(0))
        marks = findings.groupBy(*keys).agg(F.max("label").alias("label"))
        labelled = featured.join(marks, keys)
    model = train_forest(labelled, features=features)
    names = ["doc_id", "word_no", "run_no", "candidate"]
    if model is None:
        none = featured.select(*names, F.lit(None).cast("double").alias("probability"))
        return none.withColumn("is_secret", F.lit(True))
    chance = vector_to_array("probability")[1]
    scored = model.transform(featured.select(*names, *FEATURES)).select(*names, chance.alias("probability"))
    return scored.withColumn("is_secret", F.col("probability") >= cut)
