import math
import zlib
from collections import Counter, defaultdict

import numpy as np
from fixtures import edge_docs, edge_rows, no_docs
from pyspark.sql import functions as F

from runledger.llm import langid


def runs(text, n=4):
    """Runs of four signs of a text, as strings with blanks for gaps."""
    signs = "".join(c if c.isalpha() else " " for c in text.lower())
    signs = "   " + " ".join(signs.split()) + " "
    return [signs[i : i + n] for i in range(len(signs) - n + 1)]


def kneser_ney(texts):
    """Probability of the last sign of a run after the others, straight from the formula."""
    counts = {4: Counter(g for t in texts for g in runs(t))}
    for n in (3, 2, 1):
        counts[n] = Counter(g[1:] for g in counts[n + 1])
    rate = {}
    for n, c in counts.items():
        once, twice = (sum(v == k for v in c.values()) for k in (1, 2))
        rate[n] = max(once / (once + 2 * twice) if once + twice else 0.5, 0.1)

    def p(g):
        n = len(g)
        lower = p(g[1:]) if n > 1 else 1 / 65536
        total = sum(v for k, v in counts[n].items() if k[:-1] == g[:-1])
        kinds = sum(k[:-1] == g[:-1] for k in counts[n])
        if not total:
            return lower
        return max(counts[n][g] - rate[n], 0) / total + rate[n] * kinds / total * lower

    return p


def loaded(table, **options):
    return langid.LanguageModels(table.langs, langid.LanguageModels.parts_of(table.rows.toArrow()), **options)


def test_models_equal_the_formula(spark):
    texts = {"a": ["banana bandana", "ananas, Anna!"], "b": ["otto tot", "motto"]}
    rows = [(i, lang, t) for lang, ts in texts.items() for i, t in enumerate(ts)]
    df = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    models = langid.train_language_models(df, calibration=10**6)
    assert models.langs == ["a", "b"]
    tried = ["banana", "toto Anna", "xyz", "b", ""]
    packed, numbers, letters = langid.grams(tried)
    assert letters.tolist() == [6, 8, 3, 1, 0]
    bits = loaded(models).cross_entropy(packed, numbers)
    # Whether rows are kept or worked out anew makes no difference.
    assert np.array_equal(bits, loaded(models, held=1).cross_entropy(packed, numbers))
    for column, lang in enumerate(models.langs):
        p = kneser_ney(texts[lang])
        for row, text in enumerate(tried):
            if letters[row]:
                need = [-math.log2(p(g)) for g in runs(text)]
                assert math.isclose(bits[row, column], sum(need) / len(need), rel_tol=1e-4)


def test_every_row_counts_and_probabilities_sum_to_one(spark):
    rng = np.random.default_rng(6)
    texts = [" ".join("".join(rng.choice(list("abcdefgh"), rng.integers(1, 7))) for _ in range(40)) for _ in range(64)]
    rows = [(i, "xy"[i % 2], t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    models = langid.train_language_models(df)
    assert models.limits
    # Rows that set the limits are in the counts, too.
    whole = Counter((lang, g) for _, lang, t in rows for g in runs(t))
    entries = models.rows.where("kind = 8").count()
    assert entries == len(whole)
    m = loaded(models)
    signs = [0, *(ord(c) for c in "abcdefgh")]
    for head in ("   ", " ab", "abc", "zzz", "h g"):
        packed = sum((0 if c == " " else ord(c)) << s for c, s in zip(head, (48, 32, 16), strict=True))
        names = np.array([packed | s for s in signs], dtype=np.uint64)
        known = np.exp(m.log_probability(4, names).astype(np.float64)).sum(axis=0)
        other = np.exp(m.log_probability(4, np.array([packed | 0x3B1], dtype=np.uint64))[0].astype(np.float64))
        assert np.allclose(known + other * (65536 - len(signs)), 1.0, atol=1e-4)


def test_models_too_large_to_send_give_the_same(spark):
    docs = edge_docs(spark).unionByName(edge_docs(spark))
    learned = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    models = langid.train_language_models(learned)
    sent = langid.identify_languages(docs, models)
    for size in (200, 1 << 20):
        joined = langid.identify_languages(docs, models, most=0, size=size)
        assert joined.schema == sent.schema
        assert sorted(map(str, joined.collect())) == sorted(map(str, sent.collect()))
    none = langid.identify_languages(no_docs(spark), models, most=0)
    assert none.collect() == []


def test_many_languages(spark):
    rng = np.random.default_rng(7)
    letters = [list("abcdefghijklmnopqrstuvwxyz")[i % 20 : i % 20 + 6] for i in range(120)]
    rows = [
        (120 * j + i, f"l{i:03d}", " ".join(f"{''.join(rng.permutation(own))}{i}q" for _ in range(6)))
        for j in range(3) for i, own in enumerate(letters)
    ]
    df = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    models = langid.train_language_models(df)
    assert len(models.langs) == 120 and models.entries < 120 * 4 * 2 * 150
    found = langid.identify_languages(df, models).where("lang_pred = lang").count()
    assert found > 0.8 * len(rows)


def test_runs_of_signs():
    packed, numbers, _ = langid.grams(["Ab  c", None, "1", "é"])
    assert numbers.tolist() == [5, 0, 0, 2]
    want = [tuple(0 if c == " " else ord(c) for c in g) for g in [*runs("ab c"), *runs("é")]]
    got = [tuple(int(g) >> s & 0xFFFF for s in (48, 32, 16, 0)) for g in packed]
    assert got == want


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = langid.languages_of(docs).where("held_out").select("doc_id", "lang", "lang_pred", "rejected")
    rows = found.collect()
    assert len(rows) > 100 and all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in rows)
    assert np.mean([r.lang == r.lang_pred for r in rows]) > 0.98
    assert not any(r.rejected for r in rows)


def test_rejection_is_calibrated(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    models = langid.train_language_models(docs.where(langid.learned_fold()))
    odd = spark.createDataFrame(
        [(1, "Съешь же ещё этих мягких французских булок да выпей чаю"), (2, "qzx wvk jjq xzz kkw vqx qqz")],
        "doc_id long, text string",
    )
    assert {r.rejected for r in langid.identify_languages(odd, models).collect()} == {True}


def test_odd_documents(spark):
    docs = edge_docs(spark)
    rows = langid.languages_of(docs).collect()
    assert len(rows) == len(edge_rows())
    seen = defaultdict(set)
    for r in rows:
        if not r.text or not any(c.isalpha() for c in r.text):
            assert (r.lang_pred, r.score, r.rejected) == ("und", 0.0, True)
        else:
            assert r.lang_pred in ("de", "en", "fr") and 0 < r.score <= 1
        seen[r.text].add((r.lang_pred, r.score))
        learned = r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 != 0
        assert r.held_out == (not learned)
    assert all(len(v) == 1 for v in seen.values())
    assert langid.languages_of(no_docs(spark)).count() == 0
    untaught = langid.languages_of(docs.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r.lang_pred for r in untaught} == {"und"}
    left = langid.keep_identified(docs)
    assert left.columns == docs.columns
