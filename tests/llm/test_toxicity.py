import numpy as np
from fixtures import edge_docs, edge_rows, no_docs
from pyspark.sql import functions as F

from runledger.llm import toxicity

LABELS = "doc_id long, toxic int, score double"


def direct_kernel(a, b, decay=0.5):
    """The kernel of two words by listing every subsequence of three signs."""

    def weights(word):
        out = {}
        for i in range(len(word)):
            for j in range(i + 1, len(word)):
                for k in range(j + 1, min(i + 5, len(word))):
                    if word[i + 1 : k].strip("^$") == word[i + 1 : k]:
                        key = word[i] + word[j] + word[k]
                        key = key.replace("$", "^")
                        out[key] = out.get(key, 0) + decay ** (k - i - 2)
        return out

    x, y = weights(a), weights(b)
    return sum(v * y.get(k, 0) for k, v in x.items()) / sum(v * v for v in y.values())


def test_nearest_equals_the_kernel():
    marks = ["^idiot$", "^moron$", "^stupid$"]
    table = toxicity.LandmarkTable(marks)
    texts = ["idiot", "idxiot", "iddiot", "moronic", "stupd", "an idiot and a moron", "", None, "audio"]
    near = table.nearest(texts)
    for row, text in enumerate(texts):
        for column, mark in enumerate(marks):
            best = max((min(1.0, direct_kernel(f"^{w}$", mark)) for w in (text or "").split()), default=0.0)
            assert np.isclose(near[row, column], best**4 if best >= 0.5 else 0.0, atol=1e-6)


def test_memory_of_words_changes_nothing():
    rng = np.random.default_rng(4)
    pool = ["idiot", "idxiot", "stupd", "moronic", "a", "xyz", "stupid", "i d", "été", "morron"] + [
        "".join(rng.choice(list("idotmrnsup"), 6)) for _ in range(80)
    ]
    texts = [" ".join(rng.choice(pool, rng.integers(0, 30))) for _ in range(200)] + [None, "", "moron"]
    marks = ["^idiot$", "^moron$", "^stupid$"]
    whole = toxicity.LandmarkTable(marks).nearest(texts)
    for held in (1, 20, 1 << 20):
        table = toxicity.LandmarkTable(marks, held)
        parts = [table.nearest(texts[i : i + 7]) for i in range(0, len(texts), 7)]
        assert np.allclose(np.concatenate(parts), whole, atol=1e-9)
    for row, text in enumerate(texts):
        codes, _ = toxicity.sign_stream([text])
        words = "".join(map(chr, codes)).split("\0")
        for column, mark in enumerate(marks):
            best = max((min(1.0, direct_kernel(f"^{w}$", mark)) for w in words if w), default=0.0)
            assert np.isclose(whole[row, column], best**4 if best >= 0.5 else 0.0, atol=1e-6)


def test_broken_up_words_come_whole():
    table = toxicity.LandmarkTable(["^idiot$"])
    near = table.nearest(["id-iot", "i d i o t", "I.D.I.O.T", "so i*d*i*o*t", "idi ot"])[:, 0]
    assert np.isclose(near[:4], 1.0).all() and near[4] < 1.0


def test_held_out_scores(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    held = docs.where(~toxicity.trained_on()).join(labels.select("doc_id", "toxic"), "doc_id")
    scored = toxicity.score_toxicity(
        docs.join(labels.select("doc_id"), "doc_id", "left_semi").select("doc_id", "text"), labels
    )
    rows = scored.join(held.select("doc_id", "toxic", "lang"), "doc_id").collect()
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)
    clean = [r for r in rows if not r.toxic]
    english = [r for r in rows if r.toxic and r.lang == "en"]
    assert np.mean([r.predicted for r in clean]) < 0.01
    assert np.mean([r.predicted for r in english]) > 0.8
    assert np.mean([r.predicted for r in rows if r.toxic]) > 0.75


def test_odd_documents(spark):
    docs = edge_docs(spark)
    none = spark.createDataFrame([], LABELS)
    rows = toxicity.score_toxicity(docs, none).collect()
    assert len(rows) == len(edge_rows()) and {r.score for r in rows} == {0.5}
    toxic = [(i, i % 2, 9.0) for i in range(100)] + [(None, 1, 0.0), (3, None, 0.0), (4, 1, 0.0), (4, 1, 0.0)]
    labels = spark.createDataFrame(toxic, LABELS)
    rows = toxicity.score_toxicity(docs, labels).collect()
    assert len(rows) == len(edge_rows()) and all(0 <= r.score <= 1 for r in rows)
    assert toxicity.score_toxicity(no_docs(spark), labels).count() == 0
    texts = spark.range(100).select(
        F.col("id").alias("doc_id"),
        F.when(F.col("id") % 2 == 1, "you utter blockhead").otherwise("a nice day").alias("text"),
    )
    scored = {r.doc_id: r for r in toxicity.score_toxicity(texts, labels).collect()}
    assert scored[1].predicted == 1 and scored[2].predicted == 0
