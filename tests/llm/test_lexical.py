import math
import re
from collections import Counter

import numpy as np
import pytest
from fixtures import edge_docs, no_docs

from runledger.llm.lexical import ranked_documents
from runledger.llm.sharing import shared_leaves, sharing_plan

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
ITEMS = "item_id long, text string, doc_id string, `rank` string, score string"


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, k=50):
    counts = [(i, Counter(terms(t))) for i, t in docs if terms(t)]
    n_docs, words = len(counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    own = {}
    for i, t in items:
        if i is not None:
            own.setdefault(i, set()).update(terms(t))
    out = []
    for item, wanted in own.items():
        found = []
        for doc, c in counts:
            m = 50 + 50 * sum(c.values()) * n_docs // words
            w = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) for t in wanted}
            score = sum(w[t] * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in wanted if c[t])
            if score > 0 and doc is not None:
                found.append((-score, doc))
        out += [(item, n, d, -s) for n, (s, d) in enumerate(sorted(found)[:k], 1)]
    return sorted(out)


def got(docs, items, **options):
    return sorted(tuple(r) for r in ranked_documents(docs, items, **options).collect())


def frame(spark, items):
    return spark.createDataFrame([(*i, "d", "r", "s") for i in items], ITEMS)


def totals(plan, numbers):
    sums = [0] * plan.n_leaves
    for term, leaf in plan.leaf_of.items():
        sums[leaf] += numbers[term]
    for a, b in plan.sums:
        sums.append(sums[a] + sums[b])
    return {item: sum(sums[p] for p in parts) for item, parts in plan.parts.items()}


def additions(plan):
    return len(plan.sums) + sum(len(p) - 1 for p in plan.parts.values() if p)


def test_plan_adds_up_and_shares():
    rng = np.random.default_rng(5)
    for n_items, n_terms in ((1, 5), (2, 6), (30, 12), (60, 25)):
        wanted = {
            i: [b"t%d" % t for t in rng.choice(n_terms, size=rng.integers(0, n_terms), replace=False)]
            for i in range(n_items)
        }
        numbers = {b"t%d" % t: 1 << t for t in range(n_terms)}
        plan = sharing_plan(wanted)
        assert totals(plan, numbers) == {i: sum(numbers[t] for t in ts) for i, ts in wanted.items()}
        assert additions(plan) <= additions(shared_leaves(wanted))
        assert all(a < plan.n_leaves + i and b < plan.n_leaves + i for i, (a, b) in enumerate(plan.sums))
    both = {1: [b"a", b"b", b"c"], 2: [b"a", b"b", b"d"], 3: [b"a", b"e"]}
    plan = sharing_plan(both)
    assert plan.leaf_of[b"a"] != plan.leaf_of[b"b"]
    assert len(plan.sums) == 1 and additions(plan) == 4 and additions(shared_leaves(both)) == 5


@pytest.mark.parametrize("options", [{}, {"k": 3}, {"budget": 40}])
def test_equals_brute_force(spark, options):
    items = [
        (1, "The quick fox"), (2, "quick FOX runs"), (2, "über"), (3, None), (4, ""), (None, "quick"), (5, "--"),
        (6, "zzz unheard"), (7, "the quick fox jumps over the lazy dog the end"), (8, "a b c x wort1"), (9, "b c"),
    ]
    extra = [(20 + i, "quick fox " + "filler " * (i % 4)) for i in range(60)]
    docs = edge_docs(spark).select("doc_id", "text", "size", "score", "rank")
    more = spark.createDataFrame([(*r, "s", "x", "y") for r in extra], docs.schema)
    docs = docs.unionByName(more)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert got(docs, frame(spark, items), **options) == brute(rows, items, options.get("k", 50))


def test_empty_tables(spark):
    items = frame(spark, [(1, "quick")])
    assert got(no_docs(spark), items) == []
    assert got(edge_docs(spark), frame(spark, [])) == []
    assert got(edge_docs(spark), frame(spark, [(1, "?!"), (2, None)])) == []


def test_every_document_has_the_term(spark):
    docs = spark.createDataFrame([(i, "same " * (1 + i % 5)) for i in range(40)], "doc_id long, text string")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert got(docs, frame(spark, [(1, "same")])) == brute(rows, [(1, "same")])
