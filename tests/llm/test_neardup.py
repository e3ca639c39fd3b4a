import random

import numpy as np
import pyarrow as pa
from fixtures import edge_docs, edge_rows, no_docs, shingles
from pyspark.sql import functions as F

from runledger.llm import hashing, neardup
from runledger.llm.graph import connected_components
from runledger.llm.minhash import superminhash


def brute(rows, k, num, den):
    """Least id reachable over links, by comparing everything with everything."""
    sets = {}
    for name, text in rows:
        if name is not None:
            sets[name] = shingles(text, k)
    root = {name: name for name in sets}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    names = sorted(sets)
    for i, a in enumerate(names):
        for b in names[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and den * both >= num * len(sets[a] | sets[b]):
                x, y = top(a), top(b)
                root[max(x, y)] = min(x, y)
    return {name: (len(sets[name]), top(name)) for name in names}


def result(df, k, part):
    return {
        r.doc_id: (r.n_shingles, r.component_id)
        for r in neardup.near_duplicates(df, k, part).where("doc_id IS NOT NULL").collect()
    }


def copies(seed, n, length, changes):
    """Near copies of one text and of each other, near the threshold."""
    rng = random.Random(seed)
    base = [f"w{rng.randrange(500)}" for _ in range(length)]
    out = []
    for i in range(n):
        own = list(base)
        for _ in range(rng.randrange(changes)):
            own[rng.randrange(length)] = f"x{rng.randrange(10_000)}"
        out.append((seed * 10_000 + i, " ".join(own)))
    return out


def test_equals_brute_force_near_the_threshold(spark):
    rows = copies(1, 300, 120, 9) + copies(2, 40, 30, 3) + copies(3, 60, 400, 30)
    random.Random(0).shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for k, part in ((3, (17, 20)), (5, (4, 5))):
        want = brute(rows, k, *part)
        assert len({c for _, c in want.values()}) > 3
        assert result(df, k, part) == want


def test_large_bucket_is_dealt_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(neardup, "_BLOCK", 16)
    rows = copies(4, 150, 80, 8)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(df, 3, (17, 20)) == brute(rows, 3, 17, 20)


def test_large_component_and_strangers(spark, monkeypatch):
    monkeypatch.setattr(neardup, "_BLOCK", 8)
    rng = random.Random(12)
    rows = copies(5, 90, 100, 3)
    # Texts that share bands with the large group and reach each other only, or nothing.
    for i in range(25):
        own = rows[0][1].split()
        for at in rng.sample(range(100), 7):
            own[at] = f"s{i // 3}"
        rows.append((i, " ".join(own)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(df, 3, (17, 20)) == brute(rows, 3, 17, 20)


def test_texts_decide_not_ids(spark):
    base = [f"w{i}" for i in range(60)]
    other = [f"u{i}" for i in range(60)]
    rows = [(1, " ".join(base)), (2, " ".join([*base[:-1], "x"])), (2, " ".join(other)), (3, " ".join([*other[:-1], "y"]))]
    for order in (rows, rows[::-1]):
        df = spark.createDataFrame(order, "doc_id long, text string").coalesce(1)
        got = {(r.doc_id, r.component_id, r.kept) for r in neardup.near_duplicates(df).collect()}
        assert got == {(1, 1, True), (2, 1, False), (2, 2, True), (3, 2, False)}
        left = neardup.drop_near_duplicates(df).collect()
        assert sorted((r.doc_id, r.text) for r in left) == sorted([rows[0], rows[2]])
    unnamed = spark.createDataFrame([(None, rows[0][1]), (None, rows[0][1]), (5, rows[2][1]), (None, rows[2][1])], "doc_id long, text string")
    left = [(r.doc_id, r.text) for r in neardup.drop_near_duplicates(unnamed).collect()]
    assert sorted(left, key=repr) == sorted([(None, rows[0][1]), (5, rows[2][1])], key=repr)


def test_odd_documents(spark):
    for k, part in ((3, (17, 20)), (5, (4, 5))):
        rows = neardup.near_duplicates(edge_docs(spark), k, part).collect()
        assert len(rows) == len(edge_rows())
        want = brute([(r[0], r[1]) for r in edge_rows()], k, *part)
        for r in rows:
            if r.doc_id is None:
                assert r.component_id is None and r.kept
            else:
                assert (r.n_shingles, r.component_id) == want[r.doc_id]
                assert r.kept == (r.doc_id == r.component_id)
    left = neardup.drop_near_duplicates(edge_docs(spark))
    assert left.columns == edge_docs(spark).columns
    ids = sorted(str(r.doc_id) for r in left.collect())
    # Of the copies under 1, 2, 2 and no id one row stays; the row without id and text stays.
    named = brute([(x[0], x[1]) for x in edge_rows()], 5, 4, 5)
    assert ids == sorted(["None", *(str(i) for i, (_, c) in named.items() if i == c)])
    assert neardup.near_duplicates(no_docs(spark)).count() == 0
    assert neardup.drop_near_duplicates(no_docs(spark)).count() == 0


def test_words_are_hashed_alike_wherever_they_stand():
    texts = ["Aa bb\tcc", None, "", "x", "\x0bbb  AA\x85 cc ", "é É"]
    hashes, counts = hashing.word_hashes(texts)
    want = [w for t in texts for w in (t or "").encode().lower().split()]
    assert counts.tolist() == [len((t or "").encode().split()) for t in texts]
    groups = {}
    for w, h in zip(want, hashes.tolist(), strict=True):
        assert groups.setdefault(w, h) == h
    assert len(set(groups.values())) == len(groups)


def test_superminhash_estimates_similarity_with_low_variance():
    rng = np.random.default_rng(5)
    m, errors = 64, []
    for _ in range(300):
        pool = rng.integers(0, 1 << 63, 150, dtype=np.uint64)
        a, b = np.unique(pool[:100]), np.unique(pool[50:])
        same = (superminhash(a, m) == superminhash(b, m)).mean()
        errors.append(same - 1 / 3)
    assert abs(np.mean(errors)) < 0.02
    assert np.std(errors) < np.sqrt(1 / 3 * 2 / 3 / m)
    one = superminhash(np.array([7], dtype=np.uint64), m)
    assert len(set((one >> np.uint64(56)).tolist())) == m


def test_components_equal_union_find(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(0, 60)] + [(1000, i) for i in range(1001, 1200)]
    edges += [(rng.randrange(2000, 2300), rng.randrange(2000, 2300)) for _ in range(150)]
    rng.shuffle(edges)
    df = spark.createDataFrame(edges, "a long, b long").repartition(6)
    got = {r.node: r.component for r in connected_components(df).collect()}
    root = {}

    def top(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = top(a), top(b)
        root[max(x, y)] = min(x, y)
    linked = {x for e in edges if e[0] != e[1] for x in e}
    assert got == {x: top(x) for x in linked}
    assert connected_components(df.where(F.lit(False))).count() == 0


def test_similar_sets_below_the_threshold_make_no_pairs():
    n, common = 40, np.arange(1, 25, dtype=np.uint64)
    sets = [np.concatenate([common, np.arange(6, dtype=np.uint64) + np.uint64(100 * (i + 1))]) for i in range(n)]
    sets.append(np.concatenate([sets[0][:-1], [np.uint64(9)]]))
    rows = pa.table(
        {
            "node": pa.array(range(n + 1), pa.int64()),
            "component": pa.array(range(n + 1), pa.int64()),
            "own": pa.array([0] * (n + 1), pa.int32()),
            "band": pa.array([0] * (n + 1), pa.int32()),
            "i": pa.array([0] * (n + 1), pa.int32()),
            "j": pa.array([0] * (n + 1), pa.int32()),
            "signature": [np.zeros(120, np.uint16).tobytes()] * (n + 1),
            "members": [np.unique(s).tobytes() for s in sets],
        }
    )
    assert neardup._meet(rows, (4, 5)) == [(0, n)]


def test_copies_of_one_block_make_a_forest():
    n = 30
    rows = pa.table(
        {
            "node": pa.array(range(n), pa.int64()),
            "component": pa.array(range(n), pa.int64()),
            **{c: pa.array([0] * n, pa.int32()) for c in ("own", "band", "i", "j")},
            "signature": [np.zeros(120, np.uint16).tobytes()] * n,
            "members": [np.array([*range(1, 40), 100 + i], np.uint64).tobytes() for i in range(n)],
        }
    )
    assert len(neardup._meet(rows, (4, 5))) == n - 1
