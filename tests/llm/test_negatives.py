import numpy as np
import pytest
from pyspark.sql import functions as F

from runledger.llm.coordinates import CoordinateLists
from runledger.llm.negatives import mine_hard_negatives, whole_vectors

WHOLE = "vec_id long, label long, vector array<long>"
RAW = "vec_id long, embedding array<float>, label int, score string, rank string"


def brute(rows, every=100, positives=5, negatives=10):
    out = []
    for a, (anchor, label, vector) in enumerate(rows):
        if anchor % every:
            continue
        scored = [
            (-sum(x * y for x, y in zip(vector, v, strict=True)), i, own == label)
            for b, (i, own, v) in enumerate(rows)
            if a != b
        ]
        scored.sort(key=lambda s: s[:2])
        for s, p, _ in [x for x in scored if x[2]][:positives]:
            hard = [x for x in scored if not x[2] and 30 * -s <= 100 * -x[0] <= 90 * -s][:negatives]
            out += [(anchor, p, n, i, -s, -t) for n, (t, i, _) in enumerate(hard, 1)]
    return sorted(out)


def got(spark, rows, every=100, **options):
    df = spark.createDataFrame(rows, WHOLE)
    found = mine_hard_negatives(df, F.col("vec_id") % every == 0, **options)
    return sorted(tuple(r) for r in found.collect())


def vectors(seed, n, dim, spread):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(4, dim))
    label = rng.integers(0, 4, size=n)
    lengths = np.exp(rng.normal(scale=spread, size=n))
    raw = (centres[rng.integers(0, 4, size=n)] + rng.normal(size=(n, dim))) * lengths[:, None]
    return [(i, int(label[i]), np.floor(40 * raw[i]).astype(int).tolist()) for i in range(n)]


@pytest.mark.parametrize("spread", [0.0, 1.0])
def test_ranges_lose_no_row(spread):
    rows = vectors(1, 400, 8, spread)
    matrix = np.array([r[2] for r in rows])
    lists = CoordinateLists(matrix, 3)
    spared = 0
    for query in matrix[::20]:
        scores = matrix @ query
        for bound in (-5, 0, 1, int(np.quantile(scores, 0.9)), int(scores.max()), int(scores.max()) + 1):
            found, exact = lists.reaching(query, bound)
            assert found.tolist() == np.flatnonzero(scores >= bound).tolist()
            assert exact.tolist() == scores[found].tolist()
            spared += 400 - len(lists.candidates(query, bound)) if bound > 0 else 0
    assert spared > 1000


def test_large_numbers_stay_exact():
    matrix = np.array([[2**30, 1], [2**30, 2], [2**30, 0]])
    found, scores = CoordinateLists(matrix).reaching(matrix[1], 2**60 + 2)
    assert found.tolist() == [0, 1] and scores.tolist() == [2**60 + 2, 2**60 + 4]


@pytest.mark.parametrize("spread,size,block", [(0.0, 64, 3), (1.0, 50, 100), (1.0, 4096, 4096)])
def test_equals_brute_force(spark, spread, size, block):
    rows = vectors(2, 300, 6, spread)
    rows += [rows[0], rows[7], (20, 1, [0] * 6), (40, 2, [0] * 6), (41, 3, [0] * 6), (301, 2, rows[0][2])]
    assert got(spark, rows, 20, size=size, block=block) == brute(rows, 20)


def test_common_vectors_go_by_id(spark):
    rows = [(i, i % 2, [3, 4] if i % 5 else [3, i]) for i in range(200)]
    assert got(spark, rows, 50, size=32, block=2) == brute(rows, 50)


def test_few_rows(spark):
    assert got(spark, []) == []
    assert got(spark, [(100, 1, [1, 2])]) == []
    assert got(spark, [(1, 1, [1, 2]), (2, 1, [1, 2])]) == []
    rows = [(100, 1, [10, 0]), (1, 1, [10, 0]), (2, 2, [5, 5]), (3, 2, [-5, 5]), (4, 1, [-10, 0])]
    assert got(spark, rows) == brute(rows) == [(100, 1, 1, 2, 100, 50)]


def test_rows_that_take_part(spark):
    nan, inf = float("nan"), float("inf")
    raw = [
        (0, [0.5, -0.001], 1), (1, None, 1), (2, [nan, 1.0], 1), (3, [inf, 1.0], 1), (4, [None, 1.0], 1),
        (5, [1.0, 1.0], None), (None, [1.0, 1.0], 1), (6, [], 1), (7, [1.0], 1), (8, [0.0, 0.0], 2),
    ]
    df = spark.createDataFrame([(*r, "s", "r") for r in raw], RAW)
    kept = sorted((r.vec_id, r.label, r.vector) for r in whole_vectors(df).collect())
    assert kept == [(0, 1, [128, -1]), (8, 2, [0, 0])]
    assert whole_vectors(df.limit(0)).collect() == []
