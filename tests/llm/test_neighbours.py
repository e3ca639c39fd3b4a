import numpy as np
import pytest
from pyspark.sql import functions as F

from runledger.llm.neighbours import nearest_neighbours

SCHEMA = "vec_id long, embedding array<float>, label int, score string, rank string"


def exact(ids, matrix, queries, k):
    out = {}
    for q in queries:
        scores = (matrix * matrix[ids.index(q)]).sum(axis=1)
        order = sorted((-s, i) for s, i in zip(scores, ids, strict=True) if i != q)[:k]
        out[q] = [(i, -s) for s, i in order]
    return out


def frame(spark, rows):
    return spark.createDataFrame([(*r, 0, "s", "r") for r in rows], SCHEMA)


def found(df, condition, **options):
    out = {}
    for r in nearest_neighbours(df, condition, **options).orderBy("query_id", "rank").collect():
        own = out.setdefault(r.query_id, [])
        own.append((r.vec_id, r.score))
        assert r.rank == len(own)
    return out


def test_recall_and_exact_scores(spark):
    for sf in ("sf0.01", "sf0.1"):
        df = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet")
        rows = df.select("vec_id", "embedding").collect()
        ids = [r.vec_id for r in rows]
        matrix = np.array([r.embedding for r in rows], dtype=np.float64)
        want = exact(ids, matrix, [i for i in ids if i % 20 == 0], 20)
        got = found(df, F.col("vec_id") % 20 == 0)
        assert set(got) == set(want)
        hits = 0
        place = {i: n for n, i in enumerate(ids)}
        for q, near in got.items():
            assert len(near) == 20 and near == sorted(near, key=lambda x: (-x[1], x[0]))
            for i, s in near:
                assert np.isclose(s, matrix[place[i]] @ matrix[place[q]], rtol=1e-12)
            hits += len({i for i, _ in near} & {i for i, _ in want[q]})
        assert hits / (20 * len(want)) > 0.92


@pytest.mark.parametrize("spread", [0.5, 1.0])
def test_recall_of_differing_lengths(spark, spread):
    rng = np.random.default_rng(11)
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding").collect()
    longer = np.exp(rng.normal(scale=spread, size=len(rows)))
    rows = [(r.vec_id, [float(x * f) for x in r.embedding]) for r, f in zip(rows, longer, strict=True)]
    ids = [r[0] for r in rows]
    matrix = np.array([r[1] for r in rows], dtype=np.float32).astype(np.float64)
    want = exact(ids, matrix, [i for i in ids if i % 20 == 0], 20)
    got = found(frame(spark, rows), F.col("vec_id") % 20 == 0)
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in near}) for q, near in want.items())
    assert hits / (20 * len(want)) > 0.92


def test_small_and_odd_tables(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.5, 0.5]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]),
        (6, [inf, 1.0]), (7, [None, 1.0]), (8, []), (9, [1.0, 2.0, 3.0]), (None, [1.0, 1.0]),
        (20, [-1.0, 0.0]), (20, [-1.0, 0.0]), (40, [0.0, 0.0]), (21, [1.0, 0.0]),
    ]
    got = found(frame(spark, rows), F.col("vec_id") % 20 == 0, k=20)
    assert set(got) == {0, 20}
    assert [i for i, _ in got[0]] == [1, 21, 2, 20]
    assert [i for i, _ in got[20]] == [2, 0, 1, 21]
    assert found(frame(spark, rows[3:9]), F.col("vec_id") % 20 == 0) == {}
    assert found(frame(spark, []), F.col("vec_id") % 20 == 0) == {}
    assert found(frame(spark, rows[:1]), F.col("vec_id") % 20 == 0) == {}


def test_common_vector_goes_by_id_over_blocks(spark):
    rows = [(i, [1.0, 1.0] if i % 3 else [1.0, i / 1000]) for i in range(600)]
    ids = [r[0] for r in rows]
    matrix = np.array([r[1] for r in rows], dtype=np.float32).astype(np.float64)
    got = found(frame(spark, rows), F.col("vec_id") % 20 == 0, k=20, block=64, share=1.0)
    want = exact(ids, matrix, [i for i in ids if i % 20 == 0], 20)
    assert {q: [i for i, _ in v] for q, v in got.items()} == {q: [i for i, _ in v] for q, v in want.items()}
