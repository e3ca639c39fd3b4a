import math

import numpy as np
from fixtures import edge_docs, edge_rows, no_docs, words
from pyspark.sql import functions as F

from runledger.llm import mixing, sharding


def test_mix_of_odd_documents(spark):
    rows = mixing.mix_sources(edge_docs(spark)).collect()
    assert len(rows) == len(edge_rows())
    sizes = {}
    for r in edge_rows():
        sizes[r[3]] = sizes.get(r[3], 0) + len(words(r[1]))
    targets = {r.source: r.target for r in rows}
    for r in rows:
        assert r.size == len(words(r.text)) and r.source_size == sizes[r.source]
        assert 0 <= r.taken <= 2 * r.size and r.taken == r.repeats * r.size
        assert r.kept == "k"
    assert all(t <= 2 * sizes[s] for s, t in targets.items())
    assert math.isclose(sum(targets.values()), 1.5 * sum(sizes.values()))
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None]
    free = {s: t / w for s, w, t in zip(order, [5, 2, 1, 5, 2], [targets[s] for s in order], strict=True)
            if t < 2 * sizes[s]}
    assert len({round(v, 9) for v in free.values()}) <= 1
    again = {(r.doc_id, r.text, r.taken) for r in mixing.mix_sources(edge_docs(spark)).collect()}
    assert again == {(r.doc_id, r.text, r.taken) for r in rows}


def test_taken_words_come_near_the_target(spark):
    docs = spark.range(4000).select(
        F.col("id").alias("doc_id"),
        F.repeat(F.lit("w "), (F.col("id") % 17 + 1).cast("int")).alias("text"),
        F.concat(F.lit("s"), (F.col("id") % 3 * F.col("id") % 5).cast("string")).alias("source"),
    )
    mixed = mixing.mix_sources(docs)
    sums = mixed.groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("g"))
    for r in sums.collect():
        assert abs(r.t - r.g) <= 9
    repeated = mixing.repeat_documents(mixed)
    assert repeated.columns == docs.columns
    assert repeated.count() == mixed.agg(F.sum("repeats")).first()[0]


def test_nothing_to_mix(spark):
    assert mixing.mix_sources(no_docs(spark)).count() == 0
    blank = edge_docs(spark).where("text IS NULL OR text = ''")
    assert {r.taken for r in mixing.mix_sources(blank).collect()} == {0}


def test_hilbert_curve_visits_neighbours(spark):
    bits, n = 3, 3
    side = 1 << bits
    cells = spark.range(side**n).select(
        *[F.expr(f"int(id div {side**i} % {side})").alias(f"c{i}") for i in range(n)]
    )
    at = sharding.hilbert_index([F.col(f"c{i}") for i in range(n)], bits)
    rows = cells.withColumn("at", at).orderBy("at").collect()
    assert [r["at"] for r in rows] == list(range(side**n))
    path = np.array([r[:n] for r in rows])
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def check_rows_law(rows, n_shards):
    counts = [0] * n_shards
    slots = [set() for _ in range(n_shards)]
    for r in rows:
        counts[r.shard] += 1
        slots[r.shard].add(r.slot)
    assert max(counts) - min(counts) <= 1
    assert all(s == set(range(c)) for s, c in zip(slots, counts, strict=True))


def test_shards_of_odd_documents(spark):
    import zlib

    for n in (1, 4, 40):
        rows = sharding.shard_documents(edge_docs(spark), n).collect()
        assert len(rows) == len(edge_rows())
        check_rows_law(rows, n)
    want = sorted(
        (str(r[0]), len((r[1] or "").encode()) + 16, str(zlib.crc32(r[1].encode()) if r[1] is not None else None))
        for r in edge_rows()
    )
    assert sorted((str(r.doc_id), r.size, str(r.text_crc32)) for r in rows) == want
    assert {(r.law, r.grown_shard) for r in rows} == {("rows", None)}
    assert sharding.shard_documents(no_docs(spark)).count() == 0


def test_shards_of_a_table_and_their_files(spark, small, tmp_path):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    corpus = sharding.shard_corpus(docs).cache()
    rows = corpus.collect()
    check_rows_law(rows, 40)
    order = [r.curve for r in sorted(rows, key=lambda r: (r.shard, r.slot))]
    assert order == sorted(order)
    digest = sharding.shard_documents(docs)
    assert digest.exceptAll(corpus.select(digest.columns)).count() == 0
    sharding.write_shards(corpus, str(tmp_path / "shards"))
    back = spark.read.parquet(str(tmp_path / "shards"))
    assert back.select(docs.columns).exceptAll(docs).count() == 0 and back.count() == docs.count()
    check_rows_law(back.collect(), 40)


def curve_place(cells, bits):
    """Hilbert index of a cell, from the definition of the transposed index."""
    x, n = list(cells), len(cells)
    q = 1 << (bits - 1)
    while q > 1:
        for i in range(n):
            if x[i] & q:
                x[0] ^= q - 1
            else:
                t = (x[0] ^ x[i]) & (q - 1)
                x[0] ^= t
                x[i] ^= t
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t, q = 0, 1 << (bits - 1)
    while q > 1:
        if x[n - 1] & q:
            t ^= q - 1
        q >>= 1
    x = [v ^ t for v in x]
    return int("".join(str(v >> b & 1) for b in range(bits - 1, -1, -1) for v in x), 2)


def test_query_equals_brute_force(spark, small):
    import zlib

    from xxhash import xxh64_intdigest

    from runledger.llm.catalog import QUERIES

    rows = []
    for r in spark.read.parquet(f"{small}/documents.parquet").collect():
        data = (r.text or "").encode()
        size, steps = len(data) + 16, sharding.BITS and (1 << sharding.BITS) // 32
        names = [zlib.crc32(v.encode()) % 256 if v is not None else 0 for v in (r.lang, r.source)]
        cell = (*names, min(int(np.floor(np.log2(max(size, 1)) * steps)), 255))
        digest = xxh64_intdigest(data, 42)
        rows.append((curve_place(cell, 8), size, zlib.crc32(data), digest - (digest >> 63 << 64), r.doc_id, cell))
    least = {}
    for r in rows:
        least[r[1], r[3]] = min(least.get((r[1], r[3]), r[0]), r[0])
    order = sorted((least[r[1], r[3]], *r[1:]) for r in rows)
    want, n = [], len(order)
    for place, (curve, size, crc, _, doc_id, cell) in enumerate(order):
        shard = place * 40 // n
        want.append((doc_id, size, crc, "rows", shard, place - -(-shard * n // 40), None, *cell, curve))
    got = [tuple(r) for r in QUERIES["op9_hilbert_shards"](spark, small).collect()]
    assert sorted(got) == sorted(want)


def test_equal_texts_lie_together(spark):
    rows = [(i, f"text {i % 30}", "abcd"[i % 4], f"s{i % 7}") for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    found = {r.doc_id: r for r in sharding.shard_documents(docs, 40).collect()}
    check_rows_law(found.values(), 40)
    at = sorted(found, key=lambda i: (found[i].shard, found[i].slot))
    runs = [rows[i][1] for i in at]
    assert sum(x != y for x, y in zip(runs, runs[1:], strict=False)) == 29
    # Twenty copies over shards of fifteen rows: a group lies on two or three neighbours.
    for text in set(runs):
        shards = {found[i].shard for i in found if rows[i][1] == text}
        assert max(shards) - min(shards) <= 2


def test_rows_that_share_an_id_keep_their_columns(spark):
    rows = [(1, "a b", "x", "p"), (1, "c d", "y", "q"), (None, "e", None, None), (1, "a b", "x", "p"), (2, None, "z", "r")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard string, source string")
    docs = docs.withColumn("lang", F.lit("en"))
    out = sharding.shard_corpus(docs, 3).collect()
    assert sorted(((r.doc_id, r.text, r.source) for r in out), key=repr) == sorted(((r[0], r[1], r[3]) for r in rows), key=repr)
    check_rows_law(out, 3)
