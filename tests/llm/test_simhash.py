import random
from itertools import pairwise

import pytest
from fixtures import LONG, edge_docs, no_docs
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from runledger.llm.bktree import BkTree, links_within, shard_links
from runledger.llm.graph import connected_components
from runledger.llm.simhash import fingerprint, near_fingerprints
from runledger.llm.words import BY_BLANKS, BY_LETTERS, word_lists


def plain_print(text):
    words = (text or "").encode().lower().split()
    runs = [b" ".join(words[i : i + 3]) for i in range(max(len(words) - 2, min(len(words), 1)))]
    hashes = [xxh64_intdigest(r, 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(nodes, near):
    name = {n: n for n in nodes}
    moved = True
    while moved:
        moved = False
        for a in nodes:
            for b in near[a]:
                if name[b] < name[a]:
                    name[a], moved = name[b], True
    return name


def close(numbers, radius):
    return {a: [b for b in numbers if (a ^ b).bit_count() <= radius] for a in numbers}


def brute(rows):
    prints = [plain_print(t) for _, t in rows]
    distinct = sorted(set(prints))
    name = components(distinct, close(distinct, 3))
    ids = {}
    for (i, _), p in zip(rows, prints, strict=True):
        if i is not None:
            ids[name[p]] = min(i, ids.get(name[p], i))
    return sorted(
        ((i, f"{p:016x}", ids.get(name[p])) for (i, _), p in zip(rows, prints, strict=True)), key=repr
    )


def clusters(seed, n, near):
    draw = random.Random(seed)
    out = set()
    for _ in range(n):
        one = draw.getrandbits(64)
        for _ in range(near):
            out.add(one)
            one ^= 1 << draw.randrange(64) | 1 << draw.randrange(64)
    return sorted(out)


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_words_come_whole_whatever_the_limit():
    text = "Ab c-1\tÉa\n\nxyz " * 50
    for limit in (1, 7, 1 << 20):
        assert [w for ws in word_lists(text.encode(), BY_BLANKS, limit) for w in ws] == text.encode().lower().split()
    assert list(word_lists(b"A-b\x00c\x7f9~\xc3\xa9Z", BY_LETTERS)) == [[b"a", b"b", b"c", b"9", b"\xc3\xa9z"]]
    assert [w for ws in word_lists(None, BY_BLANKS) for w in ws] == []


def test_hash_is_the_one_spark_has(spark):
    df = spark.sql("SELECT xxhash64('ab c é') AS h")
    assert df.first().h & 0xFFFFFFFFFFFFFFFF == xxh64_intdigest("ab c é".encode(), 42)


def test_fingerprint_of_any_text():
    for text in (None, "", " \n", "one", "One two", "a b c", "a b c a b c a b c", LONG):
        assert fingerprint(text.encode() if text else None, 3) & 0xFFFFFFFFFFFFFFFF == plain_print(text)


@pytest.mark.parametrize("radius", [0, 1, 3])
def test_tree_finds_all_within(radius):
    numbers = clusters(1, 40, 6)
    tree = BkTree()
    for n in [*numbers, numbers[0]]:
        tree.add(n)
    near = close(numbers, radius)
    for n in [*numbers, 0, (1 << 64) - 1]:
        assert sorted(tree.within(n, radius)) == sorted(near.get(n, [x for x in numbers if (x ^ n).bit_count() <= radius]))
    assert BkTree().within(5, 3) == []


def test_a_shard_gives_a_forest():
    one = clusters(2, 1, 60)
    links = shard_links(one, [], 3)
    assert len(links) == len(one) - 1
    assert len({a for pair in pairwise(one) for a in pair}) == len(one)


@pytest.mark.parametrize("limit", [2, 16, 1024])
def test_shards_of_any_size_lose_no_link(spark, limit):
    # Numbers that share most bits make hot shards on every level.
    numbers = clusters(3, 30, 8) + [1 << i for i in range(40)] + [(1 << i) | 1 << 63 for i in range(20)] + [0]
    numbers = sorted(set(numbers))
    df = spark.createDataFrame([(signed(n),) for n in numbers], "number long")
    found = connected_components(links_within(df, 3, limit))
    got = {r.node & 0xFFFFFFFFFFFFFFFF: r.component for r in found.collect()}
    name = components(numbers, close(numbers, 3))
    groups = {}
    for n in numbers:
        groups.setdefault(name[n], set()).add(got.get(n, signed(n)))
    assert all(len(g) == 1 for g in groups.values())
    assert len(set().union(*groups.values())) == len(groups)


def test_whole_table_equals_brute_force(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = sorted((tuple(r) for r in near_fingerprints(docs).collect()), key=repr)
    assert got == brute(rows)


def test_odd_documents(spark):
    docs = edge_docs(spark)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert sorted((tuple(r) for r in near_fingerprints(docs).collect()), key=repr) == brute(rows)
    assert near_fingerprints(no_docs(spark)).collect() == []
    unnamed = docs.withColumn("doc_id", F.lit(None).cast("long"))
    assert {r.component_id for r in near_fingerprints(unnamed).collect()} == {None}


def test_hot_copies_and_chains(spark):
    rows = [(i, "the same words stand here " * 3) for i in range(300)] + [(1000 + i, None) for i in range(100)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((tuple(r) for r in near_fingerprints(df).collect()), key=repr) == brute(rows)
