import random

from fixtures import LONG, edge_docs, no_docs, shingles

from runledger.llm import contamination, linedup


def test_containment_equals_brute_force(spark):
    rng = random.Random(1)
    items = [(i, " ".join(f"v{rng.randrange(300)}" for _ in range(n))) for i, n in enumerate([3, 5, 8, 20, 40, 90])]
    docs = []
    for d in range(120):
        own = [f"u{rng.randrange(300)}" for _ in range(rng.randrange(200))]
        part = rng.choice(items)[1].split()
        cut = rng.randrange(len(part) // 3 + 1)
        own[len(own) // 2 : len(own) // 2] = part[cut:]
        docs.append((d, " ".join(own)))
    docs.append((120, items[0][1].upper()))
    docs.append((121, "v1 " + items[0][1] + " v2 v3"))
    want = set()
    for d, text in docs:
        for i, item in items:
            need = shingles(item, 5)
            own = shingles(text, min(5, len(item.split())))
            if need and 5 * len(need & own) >= 4 * len(need):
                want.add((d, i, len(need), len(need & own)))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    it = spark.createDataFrame(items, "item_id long, text string")
    got = {tuple(r) for r in contamination.contained_items(df, it).collect()}
    assert got == want and len(want) > 30
    clean = {r.doc_id for r in contamination.drop_contaminated(df, it).collect()}
    assert clean == {d for d, _ in docs} - {w[0] for w in want}


def test_containment_of_odd_rows(spark):
    items = spark.createDataFrame(
        [(1, None), (2, ""), (3, "ein"), (4, " ".join(LONG.split()[5000:5030])), (None, "zwei worte"),
         (3, "ein"), (5, "jumps over the lazy dog and runs")], "item_id long, text string")
    docs = edge_docs(spark)
    got = {(r.doc_id, r.item_id) for r in contamination.contained_items(docs, items).collect()}
    assert got == {(7, 3), (8, 4), (1, 5), (2, 5), (3, 5)}
    short = spark.createDataFrame([(6, "Fox jumps"), (7, "fox  over"), (8, "c d a"), (9, "b"), (10, "worte")],
                                  "item_id long, text string")
    found = {tuple(r) for r in contamination.contained_items(docs, short).collect()}
    assert found == {(1, 6, 1, 1), (2, 6, 1, 1), (3, 6, 1, 1), (11, 8, 1, 1), (11, 9, 1, 1), (10, 10, 1, 1)}
    left = contamination.drop_contaminated(docs, items)
    assert left.columns == docs.columns and left.count() == docs.count() - 6
    assert contamination.contained_items(no_docs(spark), items).count() == 0
    assert contamination.contained_items(docs, items.limit(0)).count() == 0


def brute_lines(rows, m):
    """Numbers of lines in windows that stand at an earlier place too."""
    seen, gone = set(), {}
    for name, text in sorted(rows):
        lines = text.split("\n")
        full = [(i, x) for i, x in enumerate(lines) if x.strip(" \t\n\x0b\x0c\r")]
        for at in range(len(full) - m + 1):
            key = tuple(x for _, x in full[at : at + m])
            if key in seen:
                gone.setdefault(name, set()).update(i for i, _ in full[at : at + m])
            seen.add(key)
    return gone


def test_line_runs_equal_brute_force(spark):
    rng = random.Random(2)
    blocks = [[f"b{b} l{i}" for i in range(rng.randrange(2, 12))] for b in range(6)]
    rows = []
    for d in range(80):
        lines = []
        for _ in range(rng.randrange(6)):
            lines += rng.choice(blocks) if rng.random() < 0.5 else [f"own {d} {rng.randrange(9)}", ""]
        rows.append((d, "\n".join(lines)))
    rows.append((80, "x\nx\nx\nx\nx\nx"))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for m in (1, 2, 3, 5):
        got = {r.doc_id: set(r.removed) for r in linedup.repeated_lines(df, m).collect()}
        assert got == brute_lines(rows, m)
    cut = {r.doc_id: r.text for r in linedup.without_repeated_lines(df, 3).collect()}
    gone = brute_lines(rows, 3)
    for name, text in rows:
        kept = [x for i, x in enumerate(text.split("\n")) if i not in gone.get(name, ())]
        assert cut[name] == "\n".join(kept)


def test_shorter_runs_count_by_their_words(spark):
    rng = random.Random(3)
    blocks = [[f"b{b} l{i}" + " w" * rng.choice([0, 3, 9]) for i in range(rng.randrange(1, 6))] for b in range(8)]
    rows = []
    for d in range(60):
        lines = []
        for _ in range(rng.randrange(5)):
            lines += [*rng.choice(blocks), f"own {d} {rng.randrange(9)}", ""]
        rows.append((d, "\n".join(lines)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want, seen = brute_lines(rows, 4), set()
    before = sum(len(x) for x in want.values())
    for name, text in rows:
        full = [(i, x) for i, x in enumerate(text.split("\n")) if x.strip()]
        for m in (1, 2, 3):
            for at in range(len(full) - m + 1):
                key = tuple(x for _, x in full[at : at + m])
                if key in seen and sum(len(x.split()) for x in key) > 10:
                    want.setdefault(name, set()).update(i for i, _ in full[at : at + m])
                seen.add(key)
    got = {r.doc_id: set(r.removed) for r in linedup.repeated_lines(df, 4, 10).collect()}
    assert got == want and sum(len(x) for x in want.values()) > before


def test_texts_decide_not_ids(spark):
    rows = [(1, "a b c d"), (2, "p q r s t"), (2, "a b c z w"), (2, "p q r s t"), (None, "a b c d")]
    rows = [(i, t.replace(" ", "\n")) for i, t in rows]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = sorted(((r.doc_id, r.text.replace("\n", " "), r.n_removed) for r in linedup.without_repeated_lines(df).collect()), key=repr)
    # Lines that stand nowhere else stay; of one id's texts only the one with a copy loses lines.
    assert out == [(1, "a b c d", 0), (2, "p q r s t", 0), (2, "p q r s t", 0), (2, "z w", 3), (None, "a b c d", 0)]


def test_line_runs_of_odd_documents(spark):
    docs = edge_docs(spark)
    rows = linedup.without_repeated_lines(docs).collect()
    assert len(rows) == docs.count()
    by_id = {r.doc_id: r for r in rows if r.doc_id is not None}
    assert by_id[11].text == "a\nb\nc\nd\nx" and (by_id[11].n_lines, by_id[11].n_removed) == (8, 3)
    assert by_id[4].text is None and by_id[4].n_lines == 0
    assert all(r.n_removed == 0 for r in rows if r.doc_id != 11)
    assert linedup.without_repeated_lines(no_docs(spark)).count() == 0
