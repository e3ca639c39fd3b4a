"""Documents with every odd case, for all operators."""

DOC_SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, size string, kept string, "
    "score string, shard string, `rank` string"
)

LONG = " ".join(f"wort{i % 977}" for i in range(30_000))


def edge_rows():
    base = "the quick brown fox jumps over the lazy dog and runs far away from all of them"
    near = base.replace("far away", "far off")
    rows = [
        (1, base, "en", "a"),
        (2, base, "en", "b"),
        (2, base, "en", "b"),
        (3, near, "en", None),
        (4, None, "en", "a"),
        (5, "", None, "c"),
        (6, "  \n\t ", "de", "c"),
        (7, "ein", "de", "é"),
        (8, LONG, "de", "a"),
        (None, base, "en", "a"),
        (None, None, None, None),
        (9, "12345 !!! 😀", "en", "b"),
        (10, "zwei worte", "de", "é"),
        (11, "a\nb\nc\nd\na\nb\nc\nx", "en", "a"),
    ]
    return [(*r, len(r[1] or ""), "s", "k", "x", "y", "z") for r in rows]


def edge_docs(spark):
    return spark.createDataFrame(edge_rows(), DOC_SCHEMA)


def no_docs(spark):
    return spark.createDataFrame([], DOC_SCHEMA)


def words(text):
    return (text or "").encode().lower().split()


def shingles(text, k):
    w = words(text)
    if len(w) < k:
        return {tuple(w)} if w else set()
    return set(zip(*[w[i:] for i in range(k)], strict=False))
