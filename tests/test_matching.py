import random

import pytest
from test_text import SNAP, rule

from runledger.functions.text import split_lines
from runledger.operators import matching
from pyspark.sql import functions as F


def brute(files, tokens):
    return {
        (path, t) for path, text in files for t in tokens if any(rule(x, t) for x in text.split("\n"))
    }


def matched(spark, files, tokens, literal=False):
    df = spark.createDataFrame(files, "path string, match_text string")
    requests = spark.createDataFrame([(t,) for t in tokens], "branch_hash string")
    rows = matching.match_texts(df, requests, literal=literal).collect()
    pairs = [(r.path, r.branch_hash) for r in rows]
    assert len(pairs) == len(set(pairs))
    return set(pairs)


def random_files(seed, tokens, count=150):
    rng = random.Random(seed)
    files = []
    for i in range(count):
        lines = []
        for _ in range(rng.randint(0, 5)):
            line = rng.choice(tokens)
            if rng.random() < 0.5:
                at = rng.randrange(len(line))
                line = line[:at] + rng.choice("x.-_ ") + line[at + 1 :]
            line = rng.choice(["", "", " ", "x"]) + line + rng.choice(["", "", "462", " more", " "])
            lines.append(line[: rng.randint(1, 60)] if rng.random() < 0.1 else line)
        files.append((f"/f{i}", "\n".join(lines)))
    return files


TOKENS = [
    "v8.5.0", "v8.5.1", f"{SNAP}8_3_0", "v8.3.0b07-12-g8913088", "v8.3.0b07-12-g89130",
    f"{SNAP}8_3_0_beta_snapshot_04-8-g60a38ef", "v9..-g1.", "a-g", ".-g5", "v" * 300 + ".1.2",
]


@pytest.mark.parametrize("seed", [1, 2])
def test_every_plain_token(spark, seed):
    files = random_files(seed, TOKENS)
    assert matched(spark, files, TOKENS) == brute(files, TOKENS)


def test_general_patterns(spark):
    tokens = ["v8.[35].0-g1", "a(b|c)-g+", "v8.5.0", "x-g?1"]
    files = random_files(3, ["v8.3.0-g1", "v8x5x0-g1zzzzz", "abc-ggggggg", "ab-ggggggggg", "x-g1", "v8.5.0"])
    assert matched(spark, files, tokens) == brute(files, tokens)


def test_literal_tokens(spark):
    import re

    files = random_files(4, TOKENS)
    expected = {
        (p, t)
        for p, text in files
        for t in TOKENS
        if any(x.startswith(t) and rule(x, re.escape(t).replace("\\-", "-")) or
               (x.startswith(t) and "-g" in t) or (x.strip() == t and x.startswith(t) and "-g" not in t)
               for x in text.split("\n"))
    }
    assert matched(spark, files, TOKENS, literal=True) == expected


def test_no_request_no_match(spark):
    assert matched(spark, [("/a", "v8.5.0")], []) == set()


def general_tokens(count):
    """Tokens with groups, classes, repeats, alternatives and tokens without required letters."""
    rng = random.Random(8)
    out = ["[0-9]+-g.", ".*-g", "a|b-g", "(?i)V8-g1", "-g?", "x{2}-g1", r"v\\.8-g", "(a(b[c)]d)+)*-g9", "é+-g"]
    while len(set(out)) < count:
        n = rng.randrange(10_000)
        form = rng.choice(["v+8.{0}-g", "v8.[{1}]{0}-g", "(v|w)8.{0}-g", "v8?.{0}-g", "v8.{0}(b)*-g", "v8.{0}|q-g{1}"])
        out.append(form.format(n, n % 10))
    return sorted(set(out))


def test_thousands_of_general_tokens(spark):
    tokens = general_tokens(5000) + ["v8.5.0", "v8.17-g"]
    rng = random.Random(9)
    files = []
    for i in range(120):
        n = rng.randrange(10_000)
        line = rng.choice(["vvv8.{}-gxxxxxxxxxx", "v8x{}-gggggggggg", "w8.{}-gzzzzzzzzzz", "v8.{}bb-ggggggggg",
                           "q-g7{}zzzzzzzzzzz", "V8-g1zzzz{}", "a{}", "xx-g1{}zzz", "v.8-g{}zzzzzzzz", "ééé-g{}"])
        files.append((f"/f{i}", "note\n" + line.format(n) + "\nv8.17-g1"))
    assert matched(spark, files, tokens) == brute(files, tokens)


def test_required_pieces_are_in_every_match(spark):
    import re

    from runledger.operators.postings import required_pieces

    rng = random.Random(10)
    atoms = ["ab", "c", ".", "[xy]", "(de|f)", r"\\.", r"\\d", "g", "(h(i|j)k)", r"\\x41", "[^]z]"]
    patterns = ["", "a|", "(?i)abc", "a++b", "ab*?c", "ab{2}c", "x+?y"]
    for _ in range(300):
        parts = [rng.choice(atoms) + rng.choice(["", "", "", "*", "+", "?", "{0,2}", "+?"]) for _ in range(rng.randint(1, 5))]
        patterns.append("".join(parts) + rng.choice(["", "", "|" + rng.choice(atoms)]))
    patterns = [p.replace("\\\\", "\\") for p in patterns]
    df = spark.createDataFrame([(p,) for p in patterns], "p string")
    found = {r.p: r.a for r in df.select("p", required_pieces(F.col("p")).alias("a")).collect()}
    assert found["ab{2}c"] == [["a", "c"]] and found["ab*?c"] == [["a", "c"]] and found["(?i)abc"] == [[]]
    texts = ["".join(rng.choice(["ab", "c", "x", "de", "f", ".", "7", "g", "hik", "A", "z", "y"]) for _ in range(6)) for _ in range(300)]
    hits = 0
    for p in patterns:
        if "[^]" in p or "++" in p:
            continue  # read differently outside Java
        for m in filter(None, (re.search(p, t) for t in texts)):
            hits += 1
            assert any(all(piece in m[0] for piece in alt) for alt in found[p]), (p, m[0])
    assert hits > 1000


def test_paths_of_jobs(spark):
    paths = spark.createDataFrame(
        [("/develop/hera/x/develop/f",), ("/r/feat_x/jet/f",), ("/develop",), ("/r/developer/hera/f",)],
        "path string",
    )
    jobs = spark.createDataFrame(
        [("hera", "develop"), ("jet", "feat/x"), ("jet", "develop")], "machine string, branch string"
    )
    rows = matching.paths_of_jobs(paths, jobs).collect()
    got = sorted((r.path, r.machine, r.branch) for r in rows)
    assert got == [("/develop/hera/x/develop/f", "hera", "develop"), ("/r/feat_x/jet/f", "jet", "feat/x")]


def test_exact_machine(spark):
    paths = spark.createDataFrame([("/r/develop/xhera/f",), ("/r/develop/hera/f",)], "path string")
    jobs = spark.createDataFrame([("hera", "develop")], "machine string, branch string")
    assert matching.paths_of_jobs(paths, jobs).count() == 2
    exact = matching.paths_of_jobs(paths, jobs, exact=True).collect()
    assert [r.path for r in exact] == ["/r/develop/hera/f"]


def test_lines_and_marks(spark):
    files = spark.createDataFrame(
        [("/a", "hash = v8-g1\nother hash = v9-g22x"), ("/b", "hash= v8-g1")], "path string, text string"
    )
    requests = spark.createDataFrame([("v8-g1",), ("v9-g22",), ("v8",)], "branch_hash string")
    got = {
        (r.path, r.branch_hash)
        for r in matching.containing_mark(files, requests, "hash = ").collect()
    }
    assert got == {("/a", "v8-g1"), ("/a", "v9-g22"), ("/a", "v8")}
    lines = matching.lines_matching(files, "text", "o.her").collect()
    assert [(r.path, r.line_no) for r in lines] == [("/a", 1)]


def test_plan_has_no_nested_loop(spark):
    files = spark.createDataFrame([("/a", "v8.5.0")], "path string, match_text string")
    requests = spark.createDataFrame([("v8.5.0",), ("v8-g1",)], "branch_hash string")
    plan = matching.match_texts(files, requests)._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert files.select(split_lines(F.col("match_text"))).first()[0] == ["v8.5.0"]


def test_few_patterns_do_not_cut_lines_into_grams(spark, monkeypatch):
    from runledger.operators import postings

    rng = random.Random(5)
    lines = ["".join(rng.choice("abc.") for _ in range(rng.randrange(9))) for _ in range(300)] + [None, ""]
    lines = spark.createDataFrame([(x,) for x in lines], "line string")
    rules = spark.createDataFrame([(x,) for x in ("ab+c", "(a|b)ca", "abc|ccc", ".a.b", "b?", "aab")], "pattern string")

    def hits():
        pairs = postings.candidate_pairs(lines, rules).where(F.regexp_like("line", F.col("pattern")))
        return pairs.distinct(), sorted(tuple(r) for r in pairs.distinct().collect())

    near, few = hits()
    assert few and "sequence(" not in near._jdf.queryExecution().toString()
    monkeypatch.setattr(postings, "_FEW", 0)
    assert hits()[1] == few
