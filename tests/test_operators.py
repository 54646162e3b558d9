import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from knotwork.functions import classify, stats
from knotwork.functions import text as X
from knotwork.functions.keys import staged, trimmed
from knotwork.operators import similar
from knotwork.operators.budget import pack, pack_groups, tokens
from knotwork.operators.graph import closure, degrees
from knotwork.operators.greedy import fold_repeats, star_clusters
from knotwork.operators.intervals import folder_of, folders_above, overlaps
from knotwork.operators.ranking import first_by, severity_rank, smallest, top_by
from knotwork.operators.resolve import resolve_imports

EDGES = [("a", "b"), ("b", "c"), ("c", "a"), ("d", "b"), ("e", "d"), ("x", "x"), ("f", "a"), ("f", "d")]


def test_closure_cycle_diamond_and_hops(spark, rows):
    e, s = spark.createDataFrame(EDGES, "src string, dst string"), spark.createDataFrame([("b",)], "id string")
    assert rows(closure(e, s, 1)) == [("a", 1), ("d", 1)]
    assert rows(closure(e, s, 2)) == [("a", 1), ("c", 2), ("d", 1), ("e", 2), ("f", 2)]
    assert rows(closure(e, s, 5)) == rows(closure(e, s, 2))  # b itself is a seed and stays out
    assert rows(closure(e, s, 2, reverse=False)) == [("a", 2), ("c", 1)]


def test_closure_self_loop_two_seeds_and_empty(spark, rows):
    e = spark.createDataFrame(EDGES, "src string, dst string")
    assert rows(closure(e, spark.createDataFrame([("x",)], "id string"), 3)) == []
    assert rows(closure(e, spark.createDataFrame([("b",), ("a",), ("a",), (None,)], "id string"), 1)) == [("c", 1), ("d", 1), ("f", 1)]
    assert rows(closure(e, spark.createDataFrame([], "id string"), 2)) == []


def test_closure_grows_with_hops(spark):
    r = random.Random(3)
    e = spark.createDataFrame([(str(r.randrange(40)), str(r.randrange(40))) for _ in range(80)], "src string, dst string")
    s = spark.createDataFrame([("1",), ("2",)], "id string")
    near, far = ({tuple(x) for x in closure(e, s, h).collect()} for h in (2, 3))
    assert near <= far


def test_degrees(spark, rows):
    assert ("x", 1, 1) in rows(degrees(spark.createDataFrame(EDGES, "src string, dst string")))


def test_overlaps_equals_brute_force(spark, rows):
    r = random.Random(5)
    span = lambda k: (r.choice(["f", "g", None]), (lo := r.randrange(500)), lo + r.choice([0, 1, 5, 300]), k)
    left, right = [span(i) for i in range(80)], [span(i) for i in range(80)]
    got = rows(overlaps(spark.createDataFrame(left, "file string, lo int, hi int, l int"), spark.createDataFrame(right, "file string, lo int, hi int, r int")))
    assert got == sorted((a[3], b[3]) for a in left for b in right if a[0] and a[0] == b[0] and a[1] <= b[2] and b[1] <= a[2])


def test_folders(spark):
    df = spark.createDataFrame([("src/api/x.ts",), ("root.ts",), ("",)], "p string")
    got = [tuple(x) for x in df.select(folders_above(F.col("p")), folder_of(F.col("p"))).collect()]
    assert got == [(["src", "src/api"], "src/api"), ([], ""), ([], "")]


def test_ranking(spark, rows):
    df = spark.createDataFrame([("s", "high", 3), ("s", "high", 1), ("s", None, 2), ("s", "low", 9), ("t", "odd", 5)], "g string, severity string, k int")
    order = [severity_rank("severity").desc(), "k"]
    assert rows(top_by(df, ["g"], order, 2, "pos"), "g", "k", "pos") == [("s", 1, 1), ("s", 3, 2), ("t", 5, 1)]
    assert rows(first_by(df, ["g"], order), "k") == [(1,), (5,)]
    assert rows(smallest(df, ["g"], "k", "severity")) == [("s", "high"), ("t", "odd")]


def test_jaccard(spark):
    t = lambda s: X.lexical_tokens(F.lit(s))
    pairs = [("", "", 0.0), ("the a", "of", 0.0), ("alpha beta", "beta alpha", 1.0), ("alpha beta", "alpha gamma", 1 / 3), (None, "alpha", 0.0)]
    for a, b, want in pairs:
        row = spark.range(1).select(X.jaccard(t(a), t(b)).alias("x"), X.jaccard(t(b), t(a)).alias("y")).first()
        assert row.x == pytest.approx(want) and row.x == row.y


def test_identifier_and_tokens(spark):
    row = spark.range(1).select(X.split_identifier(F.lit("HTTPError_retryCount2")).alias("a"), X.code_tokens(F.lit("const backoffLimit = backoff_limit + HTTPError; // the new value")).alias("b"), X.code_tokens(F.lit("")).alias("c"), X.code_tokens(F.lit("a1 bb ccc ddd"), 1).alias("d")).first()
    assert row.a == ["http", "error", "retry", "count2"] and row.b == ["backoff", "limit", "http", "error"] and row.c == [] and row.d == ["ccc"]


def test_js_round(spark):
    r = spark.range(1).select(X.js_round(F.lit(2.5)).alias("a"), X.js_round(F.lit(-2.5)).alias("b"), X.js_round(F.lit(0.345), 2).alias("c")).first()
    assert (r.a, r.b, r.c) == (3, -2, pytest.approx(0.35, abs=0.011))


def test_wilson(spark):
    low, high = stats.wilson(F.col("h"), F.col("n"))
    got = [tuple(x) for x in spark.createDataFrame([(0.0, 0.0), (0.0, 5.0), (5.0, 5.0), (3.0, 4.0)], "h double, n double").select(low, high).collect()]
    assert got[0] == (0.0, 1.0) and got[1][0] == 0.0 and got[2][1] == pytest.approx(1.0) and 0.3 < got[3][0] < 0.75 < got[3][1] < 1


@pytest.mark.parametrize(
    ("text", "want", "hits"),
    [
        ("key sk-ant-" + "a1" * 12, "key [REDACTED]", 1),
        ("AKIA" + "ABCD1234" * 2, "[REDACTED]", 1),
        ("ghp_" + "x" * 24 + " and github_pat_" + "y" * 24, "[REDACTED] and [REDACTED]", 2),
        ("api_key: abcdef1234567890", "api_key: [REDACTED]", 1),
        ("DB_PASSWORD=hunter22x", "DB_PASSWORD=[REDACTED]", 1),
        ("-----BEGIN RSA PRIVATE KEY-----\nabc\n-----END RSA PRIVATE KEY-----", "[REDACTED]", 1),
        ("eyJ" + "a" * 12 + "." + "b" * 12, "[REDACTED]", 1),
        ("xoxb-1234567890-abc", "[REDACTED]", 1),
        ("an ordinary sentence about tokens.", "an ordinary sentence about tokens.", 0),
    ],
)
def test_redaction(spark, text, want, hits):
    df = spark.createDataFrame([(text,)], "t string")
    assert tuple(df.select(*classify.redacted(F.col("t"))).first()) == (want, hits)


def test_classifiers(spark):
    c = lambda f, s: spark.range(1).select(f(F.lit(s)).alias("x")).first().x
    assert c(classify.intent_of, "Please fix the bug in the parser") == "debug"
    assert c(classify.intent_of, "Add a test") == "edit" and c(classify.intent_of, "") == "unknown"
    assert c(classify.risk_topics, "Refund the invoice and DELETE the session") == ["auth", "payments", "destructive_actions"]
    assert c(classify.corrections, "Don't touch generated files; add unit tests") == ["test_coverage", "generated_files"]


def test_pack():
    assert tokens("") == 0 and tokens("abcde") == 2
    big, small = ("## A", ["x" * 400]), ("## B", ["y" * 8, "z" * 400])
    assert pack([big, small], 0) == [("## A", 1, 0), ("## B", 2, 0)]
    assert pack([big, small], 20) == [("## A", 0, 1), ("## B", 1, 1)]
    for budget in range(1, 60):
        kept = pack([("h", ["aaaa"] * 9), ("h", ["bbbb"] * 9)], budget)
        assert sum((2 + 2 * k) if k else 0 for _, k, _ in kept) <= budget


def test_pack_groups(spark, rows):
    df = spark.createDataFrame([("s", "N", 1, 2, "b" * 8), ("s", "N", 1, 1, "a" * 8), ("s", "I", 2, 1, "c" * 400)], "k string, section string, section_order int, position int, item string")
    assert rows(pack_groups(df, "k", 12)) == [("s", "I", 0, 1), ("s", "N", 2, 0)]


def test_star_is_no_component(spark, rows):
    sets = [["a", "b", "c"], ["a", "b", "d"], ["b", "d", "e"], ["a", "c", "f"]]
    df = spark.createDataFrame([("s", i, i, t, 1) for i, t in enumerate(sets)], "g string, ord bigint, key bigint, tokens array<string>, n bigint")
    assert rows(star_clusters(df, "g", 0.5, 3)) == [("s", 0, 3)]  # row 2 resembles row 1, not the head
    assert rows(star_clusters(df, "g", 0.5, 4)) == []


def test_fold_last_of_equals_wins(spark, rows):
    sets = [["a", "b"], ["a", "c", "d"], ["a"], ["q"]]
    df = spark.createDataFrame([("s", i, i, t, c) for i, (t, c) in enumerate(zip(sets, [0.2, 0.3, 0.9, None]))], "g string, ord bigint, key bigint, tokens array<string>, confidence double")
    assert rows(fold_repeats(df, "g", 0.5)) == [("s", 0, 2, 0.9), ("s", 1, 1, 0.3), ("s", 3, 1, 0.0)]



def test_resolve_imports(spark, rows):
    calls = spark.createDataFrame([("m.ts", "f"), ("m.ts", "g"), ("m.ts", "h"), ("o.ts", "f")], "file string, callee string")
    imports = spark.createDataFrame([("m.ts", "f", "i0", "foo"), ("m.ts", "g", "lib", "bar"), ("m.ts", "h", "i0", "gone")], "file string, local string, module string, imported string")
    exports = spark.createDataFrame([("lib", "bar"), ("deep", "foo")], "module string, name string")
    again = spark.createDataFrame([("i0", "foo", "i1", "foo"), ("i1", "foo", "i2", "foo"), ("i2", "foo", "deep", "foo"), ("i0", "gone", "i0", "gone")], "module string, name string, from_module string, from_name string")
    assert rows(resolve_imports(calls, imports, exports, again)) == [("m.ts", "f", "deep", "foo"), ("m.ts", "g", "lib", "bar")]
    assert rows(resolve_imports(calls, imports, exports, again, 2), "callee") == [("g",)]


def test_trimmed_and_staged(spark):
    df = spark.createDataFrame([("\u00a0 a b\t",), ("  ",), (None,)], "s string")
    assert [r[0] for r in df.select(trimmed("s")).collect()] == ["a b", None, None]
    col = staged({"x": F.lit(2)}, lambda c: {"y": c("x") + 1}, lambda c: {"z": c("x") * c("y")})
    assert spark.range(1).select(col.alias("r")).first().r.asDict() == {"x": 2, "y": 3, "z": 6}


def test_sequences_against_windows(spark):
    import random

    from knotwork.operators.sequences import carried, numbered, picked

    r = random.Random(3)
    data = [(r.choice(["hot", "hot", "a", None]), r.choice([None, *range(50)]), i, r.choice([None, None, "x", "y"]), r.choice([None, r.random() * 9])) for i in range(500)]
    df = spark.createDataFrame(data, "k string, t int, i int, v string, d double").repartition(4)
    part = F.floor(F.col("t") / 7)
    want, last, values = {}, {}, {}
    for k in {x[0] for x in data}:
        rows = sorted((x for x in data if x[0] == k), key=lambda x: (x[1] is not None, x[1] or 0, x[2]))
        seen = None
        for n, x in enumerate(rows, 1):
            want[x[2]], last[x[2], False] = n, seen
            seen = x[3] if x[3] is not None else seen
            last[x[2], True] = seen
        values[k] = sorted(x[4] for x in rows if x[4] is not None)
    assert {x.i: x.n for x in numbered(df, ["k"], part, ["t", "i"], "n").collect()} == want
    for own in (True, False):
        assert {x.i: x.c for x in carried(df, ["k"], part, ["t", "i"], "v", "c", own).collect()} == {i: v for (i, o), v in last.items() if o == own}
    got = {(x.k, x.percent): x.d for x in picked(df, ["k"], "d", "i", [50, 95], 0.5).collect()}
    assert got == {(k, p): v[min(len(v) - 1, p * len(v) // 100)] for k, v in values.items() for p in (50, 95)}
    assert numbered(df.limit(0), ["k"], part, ["t"], "n").collect() == picked(df.limit(0), ["k"], "d", "i", [50]).collect() == []


def test_pattern_matches_against_a_loop(spark):
    from knotwork.operators.patterns import pattern_matches

    names = ["ab", "a.b", "x/b", "abc", "b", "cab", "", None, "ünï.b"]
    patterns = ["b", "ab*", "*ab", "a.b", "*", "zz", None]
    fits = lambda s, p: s.startswith(p[:-1]) if p.endswith("*") else s.endswith(p[1:]) if p.startswith("*") else s == p or s.endswith("." + p) or s.endswith("/" + p)
    df = lambda xs, c: spark.createDataFrame([(x,) for x in xs], f"{c} string")
    got = {(r.name, r.pattern) for r in pattern_matches(df(names, "name"), df(patterns, "pattern")).collect()}
    assert got == {(s, p) for s in names if s for p in patterns if p and p != "*" and fits(s, p)} | {(s, "*") for (s, p) in got if p == "*"}
    files = ["src/a/x.ts", "src/ab/y.ts", "src/a"]
    globs = ["src/a/*", "src/a**", "src/a"]
    got = {(r.name, r.pattern) for r in pattern_matches(df(files, "name"), df(globs, "pattern"), files=True).collect()}
    assert got == {("src/a/x.ts", "src/a/*"), *((f, "src/a**") for f in files), ("src/a", "src/a")}
    assert pattern_matches(df([], "name"), df(patterns, "pattern")).collect() == []


def test_folded_weights_out_of_order(spark, tmp_path):
    import datetime as dt

    from knotwork.streaming import ops as S

    rows = [("f", "s", dt.datetime(2026, 1, 1) + dt.timedelta(minutes=i), i, 1.0 if i % 3 else 0.3) for i in range(300)]
    schema = "label string, id string, ts timestamp, seq bigint, signal double"
    for n, part in enumerate((rows[200:], rows[:100], rows[100:200])):  # later ones first
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    got = S.drain(S.folded_weights(stream), "update").orderBy(F.desc("touches")).first()
    weight = 0.0
    for *_, signal in rows:
        weight = 0.3 * signal + 0.7 * weight
    assert got.touches == 300 and abs(got.weight - weight) < 1e-12


@pytest.mark.parametrize("block", [64, 16_384])
def test_similar_sets_by_blocks_equals_brute_force(spark, monkeypatch, block):
    """A hot key of several blocks, small keys, words common and rare, and a score at the threshold; no side goes to the driver."""
    monkeypatch.setattr(similar, "BLOCK", block)
    r = random.Random(7)
    common, rare = [f"w{k}" for k in range(12)], [f"r{k}" for k in range(900)]

    def sets(n, at):
        return [(at + k, "hot" if k % 5 else f"k{k % 50}", " ".join(sorted({*r.sample(common, r.randint(1, 5)), *r.sample(rare, r.randint(0, 2))})), 1 + k % 3) for k in range(n)]

    left, right = sets(300, 0), [*sets(260, 1000), (5000, "hot", "w1 w2 w3 w4 w5 w6 w7", 1)]
    left.append((999, "hot", " ".join(f"w{k}" for k in range(1, 11)), 1))
    schema = "id bigint, keys string, t string, n bigint"
    a, b = spark.createDataFrame(left, schema), spark.createDataFrame(right, schema)

    def pairs(x, y, least):
        for i, k, t, _ in x:
            u = set(t.split())
            for o, l, s, n in y:
                v = set(s.split())
                if k == l and len(u & v) / len(u | v) >= least:
                    yield i, o, n, len(u & v), len(u | v)

    best: dict = {}
    for i, o, _, c, every in pairs(left, right, 0.7):
        best[i] = min(best.get(i, (0, 0, 0, 0)), (-round(c / every, 6), o, c, every))
    found = similar.similar_sets(a, b, 0.7, best=True)
    assert {x.a: (x.other, x.common, x.every) for x in found.collect()} == {i: x[1:] for i, x in best.items()}
    assert best[999][1:] == (5000, 7, 10)
    assert "BroadcastHashJoin" not in found._jdf.queryExecution().executedPlan().toString()
    total = Counter()
    for i, _, n, *_ in pairs(left, left, 0.4):
        total[i] += n
    assert {x.a: x.others for x in similar.similar_sets(a, a, 0.4).collect()} == total


def test_nearest_names_equals_brute_force(spark, monkeypatch):
    """Several blocks, ties by name, names over 64 characters, short ones and other scripts."""
    monkeypatch.setattr(similar, "NAMES", 100)
    monkeypatch.setattr(similar, "ASKED", 40)
    r = random.Random(3)
    verbs, nouns = ["load", "fetch", "prune"], ["Cache", "Hunk", "Größe", "日本語の"]

    def name():
        return r.choice(verbs) + r.choice(nouns) + "".join(r.choice("bdk") + r.choice("aio") for _ in range(r.randint(0, 4)))

    names = sorted({name() for _ in range(300)} | {"abcd", "abce", "x" * 64, "x" * 65 + "y", "z" * 130})
    asked = sorted({name()[:-1] + r.choice("xw") for _ in range(80)} | {"abcf", "x" * 64 + "w", "x" * 70, "z" * 120, "z" * 40, "qqqqqqqqq"})

    def edits(s, t):
        row = list(range(len(t) + 1))
        for i, c in enumerate(s, 1):
            last, row[0] = row[0], i
            for k, e in enumerate(t, 1):
                last, row[k] = row[k], min(row[k] + 1, row[k - 1] + 1, last + (c != e))
        return row[-1]

    want = {}
    for s in asked:
        near = [(edits(s, t), max(len(s), len(t)), t) for t in names]
        near = [(-round(1 - d / m, 6), t, d) for d, m, t in near if d <= int(m * 0.4 + 1e-9)]
        if near:
            want[s] = min(near)
    got: dict = {}
    for x in similar.nearest_names(spark.createDataFrame([(s,) for s in asked], "symbol string"), spark.createDataFrame([(t,) for t in names], "name string")).collect():
        row = (-round(1 - x.d / max(len(x.symbol), len(x.name)), 6), x.name, x.d)
        got[x.symbol] = min(got.get(x.symbol, (1, "", 0)), row)
    assert got == want and len(want) > 60
