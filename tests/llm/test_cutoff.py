import math
import random

from knotwork.llm import cutoff as C

SUBJECTS = ["The lock manager", "The schema loader", "The retry queue", "The audit writer", "The session cache"]
VERBS = ["drops", "reloads", "validates", "archives", "merges"]
OBJECTS = ["the parent span", "stale anchors", "empty batches", "the symbol table", "pending refunds"]
WHEN = ["when two workers start at once", "until the index is rebuilt", "unless the caller holds the lock", "because the clock is read twice"]
LOGS = ["Done", "ok", "exit code {n}", "{n} failed, {m} passed", "retrying in {n}s...", "waiting for the socket...", "Snapshot written to src/a/b_{n}.ts"]


def sentence(r):
    return f"{r.choice(SUBJECTS)} {r.choice(VERBS)} {r.choice(OBJECTS)} {r.choice(WHEN)}."


def corpus(seed, limit=90):
    r = random.Random(seed)
    rows, cut = [], set()
    for i in range(900):
        source = r.choice(["whole", "short", "wire", None])
        text = " ".join(sentence(r) for _ in range(r.randrange(1, 4)))
        if r.random() < 0.25:
            text = r.choice(LOGS).format(n=r.randrange(99), m=r.randrange(999))
        elif r.random() < 0.2:
            text += " " + r.choice(LOGS).format(n=r.randrange(99), m=r.randrange(999))
        before = text
        if source == "short" and len(text) > limit:
            text = text[:limit]
        elif source == "wire" and r.random() < 0.3 and len(text) > 30:
            text = text[: r.randrange(20, len(text) - 4)] + r.choice(["", "", "...", "…", "�"])
        if text != before and (text.endswith(("�", "…", "...")) or not text.rstrip().endswith(".")):
            cut.add(i)
        rows.append(("t", i, source, text, "clash"))
    rows += [("t", 9000, "whole", None, ""), ("t", 9001, "whole", "  ", ""), ("t", 9002, "whole", sentence(r) * 500, "")]
    return rows, cut


def test_cut_rows_are_found(spark):
    rows, cut = corpus(1)
    df = spark.createDataFrame(rows, "tbl string, row_key bigint, source string, text string, word string").repartition(4)
    got = {x.row_key for x in C.cut_off(df).collect()}
    texts = {k: x for _, k, _, x, _ in rows}
    missed, wrong = cut - got, got - cut
    assert len(missed) <= 0.1 * len(cut), [texts[i][-40:] for i in missed]
    assert len(wrong) <= 0.05 * len(cut), [texts[i][-40:] for i in wrong]


def test_near_copies(spark):
    whole = "The lock manager drops the parent span when two workers start at once and the schema loader reloads stale anchors until the index is rebuilt for good."
    texts = [whole, whole[:-6], whole[:-12], whole[:-1], whole[:60], "Run 61 of the very same long job was fine and 61", "Run 61 of the very same long job was fine and 615 more", None, ""]
    df = spark.createDataFrame([(t, 1) for t in texts], "text string, plain int")
    assert {r.text for r in C.near_copies_cut(df).collect()} == {whole[:-6], whole[:-12]}


def test_near_copies_that_differ_within(spark):
    words = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(60)]
    whole = " ".join(words) + "."
    other = " ".join([*words[:20], "odd", *words[21:57], words[57][:2]])  # an inner word differs, the last is cut
    stamped = "12:04:55 " + " ".join(words[:56])
    done = "never " + " ".join(words[1:]) + "."  # another, but whole
    df = spark.createDataFrame([(t,) for t in (whole, other, stamped, done, " ".join(words[:20]))], "text string")
    assert {r.text for r in C.near_copies_cut(df).collect()} == {other, stamped}


def test_popular_opening_with_many_continuations(spark):
    opening = "one two three four five six seven eight nine ten eleven twelve"
    far = [f"{opening} a{i} " + " ".join(f"far{i}x{k}" for k in range(9)) + "." for i in range(20)]  # sorted first, but too long
    df = spark.createDataFrame([(t,) for t in (opening, *far, opening + " zebra.")], "text string")
    assert {r.text for r in C.near_copies_cut(df).collect()} == {opening}


def test_bands_of_similar_texts():
    r = random.Random(2)
    hits = 0
    for _ in range(100):
        words = [f"w{r.randrange(10**6)}" for _ in range(60)]
        other = words[:52]  # 48 of 56 shingles
        hits += bool((C.bands_of([words], C._Hashes()) == C.bands_of([["x"], other], C._Hashes())[1]).any())
    assert hits >= 98


def test_limits(spark):
    rows = [("t", "s", "x" * (80 if i < 30 else 10 + i)) for i in range(100)] + [("t", None, "y" * 70)] * 30
    df = spark.createDataFrame(rows, "tbl string, source string, text string")
    assert {(r.source, r.unit, r.size) for r in C.limits(df).collect()} == {("s", "chars", 80), ("s", "bytes", 80), ("", "chars", 70), ("", "bytes", 70)}


def test_short_limit_is_seen_where_nothing_is_longer(spark):
    rows = [("t", "s", "x" * (40 if i < 9 else 5 + i)) for i in range(30)] + [("t", "u", "y" * 40)] * 9 + [("t", "u", "z" * 90)]
    df = spark.createDataFrame(rows, "tbl string, source string, text string")
    assert {(r.source, r.size) for r in C.limits(df).collect()} == {("s", 40)}


def test_openings_against_a_loop():
    r = random.Random(3)
    texts = ["", "a", "a b c d e", "a b c d ef", "one two three four 15 16"] + [" ".join(r.choice(["tree", "a1", "42", "ok", "über", "٣٤"]) for _ in range(r.randrange(1, 30))) for _ in range(200)]
    whole = {}
    for t in texts:
        words, want = t.split(" "), set()
        least = max(C.SHINGLE, math.ceil(C.SIMILARITY * (len(words) - C.SHINGLE + 1) - 1e-9) + C.SHINGLE - 1)
        for i in range(least - 1, len(words)):
            for n in range(1, len(words[i]) + (i < len(words) - 1)):
                if not (n < len(words[i]) and words[i][n - 1].isdigit() and words[i][n].isdigit()):
                    want.add(" ".join([*words[:i], words[i][:n]]))
        whole[t] = want
    for t, want in whole.items():
        got = set(zip(*(k.tolist() for k in C._Texts([t]).openings())))
        assert got == set(zip(*(k.tolist() for k in C._Texts(sorted(want)).whole())))
    all_at_once = set(zip(*(k.tolist() for k in C._Texts(list(whole)).openings())))
    assert all_at_once == {x for w in whole.values() for x in zip(*(k.tolist() for k in C._Texts(sorted(w)).whole()))}


def test_banding_recall_at_the_threshold():
    """Pairs of similarity 0.8 to 0.85 meet in a bucket in at least 98 of 100 cases."""
    r = random.Random(7)
    hits = pairs = 0
    while pairs < 300:
        words = [f"w{r.randrange(10**6)}" for _ in range(r.randrange(40, 90))]
        other = words[: len(words) - r.randrange(0, 4)]
        other[r.randrange(len(other))] = "odd"
        a, b = C._shingles(words), C._shingles(other)
        if 0.8 <= len(a & b) / len(a | b) < 0.85:
            pairs += 1
            hits += bool((C.bands_of([words], C._Hashes()) == C.bands_of([other], C._Hashes())).any())
    assert hits >= 0.98 * pairs, hits


def test_evidence_of_copies(spark):
    words = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(60)]
    df = spark.createDataFrame([("t", 1, "s", " ".join(words) + "."), ("t", 2, "s", " ".join(["odd", words[1], "other", *words[3:59]])), ("t", 3, "s", " ".join(words[:55]))], "tbl string, row_key bigint, source string, text string")
    assert {(r.row_key, r.evidence) for r in C.cut_off(df).collect()} == {(2, "copy"), (3, "copy")}


def test_empty_table(spark):
    assert C.cut_off(spark.createDataFrame([], "tbl string, row_key bigint, source string, text string")).collect() == []


def test_no_side_of_a_join_goes_to_the_driver(spark, monkeypatch):
    """Sizes told beforehand are far too low; only the few lengths at which sources cut may be sent to all tasks."""
    plans = []
    cut = C.cut
    monkeypatch.setattr(C, "cut", lambda df: (plans.append(df), cut(df))[1])
    rows, _ = corpus(2)
    df = spark.createDataFrame(rows[:300], "tbl string, row_key bigint, source string, text string, word string")
    plans.append(C.cut_off(df))
    plans.append(C.near_copies_cut(df))
    lines = [x for p in plans for x in p._jdf.queryExecution().executedPlan().toString().splitlines()]
    assert any("SortMergeJoin" in x for x in lines)
    assert not [x for x in lines if "BroadcastHashJoin" in x and "size#" not in x or "BroadcastNestedLoop" in x]


def test_stems_meet_every_opening():
    """Each opening has the stem of its text among its own keys; texts with fewer words than a shingle have none."""
    r = random.Random(5)
    texts = ["", "a", "a b c d", "a b c d e"] + [" ".join(r.choice(["tree", "a1", "42", "ok", "über"]) for _ in range(r.randrange(1, 60))) for _ in range(200)]
    pairs = []
    for t in texts:
        words = t.split(" ")
        least = max(C.SHINGLE, math.ceil(C.SIMILARITY * (len(words) - C.SHINGLE + 1) - 1e-9) + C.SHINGLE - 1)
        pairs += [(" ".join([*words[:i], words[i][:n]]), t) for i in range(least - 1, len(words)) for n in range(1, len(words[i]) + (i < len(words) - 1))]
    every = sorted({x for p in pairs for x in p} | set(texts))
    own, keys, n_each = C._Texts(every).stems()
    ends = n_each.cumsum()
    met = {t: (own[i], set(keys[ends[i] - n_each[i] : ends[i]].tolist())) for i, t in enumerate(every)}
    assert len(pairs) > 1000 and all(met[t][0] in met[opening][1] for opening, t in pairs)
    assert not any(met[t][1] for t in texts[:3])
