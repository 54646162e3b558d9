import random

import numpy as np

from knotwork.llm import leaks as L


def brute(docs, items, least):
    out = set()
    for d, text in docs:
        w = L.words_of(text)
        grams = {tuple(w[i : i + least]) for i in range(len(w) - least + 1)}
        for k, it in items:
            v = L.words_of(it)
            if any(tuple(v[i : i + least]) in grams for i in range(len(v) - least + 1)):
                out.add((d, k))
    return out


def test_suffix_array():
    r = np.random.default_rng(2)
    for n in (0, 1, 2, 50, 300):
        t = r.integers(0, 3, n)
        order = L.suffix_array(t, 16)
        key = lambda p: tuple(t[p : p + 16])  # noqa: B023, E731
        assert sorted(order) == list(range(n))
        assert all(key(a) <= key(b) for a, b in zip(order, order[1:]))


def test_leaked_equals_brute_force(spark, monkeypatch):
    r = random.Random(4)
    vocabulary = [f"w{i}" for i in range(12)]
    text = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    items = [(i, text(40)) for i in range(6)] + [(90, text(3)), (91, None), (92, "")]
    docs = [(i, text(r.randrange(0, 60))) for i in range(60)]
    for i in range(12):  # planted, in other typography
        words = items[i % 6][1].split()
        a, n = r.randrange(0, 20), r.choice([3, 4, 13, 20])
        docs.append((100 + i, text(5) + "\n> " + ",\n// ".join(w.upper() for w in words[a : a + n]) + " <b>" + text(5) + "</b>"))
    docs += [(200, None), (201, ""), (202, docs[-1][1])]
    df = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3)
    monkeypatch.setattr(L, "SHARD_WORDS", 150)
    for least in (4, 13):
        got = {(x.doc_id, x.item_id) for x in L.leaks(df, spark.createDataFrame(items, "item_id bigint, text string"), least=least).collect()}
        assert got == brute(docs, items, least)


def test_longest_and_long_documents(spark, monkeypatch):
    item = " ".join(f"q{i}" for i in range(30))
    long = " ".join(f"z{i % 50}" for i in range(95)) + " " + " ".join(item.split()[3:25]) + " " + " ".join(f"z{i % 50}" for i in range(200))
    monkeypatch.setattr(L, "SHARD_WORDS", 100)  # the passage lies over the border of two pieces
    df = spark.createDataFrame([(1, long, "clash"), (2, item, "clash")], "doc_id bigint, text string, words string")
    assert {tuple(r) for r in L.leaks(df, spark.createDataFrame([(7, item)], "item_id bigint, text string")).collect()} == {(1, 7, 22), (2, 7, 30)}


def test_documents_do_not_join(spark):
    item = " ".join(f"q{i}" for i in range(14))
    half = item.split()
    df = spark.createDataFrame([(1, " ".join(half[:7])), (2, " ".join(half[7:]))] * 2 + [(3, " ".join(half[:12]))], "doc_id bigint, text string").coalesce(1)
    assert L.leaks(df, spark.createDataFrame([(1, item)], "item_id bigint, text string")).collect() == []


def test_blocks_and_empty_sets(spark, monkeypatch):
    item = " ".join(f"q{i}" for i in range(20))
    docs = spark.createDataFrame([(1, item)], "doc_id bigint, text string")
    evaluation = spark.createDataFrame([(i, item if i == 2 else "x " * 30) for i in range(4)], "item_id bigint, text string")
    monkeypatch.setattr(L, "BLOCK_WORDS", 10)
    plan = L.leaks(docs, evaluation)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Union" not in plan and "Exchange" not in plan  # one scan, however many blocks
    assert [(r.doc_id, r.item_id) for r in L.leaks(docs, evaluation).collect()] == [(1, 2)]
    assert L.leaks(docs, evaluation.limit(0)).collect() == []
    assert L.leaks(docs.limit(0), evaluation).collect() == []


def test_repeated_passage(spark, monkeypatch):
    """A passage that stands in every document many times, searched a few places at once."""
    item = " ".join(f"q{i % 4}" for i in range(40))
    docs = spark.createDataFrame([(i, " ".join([item] * 3) + f" z{i} " + item) for i in range(20)], "doc_id bigint, text string")
    monkeypatch.setattr(L, "OCCURRENCES", 50)
    evaluation = spark.createDataFrame([(1, item), (2, item + " end")], "item_id bigint, text string")
    assert {tuple(r) for r in L.leaks(docs, evaluation).collect()} == {(i, k, 40) for i in range(20) for k in (1, 2)}
