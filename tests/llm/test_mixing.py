import os

import pytest

from knotwork.llm import mixing as M

pytestmark = pytest.mark.skipif(not os.path.exists(M.VOCABULARY), reason="no vocabulary")
TARGETS = [("big", 0.5, 1), ("Mid ", 0.3, 2), ("small", 0.2, 4), ("none", 0.1, 2)]


def tables(spark, n=1500):
    docs = []
    for i in range(n):
        source = ["big", "big", "BIG ", "mid", "mid", "small", None, "other"][i % 8]
        docs.append((i, source, f"document {i} " + "the lock drops the span " * (1 + i % 7), "clash"))
    docs += [(10_000 + i, "small", "one text that is there many times", "") for i in range(40)] + [(20_000, "big", None, ""), (20_001, "big", "", "")]
    return spark.createDataFrame(docs, "doc_id bigint, source string, text string, tokens string"), spark.createDataFrame(TARGETS, "source string, target_share double, max_repeats int")


def shares(mixed):
    sums: dict[str, int] = {}
    for r in mixed:
        sums[r.source] = sums.get(r.source, 0) + r.tokens * r.repeats
    return {s: t / sum(sums.values()) for s, t in sums.items()}


def test_shares_caps_and_determinism(spark):
    docs, targets = tables(spark)
    mixed = M.mixture(docs, targets).collect()
    got = shares(mixed)
    assert got == pytest.approx({"big": 0.5, "mid": 0.3, "small": 0.2}, abs=0.003)  # what has no documents is shared out
    caps = {"big": 1, "mid": 2, "small": 4}
    assert all(1 <= r.repeats <= caps[r.source] for r in mixed) and len({r.doc_id for r in mixed}) == len(mixed)
    again = M.mixture(docs.repartition(5), targets).collect()
    assert sorted((r.doc_id, r.repeats) for r in again) == sorted((r.doc_id, r.repeats) for r in mixed)
    assert {r.doc_id for r in M.mixture(docs, targets, seed=7).collect()} != {r.doc_id for r in mixed}


def test_repeated_texts_are_not_favoured(spark):
    docs, targets = tables(spark)
    mixed = M.mixture(docs, targets, total=6000).collect()
    copies = sum(r.repeats for r in mixed if r.doc_id >= 10_000)
    singles = [r.repeats for r in mixed if r.source == "small" and r.doc_id < 10_000]
    assert copies < 40 and singles  # one text of forty rows is due about 40 / 32 of a single one's copies


def test_more_than_the_caps_allow(spark):
    docs, targets = tables(spark, 400)
    mixed = M.mixture(docs, targets, total=10**9).collect()
    assert all(r.repeats == {"big": 1, "mid": 2, "small": 4}[r.source] for r in mixed)


def test_empty(spark):
    docs, targets = tables(spark, 8)
    assert M.mixture(docs.limit(0), targets).collect() == []
    assert M.mixture(docs, targets.limit(0)).collect() == []


def test_tokens_round_trip(spark):
    text = "Straße — lock(42)\n\n  naïve <|endoftext|> 日本"
    df = spark.createDataFrame([(1, text), (2, None), (3, "")], "k bigint, text string")
    encoder = M._encoder(M.VOCABULARY)
    ids = encoder.encode_ordinary(text)
    assert encoder.decode(ids) == text
    assert {r.k: r.tokens for r in M.with_tokens(df).collect()} == {1: len(ids), 2: 0, 3: 0}


def test_level():
    assert M._level([(0, 100)], 4, 250) == pytest.approx(2.5)
    h = M._level([(0, 100), (1, 100)], 2, 250)  # the singles reach the cap, the doubles get the rest
    assert min(2, h) * 100 + min(2, h / 2) * 100 == pytest.approx(250)
    assert M._level([(0, 100), (3, 100)], 2, 400) >= 16
