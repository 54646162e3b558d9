import json
import random
import unicodedata

from pyspark.sql import functions as F

from knotwork.llm import formatting as M


def canon(s):
    s = unicodedata.normalize("NFC", s or "").lower().replace("ß", "ss")
    return "".join(ch for ch in s if unicodedata.category(ch)[0] in "LN")


def test_collapse_equals_brute_force(spark, rows):
    r = random.Random(1)
    bases = ["Keep the lock, always.", "keep the lock always", "Straße gesperrt", "STRASSE GESPERRT", "café closed", "café closed", "Keep the lock 2", "", None, " — ", "x" * 20000, "X" * 20000 + "!"]
    data = [(i, r.choice(["s", " s", None]), r.choice(bases), "clash", 5) for i in range(200)]
    df = spark.createDataFrame(data, "key bigint, symbol string, text string, first_key string, copies int")
    groups = {}
    for k, s, t, *_ in data:
        groups.setdefault((s, canon(t)), []).append(k)
    records, members = M.collapse(df, "key", "text", ("symbol",))
    assert rows(records) == sorted((min(v), len(v)) for v in groups.values())
    assert rows(members, "key", "first_key") == sorted((k, min(v)) for v in groups.values() for k in v)
    records, _ = M.collapse(df, "key", "text", ("symbol",), empty=False)
    assert rows(records) == sorted((min(v), len(v)) for (_, c), v in groups.items() if c)


def test_marks_written_as_escapes(spark, rows):
    data = [(1, '{"text": "cafe\\u0301 closed"}'), (2, '{"text": "Café, closed"}'), (3, "text: cafe\u0301 closed"), (4, "text: cafe closed"), (5, '{"text": "\u1112\u1161\u11ab"}'), (6, '{"text": "한"}')]
    _, members = M.collapse(spark.createDataFrame(data, "key bigint, record string"), "key", "record", canonical=M.field_text)
    assert rows(members, "key", "first_key") == [(1, 1), (2, 1), (3, 1), (4, 4), (5, 5), (6, 5)]


def test_collapse_empty_table(spark, rows):
    records, members = M.collapse(spark.createDataFrame([], "key bigint, text string"), "key", "text")
    assert rows(records) == [] and rows(members) == []


def test_field_text(spark):
    same = [
        json.dumps({"kind": "note", "text": 'He said "No"\nagain', "area": None}),
        'Text: "He said \\"no\\" again"\nKIND:  note\narea: ',
        '{\n  "TEXT" : "he said no; again" ,\n "kind":"note", "source": ""}',
        "﻿" + json.dumps({"text": "HE SAID NO AGAIN", "kind": "Note"}),
    ]
    other = [json.dumps({"kind": "note", "text": "He said no again", "area": "x"}), "just words", "", None, "{broken json: yes"]
    df = spark.createDataFrame([(x,) for x in same + other], "r string")
    got = [r[0] for r in df.select(M.field_text(F.col("r"))).collect()]
    assert got[:4] == ["kind:note\ntext:hesaidnoagain"] * 4
    assert got[4:] == ["area:x\nkind:note\ntext:hesaidnoagain", ":justwords", "", "", "brokenjson:yes"]
