import datetime as dt
import random

import pytest

from knotwork.operators.references import orphan_counts, orphans_at, orphans_by_mask

T0 = dt.datetime(2026, 1, 1)
REFS = "row_key bigint, status string, day string, k1 int, space int, ref string, at timestamp_ntz"
TARGETS = "space int, ref string, start timestamp_ntz, stop timestamp_ntz, status string"


def brute(refs, targets):
    out = []
    for key, *_, space, ref, at in refs:
        met = [t for t in targets if t[0] == space and t[1] == ref] if ref is not None else None
        if met is None:
            continue
        if not met:
            out.append((key, "missing"))
        elif at is not None:
            started = [t for t in met if t[2] is not None and t[2] <= at]
            if not started:
                out.append((key, "late"))
            elif not any(t[3] is None or t[3] > at for t in started):
                out.append((key, "deleted"))
    return sorted(out)


@pytest.mark.parametrize("seed", [1, 2])
def test_orphans_at_equals_brute_force(spark, rows, seed):
    r = random.Random(seed)
    when = lambda: T0 + dt.timedelta(hours=r.randrange(0, 24 * 6)) if r.random() > 0.1 else None
    names = ["a", "b", "c", "hot"]
    targets = []
    for _ in range(60):
        start, stop = when(), when()
        targets.append((r.randrange(2), r.choice(names + [None]), start, stop, "x"))
    targets += targets[:5]  # repeated rows
    refs = [(i, "own", "day", 7, r.randrange(2), r.choice(names + ["gone", None, "hot", "hot"]), when()) for i in range(400)]
    got = orphans_at(spark.createDataFrame(refs, REFS), spark.createDataFrame(targets, TARGETS))
    assert rows(got, "row_key", "status") == brute(refs, targets)
    assert "day" in got.columns and "k1" in got.columns


def test_orphans_at_edges_of_a_stay(spark, rows):
    h = lambda n: T0 + dt.timedelta(hours=n)
    targets = [(0, "s", h(2), h(4), None), (0, "s", h(30), h(31), None), (0, "never", h(5), h(5), None), (0, "unknown", None, None, None)]
    at = {1: ("s", 1), 2: ("s", 2), 3: ("s", 3), 4: ("s", 4), 5: ("s", 30), 6: ("s", 31), 7: ("never", 5), 8: ("never", 4), 9: ("unknown", 1)}
    refs = [(k, None, None, None, 0, name, h(n)) for k, (name, n) in at.items()] + [(10, None, None, None, 0, "unknown", None), (11, None, None, None, 0, "nowhere", None)]
    got = dict(rows(orphans_at(spark.createDataFrame(refs, REFS), spark.createDataFrame(targets, TARGETS)), "row_key", "status"))
    assert got == {1: "late", 4: "deleted", 6: "deleted", 7: "deleted", 8: "late", 9: "late", 11: "missing"}


def test_orphans_at_empty_tables(spark, rows):
    none, some = spark.createDataFrame([], REFS), spark.createDataFrame([(1, None, None, None, 0, "a", T0)], REFS)
    nothing = spark.createDataFrame([], TARGETS)
    assert rows(orphans_at(none, nothing)) == []
    assert rows(orphans_at(some, nothing), "row_key", "status") == [(1, "missing")]


CHILD = [(1, "a", "x"), (2, "a", None), (3, None, "y"), (4, None, None), (5, "b", "x"), (5, "b", "x"), (6, "zz", None)]
PARENT = [("a", "x", 1), ("a", "x", 1), ("c", "y", 2), (None, "x", 3), ("b", None, 4)]


@pytest.mark.parametrize(
    ("match", "expected"),
    [
        ("simple", [(5, "00"), (5, "00")]),
        ("partial", [(5, "00"), (5, "00"), (6, "01")]),
        ("full", [(2, "01"), (3, "10"), (5, "00"), (5, "00"), (6, "01")]),
    ],
)
def test_orphans_by_mask(spark, rows, match, expected):
    child = spark.createDataFrame(CHILD, "id int, p string, k0 string")
    parent = spark.createDataFrame(PARENT, "p string, k0 string, id int")
    assert rows(orphans_by_mask(child, parent, [("p", "p"), ("k0", "k0")], match), "id", "null_mask") == expected


def test_orphans_by_mask_empty(spark, rows):
    child, parent = spark.createDataFrame(CHILD, "id int, p string, q string"), spark.createDataFrame([], "p string, q string")
    assert len(rows(orphans_by_mask(child, parent, [("p", "p"), ("q", "q")], "partial"))) == 6
    assert rows(orphans_by_mask(parent, child, [("p", "p"), ("q", "q")], "simple")) == []
    with pytest.raises(ValueError):
        orphans_by_mask(child, parent, [("p", "p")], "loose")


def test_orphan_counts_by_month(spark, rows):
    df = spark.createDataFrame([("t", "f", "late", T0), ("t", "f", "late", T0), ("t", "f", "missing", None)], "tbl string, field string, status string, at timestamp_ntz")
    assert rows(orphan_counts(df), "status", "orphans") == [("late", 2), ("missing", 1)]
