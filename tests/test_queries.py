"""Every query with SQL against DuckDB on the smallest data; the rest must run."""

import datetime
import glob
import math
import os

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from knotwork.plans import registry

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 6))
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return "[" + ",".join(map(plain, v)) + "]" if isinstance(v, list | tuple) else str(v)


def same(spark, con, name, query, sql):
    df = query(spark, DATA)
    columns = sorted(df.columns)
    got = sorted("|".join(plain(r[c]) for c in columns) for r in df.collect())
    if sql is None:
        return
    rel = con.sql(sql)
    assert sorted(rel.columns) == columns, name
    at = [rel.columns.index(c) for c in columns]
    assert got == sorted("|".join(plain(r[i]) for i in at) for r in rel.fetchall()), name


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_core_query(spark, duck, name):
    same(spark, duck, name, registry.QUERIES[name], registry.SQL.get(name))


def test_contract(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns == ["tbl", "row_key", "field", "status"]


@pytest.mark.parametrize("name, whole, key", [("j21_similar_notes", "j21_all_similar_notes", "note_key"), ("j22_inbox_duplicates", "j22_all_inbox_duplicates", "item_key")])
def test_similarity_of_every_row(spark, duck, name, whole, key):
    """The whole form equals the SQL without its filter on every twentieth row; a note without tokens counts 0."""
    sql = registry.SQL[name].replace(f"q.{key} % 20 = 0", "true")
    assert sql != registry.SQL[name]
    df = registry.QUERIES[whole](spark, DATA)
    got = {r[key]: tuple(plain(r[c]) for c in sorted(df.columns)) for r in df.collect()}
    rel = duck.sql(sql)
    at = [rel.columns.index(c) for c in sorted(df.columns)]
    want = {r[rel.columns.index(key)]: tuple(plain(r[i]) for i in at) for r in rel.fetchall()}
    assert any(k % 20 for k in want)
    assert {k: v for k, v in got.items() if k in want} == want
    assert all(dict(zip(sorted(df.columns), v)).get("similar") == "0" for k, v in got.items() if k not in want)


def test_bootstrap_has_2000_resamples(spark):
    query = registry.QUERIES["a20_bootstrap"]
    whole, given, few = (sorted(map(tuple, query(spark, DATA, *n).collect())) for n in ((), (2000,), (200,)))
    assert whole == given != few


def test_late_clauses_of_a_long_turn_are_read(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(1)
    turn = "user: " + "The build ran. " * 8000 + "Always use pnpm in this repo."
    docs.withColumn("text", F.lit(turn)).write.parquet(f"{tmp_path}/documents.parquet")
    assert [r.asDict() for r in registry.QUERIES["x19_preferences"](spark, str(tmp_path)).collect()]


def test_notes_of_one_hot_symbol_are_compared_by_blocks(spark, tmp_path):
    """Every note is on one symbol: the counts equal the SQL, and no pair is joined row by row."""
    notes = spark.read.parquet(f"{DATA}/notes.parquet").withColumn("symbol", F.lit("hot"))
    notes.write.parquet(f"{tmp_path}/notes.parquet")
    df = registry.QUERIES["j21_all_similar_notes"](spark, str(tmp_path))
    assert "MapInArrow" in df._jdf.queryExecution().toString()
    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{tmp_path}/notes.parquet/*.parquet'" if f.endswith("/notes.parquet") else f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    want = dict(con.sql(registry.SQL["j21_similar_notes"].replace("q.note_key % 20 = 0", "true")).fetchall())
    got = {r.note_key: r.similar for r in df.collect()}
    assert {k: v for k, v in got.items() if k in want} == want and len(want) > 150
    assert not any(v for k, v in got.items() if k not in want)


def test_notes_are_cleaned_once_for_all_similarities(spark):
    """The cleaned notes are kept: what is read at the end has no window over their ids, and no text is shuffled again for it."""
    plan = registry.QUERIES["j21_all_similar_notes"](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "lesson" not in plan
