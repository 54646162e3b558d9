"""Problem 1: records that are the same but for white space, case, punctuation or the order of fields."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.keys import fingerprint
from ..session import cut
from ..sources.tables import table


@F.pandas_udf(T.StringType())
def _composed(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFC", x))


# What makes a text differ from its composed form: combining marks, and Korean syllables in parts.
_PARTS = r"[\p{M}\x{1100}-\x{11FF}]"


def composed(df: DataFrame, column: str) -> DataFrame:
    """`df` with letters and their combining marks put together (NFC) in `column`. Only rows with such marks go through Python."""
    parts = F.coalesce(F.col(column).rlike(_PARTS), F.lit(False))
    return df.where(~parts).unionByName(df.where(parts).withColumn(column, _composed(F.col(column))))


def letters_and_digits(c: Column) -> Column:
    """The letters and digits of `c` in order, in one case (ß counts as ss, its capital form); '' for null. Marks stay, to be put together with their letters (`composed`)."""
    return F.replace(F.lower(F.regexp_replace(F.coalesce(c, F.lit("")), r"[^\p{L}\p{N}\p{M}]|[\x{FE00}-\x{FE0F}]", "")), F.lit("ß"), F.lit("ss"))


def field_text(record: Column) -> Column:
    """Canonical text of a record of fields: a JSON object, or a `field: value` line per field where a value in double quotes
    uses JSON escapes. Names and values keep letters and digits only, fields are sorted, those without a value are left out.

    A line without a colon counts as a value without a name; a text in braces that is no JSON is read by lines; null and '' give ''.
    """
    as_map = F.from_json(F.when(record.rlike(r"^[\s\x{A0}\x{200B}\x{FEFF}]*\{"), F.btrim(record, F.lit(" \t\r\n\u00a0\u200b\ufeff"))), "map<string,string>")
    of_map = F.transform(F.map_entries(as_map), lambda e: F.struct(e["key"].alias("key"), e["value"].alias("value")))

    def line(text: Column) -> Column:
        at = F.instr(text, ":")
        value = F.btrim(F.substr(text, at + 1, F.length(text)), F.lit(" \t\r\u00a0\u200b\ufeff"))
        plain = F.from_json(F.concat(F.lit('{"v":'), F.when(value.rlike(r'^".*"$'), value), F.lit("}")), "v string")["v"]
        return F.struct(F.when(at > 0, F.substr(text, F.lit(1), at - 1)).otherwise("").alias("key"), F.coalesce(plain, value).alias("value"))

    of_lines = F.transform(F.split(F.coalesce(record, F.lit("")), r"\r?\n"), line)
    entries = F.transform(F.coalesce(of_map, of_lines), lambda e: F.struct(letters_and_digits(e["key"]).alias("key"), letters_and_digits(e["value"]).alias("value")))
    kept = F.array_sort(F.array_distinct(F.filter(entries, lambda e: e["value"] != "")))
    return F.array_join(F.transform(kept, lambda e: F.concat(e["key"], F.lit(":"), e["value"])), "\n")


def collapse(df: DataFrame, key: str, text: str, same: tuple[str, ...] = (), canonical: Callable[[Column], Column] = letters_and_digits, empty: bool = True) -> tuple[DataFrame, DataFrame]:
    """(records, members) of `df`: records has `first_key` and `copies` for each distinct record, members `key` and `first_key` of every row.

    Rows are one record when `same` agree as written (null equals null) and the canonical texts are equal. Byte-identical rows are
    collapsed first, with their number; only distinct survivors are made canonical; those are grouped again on the full
    canonical text, and the numbers summed. Both groupings combine on the map side, so that a text that a third of the rows share is
    one row a task before any shuffle; members then looks each row up by the 128-bit fingerprint of its raw text, a join that AQE
    splits where one text is hot. `first_key` is the smallest key of the record. With `empty` false, records without a letter or
    digit are left out; else all of them with equal `same` are one record, null and '' alike. Other columns are not read.
    """
    rows = df.select(F.col(key).alias("_key"), *same, F.col(text).alias("_text"))
    raw = rows.groupBy(*same, "_text").agg(F.count(F.lit(1)).alias("_n"), F.min("_key").alias("_first"))
    r1, r2 = fingerprint(*same, "_text")
    c1, c2 = fingerprint(*same, "_canon")
    # read by both of what follows; escapes are decoded by now, so that a mark written as one is put together with its letter
    survivors = composed(cut(raw.select(*same, r1.alias("_r1"), r2.alias("_r2"), canonical(F.col("_text")).alias("_canon"), "_n", "_first")), "_canon")
    if not empty:
        survivors = survivors.where(F.col("_canon") != "")
    nulls = [F.concat_ws("", F.lit(""), *(F.col(s).isNull().cast("int").cast("string") for s in same)).alias("_nulls")]
    groups = survivors.groupBy(*same, "_canon").agg(F.sum("_n").alias("copies"), F.min("_first").alias("first_key"))
    groups = groups.select(c1.alias("_c1"), c2.alias("_c2"), *nulls, "first_key", "copies")
    first = survivors.select("_r1", "_r2", c1.alias("_c1"), c2.alias("_c2"), *nulls).join(groups, ["_c1", "_c2", "_nulls"]).select("_r1", "_r2", "_nulls", "first_key", "copies")
    hashed = rows.select("_key", r1.alias("_r1"), r2.alias("_r2"), *nulls)
    members = hashed.join(first, ["_r1", "_r2", "_nulls"]).select(F.col("_key").alias(key), "first_key", "copies")
    return groups.select("first_key", "copies"), members


def _tables(spark: SparkSession, sf: str):
    yield "notes", "note_key", collapse(table(spark, sf, "notes", "note_key", "symbol", "lesson"), "note_key", "lesson", ("symbol",), empty=False)
    yield "inbox", "item_key", collapse(table(spark, sf, "inbox", "item_key", "kind", "area", "text"), "item_key", "text", ("kind", "area"))
    yield "inbox_raw", "raw_key", collapse(table(spark, sf, "inbox_raw", "raw_key", "record"), "raw_key", "record", canonical=field_text)


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    """Each copy but the first of its record, with the first."""
    out = None
    for name, key, (_, members) in _tables(spark, sf):
        part = members.where((F.col("copies") > 1) & (F.col(key) != F.col("first_key"))).select(F.lit(name).alias("tbl"), "first_key", F.col(key).alias("copy_key"))
        out = part if out is None else out.unionByName(part)
    return out


def p1_records(spark: SparkSession, sf: str) -> DataFrame:
    """One row for each distinct record with its number of copies."""
    out = None
    for name, _, (records, _) in _tables(spark, sf):
        part = records.select(F.lit(name).alias("tbl"), "first_key", "copies")
        out = part if out is None else out.unionByName(part)
    return out


_SQL = r"""
WITH canon_notes AS (
  SELECT 'notes' AS tbl, note_key AS k, symbol AS a, NULL AS b, replace(lower(regexp_replace(coalesce(lesson, ''), '[^\p{L}\p{N}]', '', 'g')), 'ß', 'ss') AS c FROM notes),
canon_inbox AS (
  SELECT 'inbox' AS tbl, item_key AS k, kind AS a, area AS b, replace(lower(regexp_replace(coalesce(text, ''), '[^\p{L}\p{N}]', '', 'g')), 'ß', 'ss') AS c FROM inbox),
raw_fields AS (
  SELECT raw_key, unnest(json_keys(record)) AS f, record, true AS j FROM inbox_raw WHERE regexp_matches(record, '^\s*\{')
  UNION ALL SELECT raw_key, unnest(string_split(record, chr(10))), record, false FROM inbox_raw WHERE NOT regexp_matches(record, '^\s*\{')),
raw_pairs AS (
  SELECT raw_key, CASE WHEN j THEN f ELSE split_part(f, ':', 1) END AS n,
    CASE WHEN j THEN json_extract_string(record, '$."' || f || '"')
         WHEN regexp_matches(trim(substr(f, strpos(f, ':') + 1)), '^".*"$') THEN json_extract_string('{"v":' || trim(substr(f, strpos(f, ':') + 1)) || '}', '$.v')
         ELSE substr(f, strpos(f, ':') + 1) END AS v FROM raw_fields),
raw_canon AS (
  SELECT raw_key, lower(regexp_replace(n, '[^\p{L}\p{N}]', '', 'g')) AS n, replace(lower(regexp_replace(coalesce(v, ''), '[^\p{L}\p{N}]', '', 'g')), 'ß', 'ss') AS v FROM raw_pairs),
canon_raw AS (
  SELECT 'inbox_raw' AS tbl, r.raw_key AS k, NULL AS a, NULL AS b, coalesce(string_agg(p.n || ':' || p.v, chr(10) ORDER BY p.n, p.v), '') AS c
  FROM inbox_raw r LEFT JOIN (SELECT * FROM raw_canon WHERE v <> '') p USING (raw_key) GROUP BY r.raw_key),
canon AS (SELECT * FROM canon_notes WHERE c <> '' UNION ALL SELECT * FROM canon_inbox UNION ALL SELECT * FROM canon_raw),
firsts AS (SELECT tbl, k, min(k) OVER (PARTITION BY tbl, a, b, c) AS first_key FROM canon)
"""

QUERIES = {"p1_found": p1_found, "p1_records": p1_records}
SQL = {
    "p1_found": _SQL + "SELECT tbl, first_key, k AS copy_key FROM firsts WHERE k <> first_key",
    "p1_records": _SQL + "SELECT tbl, first_key, count(*) AS copies FROM firsts GROUP BY tbl, first_key",
}
