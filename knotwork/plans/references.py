"""p3_ queries: references of edges, notes and memory issues to symbols."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.keys import trimmed
from ..operators.references import orphan_counts, orphans_at, orphans_by_mask
from ..sources.tables import table


def _refs(spark: SparkSession, sf: str) -> DataFrame:
    edges = table(spark, sf, "edges", "edge_key", "from_id", "to_id", "built_at")
    ends = F.explode(F.array(F.struct(F.lit("from_id").alias("field"), F.col("from_id").alias("id")), F.struct(F.lit("to_id").alias("field"), F.col("to_id").alias("id"))))
    by_id = edges.select("edge_key", "built_at", ends.alias("e")).select(F.lit("edges").alias("tbl"), F.col("edge_key").alias("row_key"), "e.field", F.lit(0).alias("space"), trimmed("e.id").alias("ref"), F.col("built_at").alias("at"))
    loose = lambda df, tbl, key, at: df.select(F.lit(tbl).alias("tbl"), F.col(key).alias("row_key"), F.lit("symbol").alias("field"), F.lit(1).alias("space"), F.lower(trimmed("symbol")).alias("ref"), F.col(at).alias("at"))
    notes = table(spark, sf, "notes").where("scope = 'symbol'")
    return by_id.unionByName(loose(notes, "notes", "note_key", "recorded_at")).unionByName(loose(table(spark, sf, "memory_issues"), "memory_issues", "issue_key", "raised_at"))


def _targets(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "symbols", "id", "qualified_name", "name", "indexed_at", "removed_at")
    names = F.array_distinct(F.array(*(F.struct(F.lit(1).alias("space"), F.lower(trimmed(c)).alias("ref")) for c in ("id", "qualified_name", "name"))))
    keys = F.explode(F.concat(F.array(F.struct(F.lit(0).alias("space"), trimmed("id").alias("ref"))), names))
    return s.select(keys.alias("k"), F.col("indexed_at").alias("start"), F.col("removed_at").alias("stop")).select("k.space", "k.ref", "start", "stop")


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    """Each orphan reference with its status."""
    return orphans_at(_refs(spark, sf), _targets(spark, sf)).select("tbl", "row_key", "field", "status")


def p3_orphans_by_month(spark: SparkSession, sf: str) -> DataFrame:
    """Orphans per table, field, status and calendar month."""
    refs = _refs(spark, sf).withColumn("since", F.col("at"))
    return orphan_counts(orphans_at(refs, _targets(spark, sf)), at="since").withColumn("month", F.col("period").cast("date")).drop("period")


def p3_composite_keys(spark: SparkSession, sf: str) -> DataFrame:
    """Callers of edges as (from_id, file of the edge) against (id, file) of symbols, partial match: each null is left out of the key."""
    child = table(spark, sf, "edges", "edge_key", "from_id", "file").withColumns({"from_id": trimmed("from_id"), "file": trimmed("file")})
    parent = table(spark, sf, "symbols", "id", "file").withColumns({"id": trimmed("id"), "file": trimmed("file")})
    return orphans_by_mask(child, parent, [("from_id", "id"), ("file", "file")], "partial").select("edge_key", "null_mask")


_SQL_ORPHANS = r"""
WITH blanks AS (SELECT chr(32)||chr(9)||chr(10)||chr(13)||chr(12)||chr(11)||chr(160)||chr(8203)||chr(65279) AS b),
refs AS (
  SELECT 'edges' AS tbl, edge_key AS row_key, 'from_id' AS field, 0 AS space, nullif(trim(from_id, b), '') AS ref, built_at AS t FROM edges, blanks
  UNION ALL SELECT 'edges', edge_key, 'to_id', 0, nullif(trim(to_id, b), ''), built_at FROM edges, blanks
  UNION ALL SELECT 'notes', note_key, 'symbol', 1, lower(nullif(trim(symbol, b), '')), recorded_at FROM notes, blanks WHERE scope = 'symbol'
  UNION ALL SELECT 'memory_issues', issue_key, 'symbol', 1, lower(nullif(trim(symbol, b), '')), raised_at FROM memory_issues, blanks),
tgt AS (
  SELECT 0 AS space, trim(id, b) AS ref, indexed_at, removed_at FROM symbols, blanks
  UNION ALL SELECT 1, lower(trim(id, b)), indexed_at, removed_at FROM symbols, blanks
  UNION ALL SELECT 1, lower(trim(qualified_name, b)), indexed_at, removed_at FROM symbols, blanks
  UNION ALL SELECT 1, lower(trim(name, b)), indexed_at, removed_at FROM symbols, blanks),
met AS (
  SELECT r.tbl, r.row_key, r.field, r.t, count(g.ref) AS n,
         count(CASE WHEN g.indexed_at <= r.t THEN 1 END) AS started,
         count(CASE WHEN g.indexed_at <= r.t AND (g.removed_at IS NULL OR g.removed_at > r.t) THEN 1 END) AS there
  FROM (SELECT * FROM refs WHERE ref IS NOT NULL) r LEFT JOIN tgt g ON g.space = r.space AND g.ref = r.ref
  GROUP BY r.tbl, r.row_key, r.field, r.t),
orphans AS (
  SELECT tbl, row_key, field, t, CASE WHEN n = 0 THEN 'missing' WHEN t IS NULL THEN NULL WHEN started = 0 THEN 'late' WHEN there = 0 THEN 'deleted' END AS status FROM met)
"""

QUERIES = {"p3_found": p3_found, "p3_orphans_by_month": p3_orphans_by_month, "p3_composite_keys": p3_composite_keys}
SQL = {
    "p3_found": _SQL_ORPHANS + "SELECT tbl, row_key, field, status FROM orphans WHERE status IS NOT NULL",
    "p3_orphans_by_month": _SQL_ORPHANS + "SELECT tbl, field, status, CAST(date_trunc('month', t) AS DATE) AS month, count(*) AS orphans FROM orphans WHERE status IS NOT NULL GROUP BY ALL",
    "p3_composite_keys": """
SELECT edge_key, (CASE WHEN f IS NULL THEN '1' ELSE '0' END) || (CASE WHEN p IS NULL THEN '1' ELSE '0' END) AS null_mask
FROM (SELECT edge_key, nullif(trim(from_id), '') AS f, nullif(trim(file), '') AS p FROM edges) e
WHERE (f IS NOT NULL OR p IS NOT NULL)
  AND NOT EXISTS (SELECT 1 FROM symbols s WHERE (e.f IS NULL OR trim(s.id) = e.f) AND (e.p IS NULL OR trim(s.file) = e.p))""",
}
