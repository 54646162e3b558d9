"""The warehouse relations over the tables of a folder: one row per thing, trimmed keys, typed columns.

Each is a function of (spark, folder); WITH holds the same relations as SQL common table expressions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.keys import trimmed
from ..operators.ranking import first_by, top_by
from ..sources.code import code_blocks
from ..sources.tables import table


def sym(spark: SparkSession, sf: str) -> DataFrame:
    """Symbols, the earliest row of each id."""
    s = table(spark, sf, "symbols").withColumn("id", trimmed("id")).where("id IS NOT NULL")
    return first_by(s, ["id"], ["symbol_key"])


def edg(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct resolved calls, src to dst."""
    e = table(spark, sf, "edges", "from_id", "to_id").select(trimmed("from_id").alias("src"), trimmed("to_id").alias("dst"))
    return e.dropna().distinct()


def note(spark: SparkSession, sf: str) -> DataFrame:
    """Notes, the first delivery of each id; blank symbols are null."""
    return first_by(table(spark, sf, "notes"), ["id"], ["note_key"]).withColumn("symbol", trimmed("symbol"))


def inb(spark: SparkSession, sf: str) -> DataFrame:
    """Inbox items, the first of each id."""
    return first_by(table(spark, sf, "inbox"), ["id"], ["item_key"])


def iss(spark: SparkSession, sf: str) -> DataFrame:
    """Memory issues with trimmed symbols."""
    return table(spark, sf, "memory_issues").withColumn("symbol", trimmed("symbol"))


def runs(spark: SparkSession, sf: str) -> DataFrame:
    """Test runs, one row for each seq."""
    return first_by(table(spark, sf, "test_runs"), ["seq"], ["ingested_at", "at"])


def stale(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "stale_entries")


def docs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents")


_COMMIT = r"^([0-9a-f]{7,12}) ([a-z]+\([a-z-]+\): .+)$"


def commits(spark: SparkSession, sf: str) -> DataFrame:
    """Commits (sha, subject, doc_id, repo, at) that the commit logs among the documents list, one a line."""
    d = docs(spark, sf).where("text IS NOT NULL").select("doc_id", "repo", F.col("created_at").alias("at"), F.explode(F.split("text", "\n")).alias("line"))
    return d.where(F.col("line").rlike(_COMMIT)).select(F.regexp_extract("line", _COMMIT, 1).alias("sha"), F.regexp_extract("line", _COMMIT, 2).alias("subject"), "doc_id", "repo", "at")


def file_commits(spark: SparkSession, sf: str) -> DataFrame:
    """Commits of each file (file, commit, author, at), as the notes on files tell them."""
    n = note(spark, sf).where("scope = 'file' AND symbol IS NOT NULL AND source_commit IS NOT NULL AND recorded_at IS NOT NULL")
    return n.groupBy(F.col("symbol").alias("file"), F.substring("source_commit", 1, 7).alias("commit")).agg(F.max("author").alias("author"), F.max("recorded_at").alias("at"))


def rules(spark: SparkSession, sf: str) -> DataFrame:
    """Invariants (name, severity, applies_to): one for each symbol with a promotion candidate, named after it, with the highest severity told.

    It applies to the symbol, or to a prefix (warn) or suffix (block) of its name; a warning also to the folder of its file, a block to all paths that begin like it.
    """
    i = iss(spark, sf).where("kind = 'promotion_candidate' AND symbol IS NOT NULL").withColumn("name", F.nullif(F.regexp_extract("symbol", r"([A-Za-z0-9_]+)(?:@[0-9a-f]+)?$", 1), F.lit(""))).where("name IS NOT NULL")
    rank = F.when(F.col("severity") == "block", 3).when(F.col("severity") == "warn", 2).otherwise(1)
    g = i.groupBy("name").agg(F.max(rank).alias("rank"))
    files = sym(spark, sf).where("file IS NOT NULL").groupBy("name").agg(F.min("file").alias("file"))
    g = g.join(files, "name", "left")
    pattern = F.when(F.col("rank") == 3, F.concat(F.lit("*"), F.expr("right(name, 6)"))).when(F.col("rank") == 2, F.concat(F.substring("name", 1, 6), F.lit("*"))).otherwise(F.col("name"))
    glob = F.when(F.col("rank") == 3, F.concat(F.regexp_replace("file", r"_[^_/]*$", ""), F.lit("**"))).when(F.col("rank") == 2, F.concat(F.regexp_replace("file", r"/[^/]*$", ""), F.lit("/*")))
    return g.select("name", F.element_at(F.array(F.lit("info"), F.lit("warn"), F.lit("block")), F.col("rank")).alias("severity"), F.array_compact(F.array(pattern, glob)).alias("applies_to"))


def waivers(spark: SparkSession, sf: str) -> DataFrame:
    """Waivers (invariant, item_key): approved directives give leave to break the invariants that their text names; the first of each name."""
    i = inb(spark, sf).where("status = 'approved' AND kind = 'directive' AND text IS NOT NULL")
    named = i.select("item_key", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit("([A-Za-z0-9_]+)"), 1))).alias("invariant"))
    return named.groupBy("invariant").agg(F.min("item_key").alias("item_key"))


def diff_lines(spark: SparkSession, sf: str) -> DataFrame:
    """(doc_id, block, tag, content) of the lines of the diff blocks among the documents."""
    blocks = code_blocks(docs(spark, sf)).where("lang = 'diff'").select("doc_id", "block", F.explode(F.split("code", "\n")).alias("line")).where("line <> ''")
    tag = F.when(F.col("line").startswith("+"), "add").when(F.col("line").startswith("-"), "del").otherwise("ctx")
    return blocks.select("doc_id", "block", tag.alias("tag"), F.expr("substring(line, 2)").alias("content"))


def touches(spark: SparkSession, sf: str) -> DataFrame:
    """Feature touches (label, id, ts, action): each passing or failing test run edits its symbols for its feature, a pass reads them."""
    r = runs(spark, sf).where("feature IS NOT NULL")
    return r.select(F.col("feature").alias("label"), F.explode(F.array_distinct("symbols")).alias("id"), F.col("at").alias("ts"), "seq", F.when(F.col("exit") == 0, "read").otherwise("edit").alias("action"))


def weights(spark: SparkSession, sf: str) -> DataFrame:
    """Feature weights (label, id, weight, edits, reads): share of the feature's touches with edits counted in full, reads by 0.3, capped at 1."""
    t = touches(spark, sf)
    g = t.groupBy("label", "id").agg(F.sum((F.col("action") == "edit").cast("bigint")).alias("edits"), F.sum((F.col("action") == "read").cast("bigint")).alias("reads"), F.max("ts").alias("last_touched"))
    return g.withColumn("weight", F.least(F.lit(1.0), F.col("edits") * 0.3 + F.col("reads") * 0.09))


def ranked_weights(t: DataFrame) -> DataFrame:
    """The twenty heaviest symbols (label, id, weight) of each feature after the `touches`: weights as in `w6_ewma`."""
    after = F.row_number().over(Window.partitionBy("label", "id").orderBy(F.desc("ts"), F.desc("seq"))) - 1
    signal = F.when(F.col("action") == "edit", 1.0).otherwise(0.3)
    g = t.withColumn("after", after).groupBy("label", "id").agg(F.sum(0.3 * signal * F.pow(F.lit(0.7), F.col("after"))).alias("weight"))
    return top_by(g.withColumn("weight", F.round("weight", 9)), ["label"], [F.desc("weight"), "id"], 20)


def sql_ranked(source: str) -> str:
    return f"SELECT label, id, weight FROM (SELECT label, id, round(sum(0.3::DOUBLE * CASE action WHEN 'edit' THEN 1.0::DOUBLE ELSE 0.3::DOUBLE END * pow(0.7::DOUBLE, after)), 9) AS weight FROM (SELECT *, row_number() OVER (PARTITION BY label, id ORDER BY ts DESC, seq DESC) - 1 AS after FROM {source}) GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY label ORDER BY weight DESC, id) <= 20"


_B = "chr(32)||chr(9)||chr(10)||chr(13)||chr(12)||chr(11)||chr(160)||chr(8203)||chr(65279)"
WITH = f"""
WITH RECURSIVE sym AS (SELECT * REPLACE (nullif(trim(id, {_B}), '') AS id) FROM symbols WHERE nullif(trim(id, {_B}), '') IS NOT NULL QUALIFY row_number() OVER (PARTITION BY nullif(trim(id, {_B}), '') ORDER BY symbol_key) = 1),
edg AS (SELECT DISTINCT nullif(trim(from_id, {_B}), '') AS src, nullif(trim(to_id, {_B}), '') AS dst FROM edges WHERE nullif(trim(from_id, {_B}), '') IS NOT NULL AND nullif(trim(to_id, {_B}), '') IS NOT NULL),
note AS (SELECT * REPLACE (nullif(trim(symbol, {_B}), '') AS symbol) FROM notes QUALIFY row_number() OVER (PARTITION BY id ORDER BY note_key) = 1),
inb AS (SELECT * FROM inbox QUALIFY row_number() OVER (PARTITION BY id ORDER BY item_key) = 1),
iss AS (SELECT * REPLACE (nullif(trim(symbol, {_B}), '') AS symbol) FROM memory_issues),
runs AS (SELECT * FROM test_runs QUALIFY row_number() OVER (PARTITION BY seq ORDER BY ingested_at, "at") = 1),
touches AS (SELECT feature AS label, unnest(list_distinct(symbols)) AS id, "at" AS ts, seq, CASE WHEN exit = 0 THEN 'read' ELSE 'edit' END AS action FROM runs WHERE feature IS NOT NULL),
weights AS (SELECT label, id, count(*) FILTER (WHERE action = 'edit') AS edits, count(*) FILTER (WHERE action = 'read') AS reads, max(ts) AS last_touched,
            least(1.0::DOUBLE, count(*) FILTER (WHERE action = 'edit') * 0.3::DOUBLE + count(*) FILTER (WHERE action = 'read') * 0.09::DOUBLE) AS weight FROM touches GROUP BY label, id),
commits AS (SELECT regexp_extract(line, '{_COMMIT}', 1) AS sha, regexp_extract(line, '{_COMMIT}', 2) AS subject, doc_id, repo, "at" FROM (SELECT doc_id, repo, created_at AS "at", unnest(string_split(text, chr(10))) AS line FROM documents WHERE text IS NOT NULL) WHERE regexp_matches(line, '{_COMMIT}')),
file_commits AS (SELECT symbol AS file, substr(source_commit, 1, 7) AS commit, max(author) AS author, max(recorded_at) AS "at" FROM note WHERE scope = 'file' AND symbol IS NOT NULL AND source_commit IS NOT NULL AND recorded_at IS NOT NULL GROUP BY 1, 2),
rule_rank AS (SELECT nullif(regexp_extract(symbol, '([A-Za-z0-9_]+)(?:@[0-9a-f]+)?$', 1), '') AS name, max(CASE severity WHEN 'block' THEN 3 WHEN 'warn' THEN 2 ELSE 1 END) AS rank FROM iss WHERE kind = 'promotion_candidate' AND symbol IS NOT NULL GROUP BY 1),
rules AS (SELECT r.name, ['info', 'warn', 'block'][rank] AS severity, list_filter([CASE rank WHEN 3 THEN '*' || right(r.name, 6) WHEN 2 THEN substr(r.name, 1, 6) || '*' ELSE r.name END,
            CASE rank WHEN 3 THEN regexp_replace(file, '_[^_/]*$', '') || '**' WHEN 2 THEN regexp_replace(file, '/[^/]*$', '') || '/*' END], lambda x: x IS NOT NULL) AS applies_to FROM rule_rank r LEFT JOIN (SELECT name, min(file) AS file FROM sym WHERE file IS NOT NULL GROUP BY name) f ON f.name = r.name WHERE r.name IS NOT NULL),
difflines AS (SELECT doc_id, CASE WHEN line LIKE '+%' THEN 'add' WHEN line LIKE '-%' THEN 'del' ELSE 'ctx' END AS tag, substr(line, 2) AS content FROM (SELECT doc_id, unnest(string_split(regexp_extract(b, '(?s)^```[a-z]+\n(.*)```$', 1), chr(10))) AS line FROM (SELECT doc_id, unnest(regexp_extract_all(text, '(?s)```[a-z]+\n.*?```')) AS b FROM documents WHERE text IS NOT NULL) WHERE b LIKE '```diff%') WHERE line <> ''),
waivers AS (SELECT invariant, min(item_key) AS item_key FROM (SELECT item_key, unnest(regexp_extract_all(text, '[A-Za-z0-9_]+')) AS invariant FROM inb WHERE status = 'approved' AND kind = 'directive' AND text IS NOT NULL) GROUP BY 1)
"""


def sql(body: str) -> str:
    """`body` over the relations of WITH; it may begin with ', name AS (...)' for relations of its own."""
    return WITH + body
