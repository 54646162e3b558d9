"""Ranking, running and set queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.keys import trimmed
from ..operators.budget import pack_groups
from ..operators.sequences import numbered
from ..operators.ranking import ISSUE_SEVERITY, first_by, severity_rank, top_by
from ..sources.tables import table
from . import warehouse as W

AS_OF = "2026-07-01"


def w1_note_ranking(spark: SparkSession, sf: str) -> DataFrame:
    """The ten notes of each symbol to show first: not promoted, by severity, newest first."""
    n = W.note(spark, sf).where("symbol IS NOT NULL AND NOT coalesce(promoted, false)")
    order = [severity_rank("severity").desc(), F.col("recorded_at").desc_nulls_last(), "note_key"]
    return top_by(n, ["symbol"], order, 10, "position").select("symbol", "note_key", "position")


def w2_latest_decision(spark: SparkSession, sf: str) -> DataFrame:
    """The newest promoted note of each symbol."""
    n = W.note(spark, sf).where("symbol IS NOT NULL AND promoted")
    return first_by(n, ["symbol"], [F.col("recorded_at").desc_nulls_last(), "note_key"]).select("symbol", "note_key")


def w3_preference_ranking(spark: SparkSession, sf: str) -> DataFrame:
    """The five preferences that fit each file best: 3 where the text names a symbol of the file, 1 for each part of its path over three characters, 0.5 for the whole repository, 0.1 for each topic up to 1."""
    i = W.inb(spark, sf).where("kind = 'preference' AND text IS NOT NULL").select("item_key", F.lower("text").alias("text"), F.col("area").isNull().alias("whole"), F.coalesce(F.size("risk_topics"), F.lit(0)).alias("hits"))
    s = W.sym(spark, sf).where("file IS NOT NULL")
    words = i.select("item_key", F.explode(F.array_distinct(F.split("text", "[^a-z0-9_]+"))).alias("word"))
    by_name = words.join(s.select(F.lower("name").alias("word"), "file").distinct(), "word").groupBy("file", "item_key").agg(F.lit(3).alias("points"))
    segments = s.select("file", F.explode(F.array_distinct(F.filter(F.split(F.lower("file"), r"[/\\.]"), lambda x: F.length(x) > 3))).alias("word")).distinct()
    by_path = words.join(segments, "word").groupBy("file", "item_key").agg(F.count(F.lit(1)).cast("int").alias("points"))
    points = by_name.unionByName(by_path).groupBy("file", "item_key").agg(F.sum("points").alias("points")).join(i, "item_key")
    ranked = points.withColumn("score", F.round(F.col("points") + 0.5 * F.col("whole").cast("int") + F.least(F.col("hits") * 0.1, F.lit(1.0)), 6))
    return top_by(ranked, ["file"], [F.desc("score"), "item_key"], 5, "position").select("file", "item_key", "score", "position")


def w5_first_wins(spark: SparkSession, sf: str) -> DataFrame:
    """Symbols without repeats of name, kind and file: the first key of each."""
    return first_by(table(spark, sf, "symbols"), ["name", "kind", "file"], ["symbol_key"]).select("symbol_key", "name")


def w6_ewma(spark: SparkSession, sf: str) -> DataFrame:
    """Weight of each symbol of a feature after all its touches: w = 0.3 * signal + 0.7 * w, an edit signals 1, a read 0.3 (also r5).

    The fold over n touches in order is a sum, 0.3 * signal_i * 0.7 ** (touches after i), so no group is gathered.
    """
    t = W.touches(spark, sf).withColumn("after", F.row_number().over(Window.partitionBy("label", "id").orderBy(F.desc("ts"), F.desc("seq"))) - 1)
    signal = F.when(F.col("action") == "edit", 1.0).otherwise(0.3)
    return t.groupBy("label", "id").agg(F.round(F.sum(0.3 * signal * F.pow(F.lit(0.7), F.col("after"))), 6).alias("weight"), F.count(F.lit(1)).alias("touches"))


def w7_running_context(spark: SparkSession, sf: str) -> DataFrame:
    """The heading each line of a document stands under, counted: the last line that began with '#', carried forward."""
    d = W.docs(spark, sf).where("text IS NOT NULL").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    w = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("heading", F.last(F.when(F.col("line").rlike("^#+ "), F.col("line")), ignorenulls=True).over(w))
    return d.where("heading IS NOT NULL").groupBy("doc_id", "heading").agg(F.count(F.lit(1)).alias("lines"))


def w8_budget_packing(spark: SparkSession, sf: str) -> DataFrame:
    """Notes and issues of each symbol packed into 200 tokens: sections notes, then issues, each of up to ten items."""
    n = top_by(W.note(spark, sf).where("symbol IS NOT NULL AND lesson IS NOT NULL"), ["symbol"], [severity_rank("severity").desc(), "note_key"], 10, "position").select("symbol", F.lit("## Notes").alias("section"), F.lit(1).alias("section_order"), "position", F.col("lesson").alias("item"))
    i = top_by(W.iss(spark, sf).where("symbol IS NOT NULL AND summary IS NOT NULL"), ["symbol"], [severity_rank("severity", ISSUE_SEVERITY).desc(), "issue_key"], 10, "position").select("symbol", F.lit("## Issues").alias("section"), F.lit(2).alias("section_order"), "position", F.col("summary").alias("item"))
    return pack_groups(n.unionByName(i), "symbol", 200)


def w9_budget_trim(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of each symbol that fit 400 characters when whole sections are trimmed from the end in a fixed order (todos first, then notes, decisions, issues): sizes are added from what is trimmed last."""
    i = W.iss(spark, sf).where("symbol IS NOT NULL AND summary IS NOT NULL")
    n = W.note(spark, sf).where("symbol IS NOT NULL AND lesson IS NOT NULL")
    part = lambda d, section, o, key, text, rank: d.select("symbol", F.lit(section).alias("section"), F.lit(o).alias("o"), F.col(key).alias("key"), F.length(text).alias("n"), rank.alias("rank"))
    rows = part(i.where("kind <> 'open_todo'"), "issues", 1, "issue_key", "summary", severity_rank("severity", ISSUE_SEVERITY)).unionByName(part(n.where("promoted"), "decisions", 2, "note_key", "lesson", severity_rank("severity")))
    rows = rows.unionByName(part(n.where("NOT coalesce(promoted, false)"), "notes", 3, "note_key", "lesson", severity_rank("severity"))).unionByName(part(i.where("kind = 'open_todo'"), "todos", 4, "issue_key", "summary", severity_rank("severity", ISSUE_SEVERITY)))
    first = top_by(rows, ["symbol", "section"], [F.desc("rank"), "key"], 401)  # no more rows of one character or more can fit
    w = Window.partitionBy("symbol").orderBy("o", F.desc("rank"), "key").rowsBetween(Window.unboundedPreceding, 0)
    return first.withColumn("size", F.sum("n").over(w).cast("bigint")).where("size <= 400").select("symbol", "section", "key", "size")


def w10_sequence(spark: SparkSession, sf: str) -> DataFrame:
    """Rising numbers for the runs of each source in order of arrival, numbered by day."""
    return numbered(W.runs(spark, sf), ["source"], F.datediff(F.to_date("ingested_at"), F.lit("2000-01-01").cast("date")), ["ingested_at", "seq"], "number").select("seq", "source", "number")


def w11_per_file_cap(spark: SparkSession, sf: str) -> DataFrame:
    """At most two stale entries of each file: the oldest."""
    return top_by(W.stale(spark, sf).where("file IS NOT NULL"), ["file"], [F.desc("age_days"), "entry_key"], 2).select("file", "entry_key")


def w12_order_preserving(spark: SparkSession, sf: str) -> DataFrame:
    """Issues of each symbol numbered by severity, then first appearance of their kind, then key."""
    i = W.iss(spark, sf).where("symbol IS NOT NULL").withColumn("rank", severity_rank("severity", ISSUE_SEVERITY))
    i = i.withColumn("kind_first", F.min("issue_key").over(Window.partitionBy("symbol", "kind")))
    w = Window.partitionBy("symbol").orderBy(F.desc("rank"), "kind_first", "issue_key")
    return i.select("issue_key", F.row_number().over(w).alias("position"))


def w13_nearest_above(spark: SparkSession, sf: str) -> DataFrame:
    """For each call site the symbol that starts nearest above it in the file, carried forward over the lines."""
    s = W.sym(spark, sf).where("file IS NOT NULL AND line IS NOT NULL").select("file", "line", F.lit(0).alias("what"), F.col("symbol_key").alias("key"))
    e = table(spark, sf, "edges", "edge_key", "file", "line").where("file IS NOT NULL AND line IS NOT NULL").select("file", "line", F.lit(1).alias("what"), F.col("edge_key").alias("key"))
    w = Window.partitionBy("file").orderBy("line", "what", "key").rowsBetween(Window.unboundedPreceding, 0)
    both = s.unionByName(e).withColumn("above", F.last(F.when(F.col("what") == 0, F.col("key")), ignorenulls=True).over(w))
    return both.where("what = 1 AND above IS NOT NULL").select(F.col("key").alias("edge_key"), "above")


def t4_suggest_queue(spark: SparkSession, sf: str) -> DataFrame:
    """The ten symbols to write notes for: most failing runs, then most runs, without a note (also k9)."""
    r = W.runs(spark, sf).select(F.explode(F.array_distinct("symbols")).alias("symbol"), "exit")
    g = r.groupBy("symbol").agg(F.count(F.lit(1)).alias("runs"), F.sum((F.col("exit") != 0).cast("bigint")).alias("failures")).where("failures > 0 OR runs >= 3")
    noted = W.note(spark, sf).select("symbol").dropna().distinct()
    return g.join(noted, "symbol", "left_anti").orderBy(F.desc("failures"), F.desc("runs"), "symbol").limit(10)


def t5_review_queue(spark: SparkSession, sf: str) -> DataFrame:
    """The fifty items to review: promotions, stale entries and open questions in one order (also k11)."""
    i = W.iss(spark, sf).where("kind IN ('promotion_candidate', 'open_question')")
    age = F.datediff(F.lit(AS_OF).cast("date"), F.to_date("raised_at"))
    a = i.select(F.when(F.col("kind") == "promotion_candidate", 1).otherwise(3).alias("priority"), "kind", F.col("issue_key").alias("key"), age.alias("age"))
    b = W.stale(spark, sf).where("age_days >= 180").select(F.lit(2).alias("priority"), F.lit("stale").alias("kind"), F.col("entry_key").alias("key"), F.col("age_days").alias("age"))
    return a.unionByName(b).orderBy("priority", F.desc("age"), "kind", "key").limit(50)


def t6_stale_order(spark: SparkSession, sf: str) -> DataFrame:
    """The hundred stalest entries: changed files first, then the oldest (also k5)."""
    s = W.stale(spark, sf)
    return s.orderBy(F.coalesce("file_changed_since", F.lit(False)).desc(), F.desc("age_days"), "entry_key").limit(100).select("entry_key", "age_days")


def t7_recommendations(spark: SparkSession, sf: str) -> DataFrame:
    """The eight commands that issues recommend most, by severity."""
    i = W.iss(spark, sf).where("command IS NOT NULL")
    g = i.groupBy("command").agg(F.max(severity_rank("severity", ISSUE_SEVERITY)).alias("priority"), F.count(F.lit(1)).alias("times"))
    return g.orderBy(F.desc("priority"), F.desc("times"), "command").limit(8)


def t8_verification_queue(spark: SparkSession, sf: str) -> DataFrame:
    """The twenty notes to verify first: severity times doubt."""
    n = W.note(spark, sf)
    doubt = F.round(severity_rank("severity") * (1 - F.coalesce("confidence", F.col("classifier.confidence"), F.lit(0.0))), 6)
    return n.select("note_key", doubt.alias("weight")).orderBy(F.desc("weight"), "note_key").limit(20)


def t10_sample(spark: SparkSession, sf: str) -> DataFrame:
    """Two hundred edges drawn without replacement: the lowest hashes of a seed and the key."""
    e = table(spark, sf, "edges", "edge_key")
    return e.withColumn("h", F.sha1(F.concat(F.lit("42-"), F.col("edge_key").cast("string")))).orderBy("h").limit(200).select("edge_key")


def u2_memory_union(spark: SparkSession, sf: str) -> DataFrame:
    """All kinds of memory in one list, counted by kind and whether anchored."""
    parts = [
        W.note(spark, sf).select(F.lit("note").alias("kind"), F.col("lesson").alias("text"), F.col("symbol").alias("anchor")),
        W.inb(spark, sf).select("kind", "text", F.col("area").alias("anchor")),
        W.iss(spark, sf).select("kind", F.col("summary").alias("text"), F.col("symbol").alias("anchor")),
        W.stale(spark, sf).select(F.concat(F.lit("stale_"), F.col("kind")).alias("kind"), "text", F.col("symbol").alias("anchor")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("kind").agg(F.count(F.lit(1)).alias("items"), F.count("anchor").alias("anchored"), F.count_distinct("text").alias("texts"))


def u3_file_union(spark: SparkSession, sf: str) -> DataFrame:
    """Files that symbols, edges or stale entries name."""
    return table(spark, sf, "symbols", "file").unionByName(table(spark, sf, "edges", "file")).unionByName(table(spark, sf, "stale_entries", "file")).dropna().distinct()


def u4_todo_union(spark: SparkSession, sf: str) -> DataFrame:
    """Open todos from issues and notes lifted from todos, one per symbol and text, issues first."""
    a = W.iss(spark, sf).where("kind = 'open_todo'").select("symbol", F.lower(F.trim("summary")).alias("text"), F.lit(1).alias("origin"), F.col("issue_key").alias("key"))
    b = W.note(spark, sf).where("source = 'todo'").select("symbol", F.lower(F.trim("lesson")).alias("text"), F.lit(2).alias("origin"), F.col("note_key").alias("key"))
    return first_by(a.unionByName(b), ["symbol", "text"], ["origin", "key"]).select("origin", "key")


def u5_out_of_scope(spark: SparkSession, sf: str) -> DataFrame:
    """Files that calls were built in lately, outside the folders that the stale entries allow."""
    touched = table(spark, sf, "edges", "file", "built_at").where("file IS NOT NULL AND built_at >= '2026-06-01'").select("file").distinct()
    allowed = table(spark, sf, "stale_entries", "file").dropna().distinct()
    return touched.join(allowed, "file", "left_anti")


def u6_prepared_not_edited(spark: SparkSession, sf: str) -> DataFrame:
    """Symbols that passing runs name but no failing one does."""
    r = W.runs(spark, sf).select("exit", F.explode("symbols").alias("symbol"))
    return r.where("exit = 0").select("symbol").distinct().join(r.where("exit <> 0").select("symbol").distinct(), "symbol", "left_anti")


def u7_replica_merge(spark: SparkSession, sf: str) -> DataFrame:
    """Notes and their repeated deliveries merged: one per id, the last delivery's times."""
    n = table(spark, sf, "notes", "note_key", "id", "ingested_at")
    return n.groupBy("id").agg(F.min("note_key").alias("note_key"), F.max("ingested_at").alias("ingested_at"), F.count(F.lit(1)).alias("deliveries"))


def u9_vanished_todos(spark: SparkSession, sf: str) -> DataFrame:
    """Notes lifted from todos whose symbol has no open todo any more."""
    live = W.iss(spark, sf).where("kind = 'open_todo' AND symbol IS NOT NULL").select("symbol").distinct()
    return W.note(spark, sf).where("source = 'todo' AND symbol IS NOT NULL").join(live, "symbol", "left_anti").select("note_key")


def s6_keyed_read(spark: SparkSession, sf: str) -> DataFrame:
    """Notes of one scope and severity, by filters that reach the scan (also p5, s7)."""
    return table(spark, sf, "notes", "note_key", "scope", "severity", "symbol").where("scope = 'symbol' AND severity = 'high'").select("note_key", trimmed("symbol").alias("symbol"))


def p_expiry_filter(spark: SparkSession, sf: str) -> DataFrame:
    """Notes that have not expired by the date: an expiry that cannot be read keeps the note."""
    return table(spark, sf, "notes", "note_key", "expires_at").where(F.coalesce(F.try_to_timestamp("expires_at") >= F.lit(AS_OF).cast("timestamp"), F.lit(True))).select("note_key")


def p_since_filter(spark: SparkSession, sf: str) -> DataFrame:
    """Notes recorded since a date, the date included; those without a time are left out."""
    return table(spark, sf, "notes", "note_key", "recorded_at").where("recorded_at >= '2026-05-01'").select("note_key")


def p_test_files(spark: SparkSession, sf: str) -> DataFrame:
    """Files by whether their path marks them as tests: for the ranking (folder of tests or ending), and for discovery (ending, or Python's test_ and _test names)."""
    f = table(spark, sf, "symbols", "file").dropna().distinct()
    return f.select("file", F.col("file").rlike(r"(?i)(?:^|/)(?:tests?|__tests__|spec)/|\.(?:test|spec)\.[cm]?[jt]sx?$").alias("is_test"), F.col("file").rlike(r"\.(?:test|spec)\.[jt]sx?$|(?:^|/)test_[^/]+\.py$|_test\.py$").alias("is_discovered"))


def p_alias_match(spark: SparkSession, sf: str) -> DataFrame:
    """Inbox items that name a feature, or an alias of several words, bounded by anything but letters, figures and hyphens. Aliases are the areas with blanks for their slashes.

    An item offers its runs of words, of as many words as aliases have (one row of distinct numbers), as keys.
    """
    labels = W.runs(spark, sf).select(F.lower("feature").alias("label")).unionByName(W.inb(spark, sf).select(F.replace(F.lower("area"), F.lit("/"), F.lit(" ")).alias("label"))).dropna().distinct()
    lengths = labels.agg(F.collect_set(F.size(F.split("label", " "))).alias("ns"))  # one row
    words = W.inb(spark, sf).where("text IS NOT NULL").select("item_key", F.filter(F.split(F.lower("text"), "[^a-z0-9-]+"), lambda w: w != "").alias("w")).where(F.size("w") > 0).join(F.broadcast(lengths))
    runs = F.flatten(F.transform("ns", lambda n: F.transform(F.sequence(F.lit(0), F.greatest(F.size("w") - n, F.lit(0))), lambda i: F.array_join(F.slice("w", i + 1, n), " "))))
    return words.select("item_key", F.explode(F.array_distinct(runs)).alias("label")).join(labels, "label", "left_semi").select("item_key", "label")


_NS = "CASE severity WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END"
_IS = "CASE severity WHEN 'block' THEN 3 WHEN 'warn' THEN 2 WHEN 'info' THEN 1 ELSE 0 END"
_FUNCS = (w1_note_ranking, w2_latest_decision, w3_preference_ranking, w5_first_wins, w6_ewma, w7_running_context, w8_budget_packing, w9_budget_trim, w10_sequence, w11_per_file_cap, w12_order_preserving, w13_nearest_above, t4_suggest_queue, t5_review_queue, t6_stale_order, t7_recommendations, t8_verification_queue, t10_sample, u2_memory_union, u3_file_union, u4_todo_union, u5_out_of_scope, u6_prepared_not_edited, u7_replica_merge, u9_vanished_todos, s6_keyed_read, p_expiry_filter, p_since_filter, p_test_files, p_alias_match)
QUERIES = {f.__name__: f for f in _FUNCS}
SQL = {
    "w1_note_ranking": W.sql(f"SELECT * FROM (SELECT symbol, note_key, row_number() OVER (PARTITION BY symbol ORDER BY {_NS} DESC, recorded_at DESC NULLS LAST, note_key) AS position FROM note WHERE symbol IS NOT NULL AND NOT coalesce(promoted, false)) WHERE position <= 10"),
    "w2_latest_decision": W.sql("SELECT symbol, note_key FROM note WHERE symbol IS NOT NULL AND promoted QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY recorded_at DESC NULLS LAST, note_key) = 1"),
    "w3_preference_ranking": W.sql("""
, i AS (SELECT item_key, lower(text) AS text, area IS NULL AS whole, coalesce(len(risk_topics), 0) AS hits FROM inb WHERE kind = 'preference' AND text IS NOT NULL), wd AS (SELECT item_key, unnest(list_distinct(string_split_regex(text, '[^a-z0-9_]+'))) AS word FROM i),
p AS (SELECT DISTINCT file, item_key, 3 AS n FROM wd JOIN sym ON lower(name) = word WHERE file IS NOT NULL UNION ALL SELECT file, item_key, count(*) FROM wd JOIN (SELECT DISTINCT file, unnest(list_filter(string_split_regex(lower(file), '[/\\\\.]'), lambda x: length(x) > 3)) AS seg FROM sym WHERE file IS NOT NULL) ON seg = word GROUP BY 1, 2),
g AS (SELECT file, item_key, round(sum(n) + 0.5::DOUBLE * max(whole::INT) + least(max(hits) * 0.1::DOUBLE, 1.0), 6) AS score FROM p JOIN i USING (item_key) GROUP BY 1, 2)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY file ORDER BY score DESC, item_key) AS position FROM g) WHERE position <= 5"""),
    "w5_first_wins": "SELECT symbol_key, name FROM symbols QUALIFY row_number() OVER (PARTITION BY name, kind, file ORDER BY symbol_key) = 1",
    "w6_ewma": W.sql("""
SELECT label, id, round(sum(0.3::DOUBLE * CASE action WHEN 'edit' THEN 1.0::DOUBLE ELSE 0.3::DOUBLE END * pow(0.7::DOUBLE, after)), 6) AS weight, count(*) AS touches FROM (SELECT *, row_number() OVER (PARTITION BY label, id ORDER BY ts DESC, seq DESC) - 1 AS after FROM touches) GROUP BY 1, 2"""),
    "w7_running_context": """
WITH l AS (SELECT doc_id, generate_subscripts(ls, 1) AS pos, unnest(ls) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL)),
h AS (SELECT doc_id, last_value(CASE WHEN regexp_matches(line, '^#+ ') THEN line END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS heading FROM l)
SELECT doc_id, heading, count(*) AS lines FROM h WHERE heading IS NOT NULL GROUP BY 1, 2""",
    "w9_budget_trim": W.sql(f"""
, r AS (SELECT symbol, CASE kind WHEN 'open_todo' THEN 'todos' ELSE 'issues' END AS section, CASE kind WHEN 'open_todo' THEN 4 ELSE 1 END AS o, issue_key AS key, length(summary) AS n, {_IS} AS rank FROM iss WHERE symbol IS NOT NULL AND summary IS NOT NULL UNION ALL SELECT symbol, CASE WHEN promoted THEN 'decisions' ELSE 'notes' END, CASE WHEN promoted THEN 2 ELSE 3 END, note_key, length(lesson), {_NS} FROM note WHERE symbol IS NOT NULL AND lesson IS NOT NULL),
q AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY symbol, section ORDER BY rank DESC, key) <= 401)
SELECT * FROM (SELECT symbol, section, key, (sum(n) OVER (PARTITION BY symbol ORDER BY o, rank DESC, key ROWS UNBOUNDED PRECEDING))::BIGINT AS size FROM q) WHERE size <= 400"""),
    "w10_sequence": W.sql("SELECT seq, source, row_number() OVER (PARTITION BY source ORDER BY ingested_at NULLS FIRST, seq) AS number FROM runs"),
    "w11_per_file_cap": "SELECT file, entry_key FROM stale_entries WHERE file IS NOT NULL QUALIFY row_number() OVER (PARTITION BY file ORDER BY age_days DESC NULLS LAST, entry_key) <= 2",
    "w12_order_preserving": W.sql(f"SELECT issue_key, row_number() OVER (PARTITION BY symbol ORDER BY {_IS} DESC, k, issue_key) AS position FROM (SELECT *, min(issue_key) OVER (PARTITION BY symbol, kind) AS k FROM iss WHERE symbol IS NOT NULL)"),
    "w13_nearest_above": W.sql("""
SELECT key AS edge_key, above FROM (SELECT what, key, last_value(CASE WHEN what = 0 THEN key END IGNORE NULLS) OVER (PARTITION BY file ORDER BY line, what, key ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS above
FROM (SELECT file, line, 0 AS what, symbol_key AS key FROM sym UNION ALL SELECT file, line, 1, edge_key FROM edges) WHERE file IS NOT NULL AND line IS NOT NULL) WHERE what = 1 AND above IS NOT NULL"""),
    "t4_suggest_queue": W.sql("SELECT symbol, count(*) AS runs, count(*) FILTER (WHERE exit <> 0) AS failures FROM (SELECT unnest(list_distinct(symbols)) AS symbol, exit FROM runs) WHERE symbol NOT IN (SELECT symbol FROM note WHERE symbol IS NOT NULL) GROUP BY symbol HAVING count(*) FILTER (WHERE exit <> 0) > 0 OR count(*) >= 3 ORDER BY failures DESC, runs DESC, symbol LIMIT 10"),
    "t5_review_queue": W.sql("""
SELECT * FROM (SELECT CASE kind WHEN 'promotion_candidate' THEN 1 ELSE 3 END AS priority, kind, issue_key AS key, (DATE '2026-07-01' - raised_at::DATE)::INT AS age FROM iss WHERE kind IN ('promotion_candidate', 'open_question') UNION ALL SELECT 2, 'stale', entry_key, age_days FROM stale_entries WHERE age_days >= 180) ORDER BY priority, age DESC NULLS LAST, kind, key LIMIT 50"""),
    "t6_stale_order": "SELECT entry_key, age_days FROM stale_entries ORDER BY coalesce(file_changed_since, false) DESC, age_days DESC NULLS LAST, entry_key LIMIT 100",
    "t7_recommendations": W.sql(f"SELECT command, max({_IS}) AS priority, count(*) AS times FROM iss WHERE command IS NOT NULL GROUP BY command ORDER BY priority DESC, times DESC, command LIMIT 8"),
    "t8_verification_queue": W.sql(f"SELECT note_key, round({_NS} * (1 - coalesce(confidence, classifier.confidence, 0.0::DOUBLE)), 6) AS weight FROM note ORDER BY weight DESC, note_key LIMIT 20"),
    "t10_sample": "SELECT edge_key FROM edges ORDER BY sha1('42-' || edge_key) LIMIT 200",
    "u2_memory_union": W.sql("SELECT kind, count(*) AS items, count(anchor) AS anchored, count(DISTINCT text) AS texts FROM (SELECT 'note' AS kind, lesson AS text, symbol AS anchor FROM note UNION ALL SELECT kind, text, area FROM inb UNION ALL SELECT kind, summary, symbol FROM iss UNION ALL SELECT 'stale_' || kind, text, symbol FROM stale_entries) GROUP BY kind"),
    "u3_file_union": "SELECT file FROM symbols WHERE file IS NOT NULL UNION SELECT file FROM edges WHERE file IS NOT NULL UNION SELECT file FROM stale_entries WHERE file IS NOT NULL",
    "u4_todo_union": W.sql("SELECT origin, key FROM (SELECT symbol, lower(trim(summary)) AS text, 1 AS origin, issue_key AS key FROM iss WHERE kind = 'open_todo' UNION ALL SELECT symbol, lower(trim(lesson)), 2, note_key FROM note WHERE source = 'todo') QUALIFY row_number() OVER (PARTITION BY symbol, text ORDER BY origin, key) = 1"),
    "u5_out_of_scope": "SELECT DISTINCT file FROM edges WHERE file IS NOT NULL AND built_at >= TIMESTAMP '2026-06-01' AND file NOT IN (SELECT file FROM stale_entries WHERE file IS NOT NULL)",
    "u6_prepared_not_edited": W.sql("SELECT DISTINCT s AS symbol FROM (SELECT unnest(symbols) AS s, exit FROM runs) WHERE exit = 0 AND s NOT IN (SELECT unnest(symbols) FROM runs WHERE exit <> 0)"),
    "u7_replica_merge": "SELECT id, min(note_key) AS note_key, max(ingested_at) AS ingested_at, count(*) AS deliveries FROM notes GROUP BY id",
    "u9_vanished_todos": W.sql("SELECT note_key FROM note WHERE source = 'todo' AND symbol IS NOT NULL AND symbol NOT IN (SELECT symbol FROM iss WHERE kind = 'open_todo' AND symbol IS NOT NULL)"),
    "s6_keyed_read": "SELECT note_key, nullif(trim(symbol), '') AS symbol FROM notes WHERE scope = 'symbol' AND severity = 'high'",
    "p_expiry_filter": "SELECT note_key FROM notes WHERE coalesce(try_cast(expires_at AS TIMESTAMP) >= TIMESTAMP '2026-07-01', true)",
    "p_since_filter": "SELECT note_key FROM notes WHERE recorded_at >= TIMESTAMP '2026-05-01'",
    "p_alias_match": W.sql("""
, l AS (SELECT DISTINCT lower(feature) AS label FROM runs WHERE feature IS NOT NULL UNION SELECT replace(lower(area), '/', ' ') FROM inb WHERE area IS NOT NULL), t AS (SELECT item_key, ' ' || array_to_string(list_filter(string_split_regex(lower(text), '[^a-z0-9-]+'), lambda w: w <> ''), ' ') || ' ' AS t FROM inb WHERE text IS NOT NULL)
SELECT item_key, label FROM t JOIN l ON contains(t, ' ' || label || ' ')"""),
    "p_test_files": r"SELECT DISTINCT file, regexp_matches(file, '(?i)(?:^|/)(?:tests?|__tests__|spec)/|\.(?:test|spec)\.[cm]?[jt]sx?$') AS is_test, regexp_matches(file, '\.(?:test|spec)\.[jt]sx?$|(?:^|/)test_[^/]+\.py$|_test\.py$') AS is_discovered FROM symbols WHERE file IS NOT NULL",
}
