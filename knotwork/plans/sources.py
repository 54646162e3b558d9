"""Source queries: code blocks of the documents as source files, diffs and transcripts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.resolve import resolve_imports
from ..sources import code, diffs, records
from ..sources.config import settings
from ..sources.tables import table
from . import warehouse as W


def s1_code_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """Fenced blocks of the documents by language."""
    return code.code_blocks(W.docs(spark, sf)).groupBy("lang").agg(F.count(F.lit(1)).alias("blocks"), F.sum(F.length("code")).cast("bigint").alias("chars"))


def s3_line_symbols(spark: SparkSession, sf: str) -> DataFrame:
    """Definitions in the code blocks, by pattern."""
    lines = code.numbered_lines(code.code_blocks(W.docs(spark, sf)))
    return code.line_symbols(lines).select("doc_id", "block", "line", "kind", "name")


def s3_pattern_symbols(spark: SparkSession, sf: str) -> DataFrame:
    """Definitions in the code blocks, by the patterns of each language, with their containers (also w13)."""
    lines = code.numbered_lines(code.code_blocks(W.docs(spark, sf)))
    return code.pattern_symbols(lines, ["doc_id", "block"]).select("doc_id", "block", "lang", "line", "kind", "name", "qualified_name")


def s4_call_sites(spark: SparkSession, sf: str) -> DataFrame:
    """Calls in the code blocks, by callee."""
    lines = code.numbered_lines(code.code_blocks(W.docs(spark, sf)))
    return code.line_calls(lines).groupBy("callee").agg(F.count(F.lit(1)).alias("calls"))


def s5_python_symbols(spark: SparkSession, sf: str) -> DataFrame:
    """Definitions in the Python blocks, by syntax tree."""
    blocks = code.code_blocks(W.docs(spark, sf)).where("lang = 'py'")
    return code.python_symbols(blocks).select("doc_id", "block", "name", "kind", "line", "end_line")


def s12_diff_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of the diff blocks with their tag and number on the new side (also s14)."""
    blocks = code.code_blocks(W.docs(spark, sf)).where("lang = 'diff'").select(F.concat_ws("-", F.col("doc_id").cast("string"), F.col("block").cast("string")).alias("key"), "code")
    return diffs.diff_lines(blocks, "key", "code").select("key", "tag", "new_line", "content")


def s17_transcript_turns(spark: SparkSession, sf: str) -> DataFrame:
    """Turns of the session transcripts by role."""
    lines = W.docs(spark, sf).where("text IS NOT NULL").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    role = F.regexp_extract("line", "^(user|assistant|system): ", 1)
    return lines.select("doc_id", role.alias("role"), F.length("line").alias("n")).where("role <> ''").groupBy("role").agg(F.count(F.lit(1)).alias("turns"), F.count_distinct("doc_id").alias("documents"), F.sum("n").cast("bigint").alias("chars"))


def j3_import_resolution(spark: SparkSession, sf: str) -> DataFrame:
    """Call sites resolved through imports: a resolved edge imports its target's name from the index of the target's folder, an unresolved one from that of the caller's own folder, which
    may not have it. Indexes pass names on from the files of their folder. Targets with the files that reach them."""
    s = W.sym(spark, sf).where("file IS NOT NULL").select("id", "name", "file")
    index = lambda c: F.regexp_replace(c, "/[^/]*$", "/index")
    e = table(spark, sf, "edges", "file", "to_name", "to_id").where("file IS NOT NULL AND to_name IS NOT NULL").withColumn("to_id", F.nullif(F.btrim("to_id"), F.lit("")))
    met = e.join(s.select(F.col("id").alias("to_id"), F.col("name"), F.col("file").alias("sfile")), "to_id")
    bare = F.regexp_extract("to_name", "([^.]*)$", 1)
    imports = met.select("file", F.col("to_name").alias("local"), index("sfile").alias("module"), F.col("name").alias("imported")).unionByName(e.where("to_id IS NULL").select("file", F.col("to_name").alias("local"), index("file").alias("module"), bare.alias("imported"))).distinct()
    exports = s.select(F.col("file").alias("module"), "name").distinct()
    passed = s.select(index("file").alias("module"), "name", F.col("file").alias("from_module"), F.col("name").alias("from_name")).distinct()
    calls = e.select("file", F.col("to_name").alias("callee")).distinct()
    return resolve_imports(calls, imports, exports, passed).groupBy("target_file", "target").agg(F.count_distinct("file").alias("files"))


def s2_config(spark: SparkSession, sf: str) -> DataFrame:
    """Settings of three configurations, given in full, in part and not at all, with defaults for what is missing."""
    full = "languages:\n  - python\n  - go\nexclude: [out, tmp]\ndepth: 5\nstrands:\n  - tests\ncapture: inbox\npromote: never\n"
    given = spark.createDataFrame([("full", full), ("part", "# only this\ndepth: 2\n"), ("none", None)], "name string, text string")
    return settings(given, "name", "text")


def s9_json_tail(spark: SparkSession, sf: str) -> DataFrame:
    """The last hundred records of a log of JSON lines, of which some cannot be read."""
    line = F.when(F.col("seq") % 50 == 0, F.lit('{"seq": 1, "source": ')).otherwise(F.to_json(F.struct("seq", "source", "exit")))
    log = W.runs(spark, sf).select(line.alias("line"))
    return records.tail(records.json_records(log, "line", "seq bigint, source string, exit int"), 100).select("seq", "source", "exit")


def s13_file_changes(spark: SparkSession, sf: str) -> DataFrame:
    """Diffs of several files split by file: the diff blocks of each document, put together as changes to, additions and removals of files, by status."""
    b = code.code_blocks(W.docs(spark, sf)).where("lang = 'diff'")
    name = F.concat(F.lit("f"), F.col("block").cast("string"), F.lit(".ts"))
    state = F.col("doc_id") % 3
    head = F.concat(F.lit("diff --git a/"), name, F.lit(" b/"), name, F.when(state == 1, "\nnew file mode 100644\n--- /dev/null\n+++ b/").when(state == 2, "\ndeleted file mode 100644\n--- a/").otherwise("\n--- a/"), name, F.when(state == 1, "").when(state == 2, "\n+++ /dev/null").otherwise(F.concat(F.lit("\n+++ b/"), name)), F.lit("\n@@ -1,9 +1,9 @@\n"), "code")
    whole = b.select("doc_id", "block", head.alias("d")).groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "d"))), lambda x: x["d"]), "").alias("diff"))
    return diffs.file_changes(whole, "doc_id").groupBy("status").agg(F.count(F.lit(1)).alias("files"), F.sum("added").alias("added"), F.sum("deleted").alias("deleted"))


def s16_runtime_events(spark: SparkSession, sf: str) -> DataFrame:
    """Runtime events read from documents that are an array or an object with an array: one a source and day, both forms."""
    r = W.runs(spark, sf).select("source", F.to_date("at").alias("day"), "seq", "exit")
    d = r.groupBy("source", "day").agg(F.to_json(F.collect_list(F.struct("seq", "exit"))).alias("a")).select(F.when(F.dayofmonth("day") % 2 == 0, F.concat(F.lit('{"events": '), "a", F.lit("}"))).otherwise(F.col("a")).alias("text"), "source")
    return records.events_of(d, "text", "seq bigint, exit int").groupBy("source").agg(F.count(F.lit(1)).alias("events"), F.sum((F.col("exit") != 0).cast("bigint")).alias("failed"))


def s18_todos(spark: SparkSession, sf: str) -> DataFrame:
    """Todos read from the comments of source lines: the open todos, written as comments with and without a symbol."""
    i = W.iss(spark, sf).where("kind = 'open_todo' AND summary IS NOT NULL")
    mark = F.when(F.col("issue_key") % 3 == 0, "FIXME").otherwise("TODO")
    lines = i.select("issue_key", F.concat(F.lit("  x = 1  // "), mark, F.when(F.col("symbol").isNull(), "").otherwise(F.concat(F.lit("("), "symbol", F.lit(")"))), F.lit(": "), "summary").alias("content"))
    return code.todo_items(lines).select("issue_key", "mark", "symbol", "text")


def s19_managed_block(spark: SparkSession, sf: str) -> DataFrame:
    """Entries read from the managed block of each author's document, which holds the global notes."""
    n = W.note(spark, sf).where("scope = 'global' AND lesson IS NOT NULL AND lesson <> '' AND severity IS NOT NULL AND recorded_at IS NOT NULL")
    e = n.select(F.coalesce("author", F.lit("")).alias("author"), F.substring(F.sha1(F.col("id")), 1, 12).alias("id"), "severity", F.regexp_replace("lesson", r"\s+", " ").alias("lesson"), F.date_trunc("second", "recorded_at").alias("recorded_at"))
    return records.managed_block(records.managed_block_text(e, "author"), "author").select("author", "id", "severity", "lesson", F.col("recorded_at").cast("timestamp_ntz").alias("recorded_at"))


_BLOCKS = r"""WITH b AS (SELECT doc_id, generate_subscripts(bs, 1)::INT AS block, unnest(bs) AS b FROM (SELECT doc_id, regexp_extract_all(text, '(?s)```[a-z]+\n.*?```') AS bs FROM documents WHERE text IS NOT NULL)),
blocks AS (SELECT doc_id, block, regexp_extract(b, '^```([a-z]+)', 1) AS lang, regexp_extract(b, '(?s)^```[a-z]+\n(.*)```$', 1) AS code FROM b),
lines AS (SELECT doc_id, block, lang, generate_subscripts(ls, 1)::INT AS line, unnest(ls) AS content FROM (SELECT *, string_split(code, chr(10)) AS ls FROM blocks))
"""
_D = r"^([ \t]*)(?:export +)?(?:default +)?(?:async +)?(function|class|interface|type|enum|def|const)[ *]+([A-Za-z_$][A-Za-z0-9_$]*)"
QUERIES = {f.__name__: f for f in (s1_code_blocks, s3_line_symbols, s3_pattern_symbols, s4_call_sites, s5_python_symbols, s12_diff_lines, s17_transcript_turns, s2_config, s9_json_tail, s13_file_changes, s16_runtime_events, s18_todos, s19_managed_block, j3_import_resolution)}
SQL = {
    "s1_code_blocks": _BLOCKS + "SELECT lang, count(*) AS blocks, sum(length(code))::BIGINT AS chars FROM blocks GROUP BY lang",
    "s3_line_symbols": _BLOCKS + f"SELECT doc_id, block, line, regexp_extract(content, '{_D}', 2) AS kind, regexp_extract(content, '{_D}', 3) AS name FROM lines WHERE regexp_matches(content, '{_D}')",
    "s3_pattern_symbols": _BLOCKS + ", d AS (" + " UNION ALL ".join(f"SELECT doc_id, block, lang, line, '{kind}' AS kind, regexp_extract(content, '{rx}', 1) AS name FROM lines WHERE lang = '{lang}' AND regexp_matches(content, '{rx}')" for lang, ps in code.PATTERNS.items() for kind, rx in ps if kind != "method")
    + f") SELECT DISTINCT *, name AS qualified_name FROM d WHERE name NOT IN ({', '.join(map(repr, code.NO_NAMES))})",
    "s4_call_sites": _BLOCKS + rf"SELECT callee, count(*) AS calls FROM (SELECT unnest(regexp_extract_all(content, '([A-Za-z_$][A-Za-z0-9_$.]*)\(', 1)) AS callee FROM lines WHERE NOT regexp_matches(content, '{_D}')) GROUP BY callee",
    "s5_python_symbols": _BLOCKS + f"SELECT doc_id, block, regexp_extract(content, '{_D}', 3) AS name, 'function' AS kind, line, line + 1 AS end_line FROM lines WHERE lang = 'py' AND regexp_matches(content, '^def ')",
    "s12_diff_lines": _BLOCKS + "SELECT doc_id || '-' || block AS key, tag, CASE WHEN tag <> 'del' THEN (sum((tag <> 'del')::INT) OVER (PARTITION BY doc_id, block ORDER BY line))::INT END AS new_line, substr(content, 2) AS content FROM (SELECT *, CASE WHEN content LIKE '+%' THEN 'add' WHEN content LIKE '-%' THEN 'del' ELSE 'ctx' END AS tag FROM lines WHERE lang = 'diff' AND content <> '')",
    "s17_transcript_turns": "SELECT role, count(*) AS turns, count(DISTINCT doc_id) AS documents, sum(length(line))::BIGINT AS chars FROM (SELECT doc_id, line, regexp_extract(line, '^(user|assistant|system): ', 1) AS role FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents WHERE text IS NOT NULL)) WHERE role <> '' GROUP BY role",
    "j3_import_resolution": W.sql("""
, e AS (SELECT file, to_name, nullif(trim(to_id), '') AS to_id FROM edges WHERE file IS NOT NULL AND to_name IS NOT NULL),
i AS (SELECT DISTINCT e.file, t.name, regexp_replace(t.file, '/[^/]*$', '/index') AS module FROM e JOIN sym t ON t.id = e.to_id WHERE t.file IS NOT NULL UNION SELECT DISTINCT file, regexp_extract(to_name, '([^.]*)$', 1), regexp_replace(file, '/[^/]*$', '/index') FROM e WHERE to_id IS NULL)
SELECT s.file AS target_file, s.name AS target, count(DISTINCT i.file) AS files FROM i JOIN sym s ON s.name = i.name AND regexp_replace(s.file, '/[^/]*$', '/index') = i.module WHERE s.file IS NOT NULL GROUP BY 1, 2"""),
    "s2_config": """
SELECT * FROM (VALUES ('full', 'capture', 'inbox'), ('full', 'depth', '5'), ('full', 'exclude', 'node_modules,dist,build,.git,.venv,__pycache__,vendor,out,tmp'), ('full', 'languages', 'python,go'), ('full', 'promote', 'never'), ('full', 'strands', 'tests'),
('part', 'capture', 'auto'), ('part', 'depth', '2'), ('part', 'exclude', 'node_modules,dist,build,.git,.venv,__pycache__,vendor'), ('part', 'languages', 'typescript,python,go,rust,java,ruby,csharp'), ('part', 'promote', 'safe'), ('part', 'strands', 'structural,tests,provenance,invariants'),
('none', 'capture', 'auto'), ('none', 'depth', '3'), ('none', 'exclude', 'node_modules,dist,build,.git,.venv,__pycache__,vendor'), ('none', 'languages', 'typescript,python,go,rust,java,ruby,csharp'), ('none', 'promote', 'safe'), ('none', 'strands', 'structural,tests,provenance,invariants')) v(name, option, value)""",
    "s9_json_tail": W.sql("SELECT seq, source, exit FROM runs WHERE seq % 50 <> 0 ORDER BY seq DESC LIMIT 100"),
    "s13_file_changes": _BLOCKS + "SELECT CASE doc_id % 3 WHEN 1 THEN 'added' WHEN 2 THEN 'deleted' ELSE 'modified' END AS status, count(DISTINCT doc_id || '-' || block) AS files, count(*) FILTER (WHERE content LIKE '+%') AS added, count(*) FILTER (WHERE content LIKE '-%') AS deleted FROM lines WHERE lang = 'diff' GROUP BY 1",
    "s16_runtime_events": W.sql("SELECT source, count(*) AS events, count(*) FILTER (WHERE exit <> 0) AS failed FROM runs GROUP BY source"),
    "s18_todos": W.sql("SELECT issue_key, CASE WHEN issue_key % 3 = 0 THEN 'FIXME' ELSE 'TODO' END AS mark, symbol, trim(summary) AS text FROM iss WHERE kind = 'open_todo' AND trim(summary) <> ''"),
    "s19_managed_block": W.sql("SELECT coalesce(author, '') AS author, substr(sha1(id), 1, 12) AS id, severity, regexp_replace(lesson, '\\s+', ' ', 'g') AS lesson, date_trunc('second', recorded_at) AS recorded_at FROM note WHERE scope = 'global' AND lesson <> '' AND severity IS NOT NULL AND recorded_at IS NOT NULL"),
}
