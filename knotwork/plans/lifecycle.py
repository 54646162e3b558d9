"""Knowledge lifecycle queries: compositions of the operators over notes, issues, runs and documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import classify as C
from ..operators.graph import closure
from ..operators.intervals import folder_of, folders_above
from ..operators.patterns import pattern_matches
from ..operators.sequences import carried
from ..operators.ranking import ISSUE_SEVERITY, first_by, severity_rank, top_by
from ..sources.records import upsert
from ..sources.tables import table
from . import warehouse as W
from .graphs import _SEED, _UP

AS_OF = "2026-07-01"


def _gate(spark: SparkSession, sf: str) -> DataFrame:
    """(name, severity, via, symbols, files, waived) of the rules that the changed files hit: by their symbols, else by the files themselves."""
    changed = W.stale(spark, sf).where("file_changed_since AND file IS NOT NULL").select("file").distinct()
    s = W.sym(spark, sf).join(changed, "file", "left_semi").select(F.coalesce("qualified_name", "name").alias("name"), "file").where("name IS NOT NULL")
    r = W.rules(spark, sf).select("name", F.explode("applies_to").alias("pattern"))
    met = pattern_matches(s, r).join(s, "name").select("pattern", F.col("name").alias("symbol"), "file")
    by_symbol = r.join(met, "pattern").groupBy("name").agg(F.count_distinct("symbol").alias("symbols"), F.count_distinct("file").alias("files")).withColumn("via", F.lit("symbol"))
    rest = r.join(by_symbol.select("name"), "name", "left_anti")
    touched = pattern_matches(changed.select(F.col("file").alias("name")), rest, files=True).select("pattern", F.col("name").alias("file"))
    by_file = rest.join(touched, "pattern").groupBy("name").agg(F.lit(0).cast("bigint").alias("symbols"), F.count_distinct("file").alias("files")).withColumn("via", F.lit("file"))
    waived = W.waivers(spark, sf).select(F.col("invariant").alias("name"), F.lit(True).alias("waived"))
    hits = by_symbol.unionByName(by_file).join(W.rules(spark, sf).select("name", "severity"), "name").join(waived, "name", "left")
    return hits.withColumn("waived", F.coalesce("waived", F.lit(False)))


def k1_gate(spark: SparkSession, sf: str) -> DataFrame:
    """Rules that the changed files hit, by their symbols or else by file globs, whether they are waived, and whether they block (also p2, a9, j18)."""
    return _gate(spark, sf).withColumn("blocking", (F.col("severity") == "block") & ~F.col("waived"))


def k3_brief(spark: SparkSession, sf: str) -> DataFrame:
    """A brief of each symbol with issues: issues, open questions, notes and runs (also k25)."""
    i = W.iss(spark, sf).where("symbol IS NOT NULL").groupBy("symbol").agg(F.count(F.lit(1)).alias("issues"), F.sum((F.col("kind") == "open_question").cast("bigint")).alias("questions"))
    n = W.note(spark, sf).where("symbol IS NOT NULL").groupBy("symbol").agg(F.count(F.lit(1)).alias("notes"), F.max("recorded_at").alias("last_note"))
    r = W.runs(spark, sf).select(F.explode(F.array_distinct("symbols")).alias("symbol")).groupBy("symbol").agg(F.count(F.lit(1)).alias("runs"))
    return i.join(n, "symbol", "left").join(r, "symbol", "left").fillna(0, ["notes", "runs"])


def k7_validate(spark: SparkSession, sf: str) -> DataFrame:
    """What is wrong with notes, each fault a row's kind: expired, expiry unreadable, anchor missing, no anchor."""
    n = W.note(spark, sf)
    t = F.try_to_timestamp("expires_at")
    known = W.sym(spark, sf).select(F.explode(F.array("id", "qualified_name", "name")).alias("symbol")).dropna().distinct()
    mark = lambda d, kind: d.select(F.lit(kind).alias("kind"), "note_key")
    parts = [
        mark(n.where(t < F.lit(AS_OF).cast("timestamp")), "expired"),
        mark(n.where(F.col("expires_at").isNotNull() & t.isNull()), "invalid"),
        mark(n.where("scope = 'symbol' AND symbol IS NOT NULL").join(known, "symbol", "left_anti"), "missing_anchor"),
        mark(n.where("scope = 'symbol' AND symbol IS NULL"), "no_anchor"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def k10_suggestions(spark: SparkSession, sf: str) -> DataFrame:
    """What to remember for tested symbols: up to two open issues of each kind, else a gap, at most two gaps a file."""
    tested = W.runs(spark, sf).select(F.explode("symbols").alias("symbol")).distinct()
    i = W.iss(spark, sf).where("kind IN ('open_question', 'open_todo') AND symbol IS NOT NULL").join(tested, "symbol", "left_semi")
    told = top_by(i, ["symbol", "kind"], [severity_rank("severity", ISSUE_SEVERITY).desc(), "issue_key"], 2).select("symbol", "kind")
    noted = W.note(spark, sf).select("symbol").dropna().distinct()
    gaps = tested.join(told.select("symbol"), "symbol", "left_anti").join(noted, "symbol", "left_anti")
    placed = gaps.join(W.sym(spark, sf).where("file IS NOT NULL").groupBy(F.col("name").alias("symbol")).agg(F.min("file").alias("file")), "symbol")
    capped = top_by(placed, ["file"], ["symbol"], 2).select("symbol", F.lit("gap").alias("kind"))
    return told.unionByName(capped).groupBy("symbol", "kind").agg(F.count(F.lit(1)).alias("suggestions"))


def k12_inbox_review(spark: SparkSession, sf: str) -> DataFrame:
    """Pending items by area: risky ones by their text, and those whose stored topics say otherwise."""
    i = W.inb(spark, sf).where("status = 'pending'").withColumn("risky", F.size(C.risk_topics(F.col("text"))) > 0)
    return i.groupBy("area").agg(F.count(F.lit(1)).alias("pending"), F.sum(F.col("risky").cast("bigint")).alias("risky"), F.sum((F.col("risky") != (F.coalesce(F.size("risk_topics"), F.lit(0)) > 0)).cast("bigint")).alias("differ"))


def k14_contract(spark: SparkSession, sf: str) -> DataFrame:
    """Files that failing runs name symbols of, outside what the impact of the conflicts allows."""
    seeds = W.iss(spark, sf).where("kind = 'conflict'").select(F.col("symbol").alias("id")).join(W.sym(spark, sf).select("id"), "id", "left_semi").distinct()
    s = W.sym(spark, sf).where("file IS NOT NULL").select("id", "name", "file")
    allowed = closure(W.edg(spark, sf), seeds, 2).select("id").unionByName(seeds).join(s, "id").select("file").distinct()
    touched = W.runs(spark, sf).where("exit <> 0").select(F.explode("symbols").alias("name")).distinct().join(s, "name").select("file").distinct()
    return touched.join(allowed, "file", "left_anti")


def k16_lessons(spark: SparkSession, sf: str) -> DataFrame:
    """Notes by scope and severity after one batch of moves: notes of transcripts become global (an upsert by key)."""
    n = W.note(spark, sf).select("note_key", "scope", "severity")
    moved = W.note(spark, sf).where("source = 'transcript'").select("note_key", F.lit("global").alias("scope"), "severity")
    return upsert(n, moved, "note_key").groupBy("scope", "severity").agg(F.count(F.lit(1)).alias("notes"))


def k19_feature_gc(spark: SparkSession, sf: str) -> DataFrame:
    """The twenty heaviest symbols of each feature once weights under 0.05 are cleared."""
    w = W.weights(spark, sf).where("weight >= 0.05").withColumn("weight", F.round("weight", 6))
    return top_by(w, ["label"], [F.desc("weight"), "id"], 20, "position").select("label", "id", "weight", "position")


def k20_feature_context(spark: SparkSession, sf: str) -> DataFrame:
    """For each feature the five newest notes on its symbols."""
    w = W.weights(spark, sf).select("label", F.col("id").alias("symbol"))
    n = W.note(spark, sf).where("symbol IS NOT NULL").select("symbol", "note_key", "recorded_at")
    return top_by(w.join(n, "symbol"), ["label"], [F.col("recorded_at").desc_nulls_last(), "note_key"], 5, "position").select("label", "note_key", "position")


def k21_change_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Per folder: files, symbols and calls, and days on which calls were built."""
    s = W.sym(spark, sf).where("file IS NOT NULL").select(folder_of(F.col("file")).alias("folder"), "file").groupBy("folder").agg(F.count(F.lit(1)).alias("symbols"), F.count_distinct("file").alias("files"))
    e = table(spark, sf, "edges", "file", "built_at").where("file IS NOT NULL").groupBy(folder_of(F.col("file")).alias("folder")).agg(F.count(F.lit(1)).alias("calls"), F.count_distinct(F.to_date("built_at")).alias("days"))
    return s.join(e, "folder", "full_outer").fillna(0)


def k22_resume(spark: SparkSession, sf: str) -> DataFrame:
    """For each symbol in a failing run the three newest open issues."""
    dirty = W.runs(spark, sf).where("exit <> 0").select(F.explode("symbols").alias("symbol")).distinct()
    i = W.iss(spark, sf).where("kind IN ('open_todo', 'open_question') AND symbol IS NOT NULL").join(dirty, "symbol", "left_semi")
    return top_by(i, ["symbol"], [F.col("raised_at").desc_nulls_last(), "issue_key"], 3, "position").select("symbol", "issue_key", "position")


def k24_runtime(spark: SparkSession, sf: str) -> DataFrame:
    """Runtime events for symbols: errors in failing messages, by the symbols whose pattern the event names (the first symbol of the run and all that begin like it), worst and newest first."""
    r = W.runs(spark, sf).where("exit <> 0 AND message IS NOT NULL").select(F.get("symbols", F.lit(0)).alias("named"), "at", F.nullif(F.regexp_extract("message", "([A-Za-z]+Error): ", 1), F.lit("")).alias("kind"))
    r = r.where("kind IS NOT NULL AND named IS NOT NULL").withColumn("pattern", F.concat("named", F.lit("*")))
    met = pattern_matches(W.sym(spark, sf).select(F.coalesce("qualified_name", "name").alias("name")), r.select("pattern").unionByName(r.select(F.col("named").alias("pattern"))))
    hits = met.withColumn("named", F.regexp_replace("pattern", r"\*$", "")).select("name", "named").distinct()
    return r.join(hits, "named").groupBy("name", "kind").agg(F.count(F.lit(1)).alias("times"), F.max("at").alias("last_at"))


def k27_document_history(spark: SparkSession, sf: str) -> DataFrame:
    """Snapshots of each document path by repository: first, unchanged or changed against the one before."""
    d = W.docs(spark, sf).where("repo IS NOT NULL AND path IS NOT NULL").select("repo", "path", "doc_id", "created_at", F.sha1(F.coalesce("text", F.lit(""))).alias("h"))
    w = Window.partitionBy("repo", "path").orderBy("created_at", "doc_id")
    before = F.lag("h").over(w)
    state = F.when(before.isNull(), "first").when(before == F.col("h"), "unchanged").otherwise("changed")
    return d.select("repo", state.alias("state")).groupBy("repo", "state").agg(F.count(F.lit(1)).alias("snapshots"))


def k28_active_area(spark: SparkSession, sf: str) -> DataFrame:
    """The area of each note: its own where its scope is one, else the folder of its evidence, else the area of its symbol's file."""
    n = W.note(spark, sf).select("note_key", "scope", "symbol", "evidence")
    s = W.sym(spark, sf).where("file IS NOT NULL").groupBy(F.col("name").alias("symbol")).agg(F.min("file").alias("file"))
    own = F.when(F.col("scope") == "area", F.rtrim(F.col("symbol"), F.lit("/")))
    path = F.nullif(F.regexp_extract("evidence", r"^(src/[^/]+)/", 1), F.lit(""))
    area = F.coalesce(own, path, folder_of(F.col("file")))
    return n.join(s, "symbol", "left").select(area.alias("area")).where("area IS NOT NULL").groupBy("area").agg(F.count(F.lit(1)).alias("notes"))


def k29_todo_sync(spark: SparkSession, sf: str) -> DataFrame:
    """Open todos that are no note yet, by symbol and text: what a sync would insert."""
    t = W.iss(spark, sf).where("kind = 'open_todo' AND symbol IS NOT NULL").select("symbol", F.lower(F.trim("summary")).alias("text")).distinct()
    had = W.note(spark, sf).where("source = 'todo' AND symbol IS NOT NULL").select("symbol", F.lower(F.trim("lesson")).alias("text")).distinct()
    return t.join(had, ["symbol", "text"], "left_anti")


def k31_area_once(spark: SparkSession, sf: str) -> DataFrame:
    """For each run the deepest registered area above its command's folder, where no earlier run of the source has shown it."""
    areas = W.note(spark, sf).where("scope = 'area' AND symbol IS NOT NULL").select(F.rtrim(F.col("symbol"), F.lit("/")).alias("area")).distinct()
    r = W.runs(spark, sf).select("seq", "source", F.concat(F.regexp_extract("command", r"(src/[^ ]+)", 1), F.lit("/x")).alias("path"))
    above = r.select("seq", "source", F.explode(folders_above(F.col("path"))).alias("area")).join(areas, "area", "left_semi")
    deepest = above.groupBy("seq", "source").agg(F.max_by("area", F.length("area")).alias("area"))
    return deepest.groupBy("source", "area").agg(F.min("seq").alias("seq"))


def k32_overview(spark: SparkSession, sf: str) -> DataFrame:
    """Symbols outside tests by kind, and the first fifteen to look at: functions and classes first, by file and name."""
    s = W.sym(spark, sf).where(~F.coalesce(F.col("file").rlike(r"[.](?:test|spec)[.]"), F.lit(False)))
    total = s.groupBy("kind").agg(F.count(F.lit(1)).alias("symbols")).select("kind", "symbols", F.lit(None).cast("string").alias("id"), F.lit(0).alias("position"))
    name = F.coalesce("qualified_name", "name")
    first = s.select("kind", "id", F.col("kind").isin("function", "class").cast("int").alias("own"), "file", name.alias("n")).orderBy(F.desc("own"), F.col("file").asc_nulls_last(), "n", "id").limit(15)
    order = F.row_number().over(Window.orderBy(F.desc("own"), F.col("file").asc_nulls_last(), "n", "id"))  # fifteen rows
    return total.unionByName(first.select("kind", F.lit(None).cast("bigint").alias("symbols"), "id", order.alias("position")))


def k33_attribution(spark: SparkSession, sf: str) -> DataFrame:
    """The symbol of each run: the first named, else the last one named before by a run of its source, else the first changed file's symbol (the last resort: what the working tree changes)."""
    r = W.runs(spark, sf).select("seq", "source", F.get("symbols", F.lit(0)).alias("named"))
    last = carried(r, ["source"], F.floor(F.col("seq") / 4096), ["seq"], "named", "before", own=False)
    changed = W.sym(spark, sf).join(W.stale(spark, sf).where("file_changed_since AND file IS NOT NULL").select("file").distinct(), "file", "left_semi").agg(F.min_by(F.coalesce("qualified_name", "name"), "symbol_key").alias("changed"))
    return last.join(F.broadcast(changed)).select("seq", F.coalesce("named", "before", "changed").alias("symbol")).where("symbol IS NOT NULL")  # one row


def x14_prompt_context(spark: SparkSession, sf: str) -> DataFrame:
    """Notes that bench prompts call for: on a symbol they name, without what the prompt says already (first 80 characters)."""
    named = F.explode(F.array_distinct(F.regexp_extract_all("prompt", F.lit("([a-z]+(?:[A-Z][A-Za-z0-9]*|_[a-z0-9]+)+)"), 1)))
    p = table(spark, sf, "bench_runs", "run_key", "prompt").select("run_key", "prompt", named.alias("symbol"))
    n = W.note(spark, sf).where("symbol IS NOT NULL AND lesson IS NOT NULL").select("symbol", "note_key", F.substring("lesson", 1, 80).alias("start"))
    return p.join(n, "symbol").where(~F.col("prompt").contains(F.col("start"))).groupBy("run_key").agg(F.count_distinct("note_key").alias("notes"))


def x16_scope_classifier(spark: SparkSession, sf: str) -> DataFrame:
    """Where each lesson belongs by its wording: scope, target, confidence and whether that is doubtful, from the symbols, files and features it names and its general, policy and place words."""
    n = W.note(spark, sf).where("lesson IS NOT NULL").select("note_key", "lesson")
    t = F.col("lesson")
    ticked = F.flatten(F.transform(C.found(t, C.BACKTICKED, 1), lambda x: F.filter(F.split(x, "[^A-Za-z0-9_.$]+"), lambda w: F.length(w) >= 3)))
    said = n.select("note_key", F.posexplode(F.array_distinct(F.concat(C.found(t, C.SYMBOL_LIKE), C.found(t, C.QUALIFIED), ticked))).alias("pos", "s"))
    known = W.sym(spark, sf).select(F.explode(F.array("name", "qualified_name")).alias("key")).dropna().distinct()
    symbols = said.select("note_key", "pos", "s", F.explode(F.array_distinct(F.array("s", F.element_at(F.split("s", r"\."), -1)))).alias("key")).join(known, "key", "left_semi").select("note_key", "pos", "s").distinct()
    paths = W.sym(spark, sf).select("file").dropna().distinct().select(F.explode(F.transform(F.sequence(F.lit(1), F.size(F.split("file", "/"))), lambda i: F.array_join(F.slice(F.split("file", "/"), i, 1000), "/"))).alias("f")).distinct()
    named = n.select("note_key", F.posexplode(F.array_distinct(C.found(t, C.FILE_PATH))).alias("pos", "f")).join(paths, "f", "left_semi")
    symbols = symbols.join(named.select("note_key", F.col("f").alias("s")), ["note_key", "s"], "left_anti")
    labels = W.runs(spark, sf).select(F.lower("feature").alias("label")).dropna().distinct()
    features = n.select("note_key", F.explode(F.array_distinct(F.split(F.lower("lesson"), "[^a-z0-9-]+"))).alias("label")).join(labels, "label", "left_semi")
    agg = lambda d, v, o, name: d.groupBy("note_key").agg(F.count(F.lit(1)).alias("n_" + name), F.min_by(v, o).alias("first_" + name))
    m = n.join(agg(symbols, "s", "pos", "s"), "note_key", "left").join(agg(named, "f", "pos", "f"), "note_key", "left").join(agg(features, "label", "label", "e"), "note_key", "left")
    m = m.fillna(0, ["n_s", "n_f", "n_e"]).withColumns({"g": C.count(t, C.GENERIC), "p": C.count(t, C.POLICY), "here": C.count(t, C.POSITIONAL)})
    doubt = F.expr("here >= 1 AND n_s = 0 AND n_f = 0")
    out = lambda scope, target, confidence, ambiguous: F.struct(F.lit(scope).alias("scope"), target.alias("target"), (F.lit(confidence) if isinstance(confidence, float) else confidence).alias("confidence"), ambiguous.alias("ambiguous"))
    no, none = F.lit(False), F.lit(None).cast("string")
    rule = (
        F.when(F.expr("g >= 1 AND n_s = 0 AND n_e = 0"), out("global", none, 0.85, no))
        .when(F.expr("n_s = 1 AND g = 0"), out("symbol", F.col("first_s"), 0.9, no))
        .when(F.expr("n_s >= 2 AND n_e >= 1"), out("feature", F.col("first_e"), 0.85, no))
        .when(F.expr("n_f >= 1 AND n_s = 0"), out("file", F.col("first_f"), F.when(F.col("n_f") == 1, 0.85).otherwise(0.7), F.col("n_f") > 1))
        .when(F.expr("n_e = 1 AND n_s = 0"), out("feature", F.col("first_e"), 0.8, doubt))
        .when(F.expr("g >= 2 AND n_s = 0 AND n_f = 0"), out("global", none, 0.9, doubt))
        .when(F.expr("g >= 1 AND p >= 1 AND n_s = 0 AND n_f = 0"), out("global", none, 0.8, doubt))
        .when(F.expr("n_s = 0 AND n_f = 0 AND n_e = 0"), out("global", none, 0.6, F.lit(True)))
        .otherwise(out("symbol", F.col("first_s"), 0.55, F.lit(True)))
    )
    return m.select("note_key", rule.alias("r")).select("note_key", "r.scope", "r.target", "r.confidence", "r.ambiguous")


_IS = "CASE severity WHEN 'block' THEN 3 WHEN 'warn' THEN 2 WHEN 'info' THEN 1 ELSE 0 END"
_FITS = "(CASE WHEN {p} LIKE '%*' THEN starts_with({q}, substr({p}, 1, length({p}) - 1)) WHEN {p} LIKE '*%' THEN suffix({q}, substr({p}, 2)) ELSE {q} = {p} OR suffix({q}, '.' || {p}) OR suffix({q}, '/' || {p}) END)"
_GATE = """
, chg AS (SELECT DISTINCT file FROM stale_entries WHERE file_changed_since AND file IS NOT NULL), cs AS (SELECT coalesce(qualified_name, name) AS q, file FROM sym WHERE file IN (SELECT file FROM chg)),
pat AS (SELECT name, severity, unnest(applies_to) AS p FROM rules),
h1 AS (SELECT name, 'symbol' AS via, count(DISTINCT q) AS symbols, count(DISTINCT file) AS files FROM pat JOIN cs ON """ + _FITS.format(p="p", q="q") + """ GROUP BY name),
h2 AS (SELECT name, 'file' AS via, 0::BIGINT AS symbols, count(DISTINCT file) AS files FROM pat JOIN chg ON file = p OR (p LIKE '%/*' AND starts_with(file, substr(p, 1, length(p) - 1))) OR (p LIKE '%**' AND starts_with(file, substr(p, 1, length(p) - 2))) WHERE name NOT IN (SELECT name FROM h1) GROUP BY name),
gate AS (SELECT h.name, r.severity, via, symbols, files, h.name IN (SELECT invariant FROM waivers) AS waived FROM (SELECT * FROM h1 UNION ALL SELECT * FROM h2) h JOIN rules r ON r.name = h.name)"""
_FUNCS = (k1_gate, k3_brief, k7_validate, k10_suggestions, k12_inbox_review, k14_contract, k16_lessons, k19_feature_gc, k20_feature_context, k21_change_summary, k22_resume, k24_runtime, k27_document_history, k28_active_area, k29_todo_sync, k31_area_once, k32_overview, k33_attribution, x14_prompt_context, x16_scope_classifier)
QUERIES = {f.__name__: f for f in _FUNCS}
_FOLDER = "regexp_replace(file, '/?[^/]*$', '')"
SQL = {
    "k1_gate": W.sql(_GATE + " SELECT *, severity = 'block' AND NOT waived AS blocking FROM gate"),
    "k3_brief": W.sql("""
SELECT i.symbol, issues, questions, coalesce(notes, 0) AS notes, last_note, coalesce(runs, 0) AS runs FROM (SELECT symbol, count(*) AS issues, count(*) FILTER (WHERE kind = 'open_question') AS questions FROM iss WHERE symbol IS NOT NULL GROUP BY 1) i
LEFT JOIN (SELECT symbol, count(*) AS notes, max(recorded_at) AS last_note FROM note WHERE symbol IS NOT NULL GROUP BY 1) n USING (symbol) LEFT JOIN (SELECT symbol, count(*) AS runs FROM (SELECT unnest(list_distinct(symbols)) AS symbol FROM runs) GROUP BY 1) r USING (symbol)"""),
    "k7_validate": W.sql("""
, known AS (SELECT id AS k FROM sym UNION SELECT qualified_name FROM sym WHERE qualified_name IS NOT NULL UNION SELECT name FROM sym WHERE name IS NOT NULL)
SELECT 'expired' AS kind, note_key FROM note WHERE try_cast(expires_at AS TIMESTAMP) < TIMESTAMP '2026-07-01' UNION ALL SELECT 'invalid', note_key FROM note WHERE expires_at IS NOT NULL AND try_cast(expires_at AS TIMESTAMP) IS NULL
UNION ALL SELECT 'missing_anchor', note_key FROM note WHERE scope = 'symbol' AND symbol IS NOT NULL AND symbol NOT IN (SELECT k FROM known) UNION ALL SELECT 'no_anchor', note_key FROM note WHERE scope = 'symbol' AND symbol IS NULL"""),
    "k10_suggestions": W.sql(f"""
, tested AS (SELECT DISTINCT unnest(symbols) AS symbol FROM runs),
told AS (SELECT symbol, kind FROM iss WHERE kind IN ('open_question', 'open_todo') AND symbol IN (SELECT symbol FROM tested) QUALIFY row_number() OVER (PARTITION BY symbol, kind ORDER BY {_IS} DESC, issue_key) <= 2),
gaps AS (SELECT symbol, min(file) AS file FROM tested JOIN sym ON sym.name = tested.symbol WHERE file IS NOT NULL AND symbol NOT IN (SELECT symbol FROM told) AND symbol NOT IN (SELECT symbol FROM note WHERE symbol IS NOT NULL) GROUP BY symbol)
SELECT symbol, kind, count(*) AS suggestions FROM (SELECT * FROM told UNION ALL SELECT symbol, 'gap' FROM (SELECT symbol FROM gaps QUALIFY row_number() OVER (PARTITION BY file ORDER BY symbol) <= 2)) GROUP BY 1, 2"""),
    "k12_inbox_review": W.sql(f"SELECT area, count(*) AS pending, sum(risky::INT)::BIGINT AS risky, sum((risky <> (coalesce(len(risk_topics), 0) > 0))::INT)::BIGINT AS differ FROM (SELECT *, len({C.sql_topics('text')}) > 0 AS risky FROM inb WHERE status = 'pending') GROUP BY area"),
    "k14_contract": W.sql(_SEED + _UP + " SELECT DISTINCT file FROM sym WHERE file IS NOT NULL AND name IN (SELECT unnest(symbols) FROM runs WHERE exit <> 0) AND file NOT IN (SELECT file FROM sym WHERE file IS NOT NULL AND (id IN (SELECT id FROM near WHERE depth <= 2) OR id IN (SELECT id FROM seed)))"),
    "k16_lessons": W.sql("SELECT CASE WHEN source = 'transcript' THEN 'global' ELSE scope END AS scope, severity, count(*) AS notes FROM note GROUP BY 1, 2"),
    "k19_feature_gc": W.sql("SELECT * FROM (SELECT label, id, round(weight, 6) AS weight, row_number() OVER (PARTITION BY label ORDER BY round(weight, 6) DESC, id) AS position FROM weights WHERE weight >= 0.05) WHERE position <= 20"),
    "k20_feature_context": W.sql("SELECT * FROM (SELECT label, note_key, row_number() OVER (PARTITION BY label ORDER BY recorded_at DESC NULLS LAST, note_key) AS position FROM weights w JOIN note n ON n.symbol = w.id) WHERE position <= 5"),
    "k21_change_summary": W.sql(f"SELECT coalesce(s.folder, e.folder) AS folder, coalesce(symbols, 0) AS symbols, coalesce(files, 0) AS files, coalesce(calls, 0) AS calls, coalesce(days, 0) AS days FROM (SELECT {_FOLDER} AS folder, count(*) AS symbols, count(DISTINCT file) AS files FROM sym WHERE file IS NOT NULL GROUP BY 1) s FULL JOIN (SELECT {_FOLDER} AS folder, count(*) AS calls, count(DISTINCT built_at::DATE) AS days FROM edges WHERE file IS NOT NULL GROUP BY 1) e ON s.folder = e.folder"),
    "k22_resume": W.sql("SELECT * FROM (SELECT symbol, issue_key, row_number() OVER (PARTITION BY symbol ORDER BY raised_at DESC NULLS LAST, issue_key) AS position FROM iss WHERE kind IN ('open_todo', 'open_question') AND symbol IN (SELECT unnest(symbols) FROM runs WHERE exit <> 0)) WHERE position <= 3"),
    "k24_runtime": W.sql("""
, r AS (SELECT symbols[1] AS named, "at", nullif(regexp_extract(message, '([A-Za-z]+Error): ', 1), '') AS kind FROM runs WHERE exit <> 0 AND message IS NOT NULL), q AS (SELECT DISTINCT coalesce(qualified_name, name) AS name FROM sym)
SELECT name, kind, count(*) AS times, max("at") AS last_at FROM r JOIN q ON starts_with(name, named) OR suffix(name, '.' || named) OR suffix(name, '/' || named) WHERE kind IS NOT NULL AND named IS NOT NULL GROUP BY 1, 2"""),
    "k27_document_history": "SELECT repo, CASE WHEN p IS NULL THEN 'first' WHEN p = h THEN 'unchanged' ELSE 'changed' END AS state, count(*) AS snapshots FROM (SELECT repo, h, lag(h) OVER (PARTITION BY repo, path ORDER BY created_at NULLS FIRST, doc_id) AS p FROM (SELECT *, sha1(coalesce(text, '')) AS h FROM documents WHERE repo IS NOT NULL AND path IS NOT NULL)) GROUP BY 1, 2",
    "k28_active_area": W.sql(f"SELECT area, count(*) AS notes FROM (SELECT coalesce(CASE WHEN scope = 'area' THEN rtrim(n.symbol, '/') END, nullif(regexp_extract(evidence, '^(src/[^/]+)/', 1), ''), {_FOLDER}) AS area FROM note n LEFT JOIN (SELECT name, min(file) AS file FROM sym WHERE file IS NOT NULL GROUP BY name) s ON s.name = n.symbol) WHERE area IS NOT NULL GROUP BY area"),
    "k29_todo_sync": W.sql("SELECT DISTINCT symbol, lower(trim(summary)) AS text FROM iss WHERE kind = 'open_todo' AND symbol IS NOT NULL AND (symbol, lower(trim(summary))) NOT IN (SELECT symbol, lower(trim(lesson)) FROM note WHERE source = 'todo' AND symbol IS NOT NULL AND lesson IS NOT NULL)"),
    "k31_area_once": W.sql("""
, areas AS (SELECT DISTINCT rtrim(symbol, '/') AS area FROM note WHERE scope = 'area' AND symbol IS NOT NULL)
SELECT source, area, min(seq) AS seq FROM (SELECT seq, source, arg_max(area, length(area)) AS area FROM runs JOIN areas ON starts_with(regexp_extract(command, '(src/[^ ]+)', 1) || '/x', area || '/') GROUP BY 1, 2) GROUP BY 1, 2"""),
    "k32_overview": W.sql("""
, s AS (SELECT kind, id, (kind IN ('function', 'class'))::INT AS own, file, coalesce(qualified_name, name) AS n FROM sym WHERE NOT coalesce(regexp_matches(file, '[.](?:test|spec)[.]'), false))
SELECT kind, count(*) AS symbols, NULL::VARCHAR AS id, 0 AS position FROM s GROUP BY kind UNION ALL SELECT kind, NULL, id, position FROM (SELECT kind, id, row_number() OVER (ORDER BY coalesce(own, 0) DESC, file NULLS LAST, n, id) AS position FROM s) WHERE position <= 15"""),
    "k33_attribution": W.sql("SELECT seq, symbol FROM (SELECT seq, coalesce(symbols[1], last_value(symbols[1] IGNORE NULLS) OVER (PARTITION BY source ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), (SELECT arg_min(coalesce(qualified_name, name), symbol_key) FROM sym WHERE file IN (SELECT file FROM stale_entries WHERE file_changed_since))) AS symbol FROM runs) WHERE symbol IS NOT NULL"),
    "x14_prompt_context": W.sql("SELECT run_key, count(DISTINCT note_key) AS notes FROM (SELECT run_key, prompt, unnest(list_distinct(regexp_extract_all(prompt, '[a-z]+(?:[A-Z][A-Za-z0-9]*|_[a-z0-9]+)+'))) AS symbol FROM bench_runs) JOIN note USING (symbol) WHERE lesson IS NOT NULL AND NOT contains(prompt, substr(lesson, 1, 80)) GROUP BY run_key"),
    "x16_scope_classifier": W.sql(f"""
, known AS (SELECT name AS k FROM sym WHERE name IS NOT NULL UNION SELECT qualified_name FROM sym WHERE qualified_name IS NOT NULL), files AS (SELECT DISTINCT file FROM sym WHERE file IS NOT NULL), labels AS (SELECT DISTINCT lower(feature) AS l FROM runs WHERE feature IS NOT NULL),
c AS (SELECT note_key, lesson, list_concat(list_concat({C.sql_found('lesson', C.SYMBOL_LIKE)}, {C.sql_found('lesson', C.QUALIFIED)}), list_filter(flatten(list_transform({C.sql_found('lesson', C.BACKTICKED, 1)}, lambda x: string_split_regex(x, '[^A-Za-z0-9_.$]+'))), lambda w: length(w) >= 3)) AS cs, {C.sql_found('lesson', C.FILE_PATH)} AS fs FROM note WHERE lesson IS NOT NULL),
sy AS (SELECT note_key, s, min(i) AS i FROM (SELECT note_key, unnest(cs) AS s, generate_subscripts(cs, 1) AS i FROM c) WHERE s IN (SELECT k FROM known) OR list_last(string_split(s, '.')) IN (SELECT k FROM known) GROUP BY 1, 2),
tails AS (SELECT DISTINCT array_to_string(ps[i:], '/') AS f FROM (SELECT ps, unnest(range(1, len(ps) + 1)) AS i FROM (SELECT string_split(file, '/') AS ps FROM files))),
fl AS (SELECT note_key, f, min(i) AS i FROM (SELECT note_key, unnest(fs) AS f, generate_subscripts(fs, 1) AS i FROM c) WHERE f IN (SELECT f FROM tails) GROUP BY 1, 2),
fe AS (SELECT DISTINCT note_key, l FROM (SELECT note_key, unnest(string_split_regex(lower(lesson), '[^a-z0-9-]+')) AS l FROM c) WHERE l IN (SELECT l FROM labels)),
a AS (SELECT note_key, count(*) AS n_s, arg_min(s, i) AS first_s FROM sy WHERE NOT EXISTS (SELECT 1 FROM fl WHERE fl.note_key = sy.note_key AND fl.f = sy.s) GROUP BY 1), b AS (SELECT note_key, count(*) AS n_f, arg_min(f, i) AS first_f FROM fl GROUP BY 1), d AS (SELECT note_key, count(*) AS n_e, min(l) AS first_e FROM fe GROUP BY 1),
m AS (SELECT c.note_key, coalesce(n_s, 0) AS s, coalesce(n_f, 0) AS f, coalesce(n_e, 0) AS e, first_s, first_f, first_e, {C.sql_count('lesson', C.GENERIC)} AS g, {C.sql_count('lesson', C.POLICY)} AS p, {C.sql_count('lesson', C.POSITIONAL)} AS h FROM c LEFT JOIN a USING (note_key) LEFT JOIN b USING (note_key) LEFT JOIN d USING (note_key)),
k AS (SELECT *, CASE WHEN g >= 1 AND s = 0 AND e = 0 THEN 1 WHEN s = 1 AND g = 0 THEN 2 WHEN s >= 2 AND e >= 1 THEN 3 WHEN f >= 1 AND s = 0 THEN 4 WHEN e = 1 AND s = 0 THEN 5 WHEN g >= 2 AND s = 0 AND f = 0 THEN 6 WHEN g >= 1 AND p >= 1 AND s = 0 AND f = 0 THEN 7 WHEN s = 0 AND f = 0 AND e = 0 THEN 8 ELSE 9 END AS r FROM m)
SELECT note_key, ['global', 'symbol', 'feature', 'file', 'feature', 'global', 'global', 'global', 'symbol'][r] AS scope, CASE WHEN r IN (2, 9) THEN first_s WHEN r IN (3, 5) THEN first_e WHEN r = 4 THEN first_f END AS target,
CASE WHEN r = 4 AND f > 1 THEN 0.7::DOUBLE ELSE [0.85, 0.9, 0.85, 0.85, 0.8, 0.9, 0.8, 0.6, 0.55][r]::DOUBLE END AS confidence, CASE WHEN r IN (8, 9) THEN true WHEN r = 4 THEN f > 1 WHEN r IN (5, 6, 7) THEN h >= 1 AND s = 0 AND f = 0 ELSE false END AS ambiguous FROM k"""),
}
