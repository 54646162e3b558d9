"""Text queries: tokens, search, recall, similarity, classifiers and extractors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import classify as C
from ..functions import text as X
from ..operators.greedy import fold_repeats, star_clusters
from ..operators.patterns import pattern_matches
from ..operators.ranking import first_by, top_by
from ..sources.tables import table
from . import warehouse as W

# What the search queries look for.
ASKED = ["retry", "tracelog", "trimCursorZinazubi", "split token", "audit batch store"]
RECALLED = ["empty batches", "retry counter", "rounding step nightly", "holds the lock"]
_TEST_PATH = r"(?i)(?:^|/)(?:tests?|__tests__|spec)/|\.(?:test|spec)\.[cm]?[jt]sx?$"


def x1_identifier_parts(spark: SparkSession, sf: str) -> DataFrame:
    """Parts of every symbol name."""
    return table(spark, sf, "symbols", "symbol_key", "name").select("symbol_key", F.array_join(X.split_identifier(F.col("name")), " ").alias("parts"))


def x2_code_tokens(spark: SparkSession, sf: str) -> DataFrame:
    """The first two hundred tokens of every document, in order."""
    return W.docs(spark, sf).select("doc_id", F.array_join(X.code_tokens(F.col("text"), X.TEXT_TOKEN_CAP), " ").alias("tokens"))


def _asked(spark: SparkSession, queries: list[str]) -> DataFrame:
    q = spark.createDataFrame([(x,) for x in queries], "query string")
    return q.select("query", F.lower(F.trim("query")).alias("q"), X.code_tokens(F.col("query")).alias("terms"))


def _name_tier(q, name, qualified):
    return (
        F.when(qualified == q, 100).when(name == q, 95).when(qualified.startswith(q), 85).when(name.startswith(q), 80).when(qualified.contains(q), 65).when(name.contains(q), 60)
    )


def _searched(spark: SparkSession, sf: str) -> DataFrame:
    s = W.sym(spark, sf).select("id", "name", "file", "kind", F.lower("name").alias("n"), F.lower("qualified_name").alias("qn"), F.coalesce("tokens", F.array()).alias("tokens"))
    return s.join(F.broadcast(_asked(spark, ASKED)))  # a stated query set of fixed size


def x4_search(spark: SparkSession, sf: str) -> DataFrame:
    """The twenty best symbols for each query: name tiers, then token tiers, less for test files, repeats of name, kind and file once (also x3, t2, x15)."""
    s = _searched(spark, sf)
    present = F.size(F.array_intersect("terms", "tokens"))
    tokens = F.when(F.array_contains("tokens", F.col("q")), 50).when((F.size("terms") > 0) & (present == F.size("terms")), 48).when(present > 0, 30 + X.js_round(18 * present / F.size("terms")).cast("int")).when(F.exists("tokens", lambda t: t.contains(F.col("q"))), 35)
    score = F.coalesce(_name_tier(F.col("q"), F.col("n"), F.col("qn")), tokens)
    hits = s.withColumn("score", score - F.when(F.col("file").rlike(_TEST_PATH), 12).otherwise(0)).where("score IS NOT NULL")
    order = [F.desc("score"), F.length("name"), "file", "id"]
    return top_by(first_by(hits, ["query", "name", "kind", "file"], order), ["query"], order, 20, "position").select("query", "id", "score", "position")


def x5_bm25(spark: SparkSession, sf: str) -> DataFrame:
    """The twenty best symbols for each query by BM25 over distinct tokens, with the name tier on top."""
    s = W.sym(spark, sf)
    doc = F.array_distinct(F.concat(X.split_identifier(F.col("name")), F.coalesce(X.split_identifier(F.col("qualified_name")), F.array()), F.coalesce("tokens", F.array())))
    d = s.select("id", "name", "file", "kind", F.lower("name").alias("n"), F.lower("qualified_name").alias("qn"), doc.alias("doc")).withColumn("dl", F.greatest(F.size("doc"), F.lit(1)))
    stats = d.agg(F.count(F.lit(1)).alias("N"), F.avg(F.size("doc")).alias("avgdl"))
    asked = _asked(spark, ASKED).withColumn("terms", F.when(F.size("terms") > 0, F.col("terms")).otherwise(F.array("q")))
    terms = asked.select("query", F.explode("terms").alias("term"))
    posted = d.select("id", "dl", F.explode("doc").alias("term")).join(F.broadcast(terms), "term")
    df = posted.select("term", "id").distinct().groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log(1 + (F.col("N") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    gain = idf * 2.5 / (1 + 1.5 * (1 - 0.75 + 0.75 * F.col("dl") / F.col("avgdl")))
    bm = posted.join(df, "term").join(F.broadcast(stats)).groupBy("query", "id").agg(F.sum(gain).alias("bm"))
    tier = d.join(F.broadcast(asked.select("query", "q"))).select("query", "id", _name_tier(F.col("q"), F.col("n"), F.col("qn")).alias("tier")).where("tier IS NOT NULL")
    both = bm.join(tier, ["query", "id"], "full_outer").join(d.select("id", "name", "file", "kind"), "id")
    score = F.round(F.coalesce("tier", F.lit(0)) + F.coalesce("bm", F.lit(0.0)) - F.when(F.col("file").rlike(_TEST_PATH), 12).otherwise(0), 5)
    order = [F.desc("score"), F.length("name"), "file", "id"]
    return top_by(first_by(both.withColumn("score", score), ["query", "name", "kind", "file"], order), ["query"], order, 20, "position").select("query", "id", "score", "position")


def x6_recall(spark: SparkSession, sf: str) -> DataFrame:
    """The twenty notes and issues that answer each query best: whole phrase, all, some or parts of tokens, and a nudge by severity (also x7, t3)."""
    n = W.note(spark, sf).where("lesson IS NOT NULL").select(F.lit("note").alias("kind"), F.col("note_key").alias("key"), F.col("lesson").alias("text"), (F.when(F.col("severity") == "high", 8).when(F.col("severity") == "low", -2).otherwise(0)).alias("nudge"))
    i = W.iss(spark, sf).where("summary IS NOT NULL").select(F.lit("issue").alias("kind"), F.col("issue_key").alias("key"), F.col("summary").alias("text"), (F.when(F.col("severity") == "block", 10).when(F.col("severity") == "warn", 4).otherwise(0)).alias("nudge"))
    m = n.unionByName(i).withColumn("tokens", X.code_tokens(F.col("text"), X.TEXT_TOKEN_CAP)).join(F.broadcast(_asked(spark, RECALLED)))  # a stated query set of fixed size
    present = F.size(F.array_intersect("terms", "tokens"))
    by_token = F.when(present == F.size("terms"), 70).when(present > 0, 30 + X.js_round(38 * present / F.size("terms")).cast("int")).when(F.exists("tokens", lambda t: F.exists(F.col("terms"), lambda q: t.contains(q))), 28).otherwise(0)
    score = F.greatest(F.when(F.lower("text").contains(F.col("q")), 90).otherwise(0), F.when(F.size("terms") > 0, by_token).otherwise(0))
    hits = m.withColumn("base", score).where("base > 0").withColumn("score", F.col("base") + F.col("nudge"))
    return top_by(hits, ["query"], [F.desc("score"), F.length("text"), "kind", "key"], 20, "position").select("query", "kind", "key", "score", "position")


def x8_jaccard(spark: SparkSession, sf: str) -> DataFrame:
    """Similarity of each note's lesson and evidence."""
    t = W.note(spark, sf).select("note_key", X.lexical_tokens(F.col("lesson")).alias("a"), X.lexical_tokens(F.col("evidence")).alias("b"))
    return t.select("note_key", F.round(X.jaccard(F.col("a"), F.col("b")), 6).alias("similarity")).where("similarity > 0")


def x9_rejected(spark: SparkSession, sf: str) -> DataFrame:
    """For each todo issue the five promoted notes of its symbol it resembles by 0.25 or more."""
    words = lambda c: X.lexical_tokens(F.col(c), X.REJECTED_STOP, 3)
    p = W.iss(spark, sf).where("kind = 'open_todo' AND symbol IS NOT NULL").select("issue_key", "symbol", words("summary").alias("p"))
    d = W.note(spark, sf).where("promoted AND symbol IS NOT NULL").select("note_key", "symbol", words("lesson").alias("d"))
    m = p.join(d, "symbol").withColumn("sim", X.jaccard(F.col("p"), F.col("d"))).where("sim >= 0.25").withColumn("similarity", X.js_round(F.col("sim"), 2))
    return top_by(m, ["issue_key"], [F.desc("similarity"), "note_key"], 5, "position").select("issue_key", "note_key", "similarity", "position")


def x10_star_clusters(spark: SparkSession, sf: str) -> DataFrame:
    """Clusters of three or more similar notes of a symbol, around their first (also k8)."""
    n = W.note(spark, sf).where("symbol IS NOT NULL AND NOT coalesce(promoted, false)").select("symbol", "note_key", F.array_sort(X.lexical_tokens(F.col("lesson"))).alias("tokens"))
    many = n.groupBy("symbol").agg(F.count(F.lit(1)).alias("all")).where("all >= 3").select("symbol")
    g = n.join(many, "symbol", "left_semi").groupBy("symbol", "tokens").agg(F.min("note_key").alias("key"), F.count(F.lit(1)).alias("n"))
    return star_clusters(g.select("symbol", F.col("key").alias("ord"), "key", "tokens", "n"), "symbol")


def x11_folding(spark: SparkSession, sf: str) -> DataFrame:
    """Lessons of each symbol folded onto the first of their wording, with count and highest confidence; promoted at 2 and 0.75 (also r6)."""
    n = W.note(spark, sf).where("symbol IS NOT NULL AND source = 'transcript'").select("symbol", F.col("note_key").alias("ord"), F.col("note_key").alias("key"), X.lexical_tokens(F.col("lesson")).alias("tokens"), F.coalesce("confidence", F.col("classifier.confidence")).alias("confidence"))
    return fold_repeats(n, "symbol").withColumn("promoted", (F.col("count") >= 2) & (F.col("confidence") >= 0.75))


def x13_symbol_inference(spark: SparkSession, sf: str) -> DataFrame:
    """The five symbols that each bench prompt speaks of: its identifiers and longer words against qualified name (100), name (95), last parts of the qualified name (85), beginnings of either (70, 65), and its features' symbols (90 and more) (also k23 plan).

    Words are matched once for all prompts; beginnings are looked up by pattern keys.
    """
    t, low = F.col("prompt"), F.lower("name")
    ticked = F.flatten(F.transform(C.found(t, C.BACKTICKED, 1), lambda x: F.split(x, "[^A-Za-z0-9_.]+")))
    words = F.array_distinct(F.concat(ticked, *(C.found(t, p, 1) for p in C.CANDIDATES), F.filter(C.found(t, C.SNAKE, 1), lambda w: w.contains("_")), F.filter(C.found(t, C.LONG_WORD, 1), lambda w: ~w.isin(C.FILLERS))))
    p = table(spark, sf, "bench_runs", "run_key", "prompt").where("prompt IS NOT NULL")
    said = p.select("run_key", F.explode(F.filter(words, lambda w: (F.length(w) >= 4) & ~w.isin(C.NO_CANDIDATES))).alias("w")).select("run_key", F.lower("w").alias("cand"))
    s = W.sym(spark, sf).select("id", "symbol_key", low.alias("n"), F.lower("qualified_name").alias("q"), F.coalesce("qualified_name", "name").alias("key"))
    cands = said.select("cand").distinct()
    tails = F.transform(F.filter(F.sequence(F.lit(1), F.length("q")), lambda i: F.substr(F.col("q"), i, F.lit(1)) == "."), lambda i: F.struct(F.lit(85).alias("score"), F.substr(F.col("q"), i + 1).alias("cand")))
    exact = s.select("id", "symbol_key", "key", F.explode(F.concat(F.array(F.struct(F.lit(100).alias("score"), F.col("q").alias("cand")), F.struct(F.lit(95).alias("score"), F.col("n").alias("cand"))), F.coalesce(tails, F.array()))).alias("o")).select("id", "symbol_key", "key", "o.score", "o.cand")
    begun = pattern_matches(s.select(F.col("q").alias("name")).unionByName(s.select(F.col("n").alias("name"))), cands.select(F.concat("cand", F.lit("*")).alias("pattern"))).select(F.col("name").alias("full"), F.regexp_replace("pattern", r"\*$", "").alias("cand"))
    starts = lambda c, score: begun.join(s, F.col("full") == F.col(c)).select("id", "symbol_key", "key", F.lit(score).alias("score"), "cand")
    ways = exact.join(cands, "cand", "left_semi").select("id", "symbol_key", "key", "score", "cand").unionByName(starts("q", 70)).unionByName(starts("n", 65))
    best = first_by(ways, ["cand"], [F.desc("score"), "symbol_key"]).select("cand", "id", "key", "score")
    labels = p.select("run_key", F.explode(F.array_distinct(F.split(F.lower("prompt"), "[^a-z0-9-]+"))).alias("label"))
    heavy = top_by(W.weights(spark, sf), ["label"], [F.desc(F.round("weight", 6)), "id"], 5).select("label", F.col("id").alias("name"), F.floor(90 + F.col("weight") * 10 + 0.5).cast("int").alias("score"))
    named = W.sym(spark, sf).groupBy("name").agg(F.min_by("id", "symbol_key").alias("id"), F.min_by(F.coalesce("qualified_name", "name"), "symbol_key").alias("key"))
    hits = said.join(best, "cand").select("run_key", "id", "key", "score").unionByName(labels.join(heavy, "label").join(named, "name").select("run_key", "id", "key", "score"))
    each = first_by(hits, ["run_key", "key"], [F.desc("score"), "id"])
    return top_by(each, ["run_key"], [F.desc("score"), "id"], 5, "position").select("run_key", "id", "score", "position")


def x15_reusable(spark: SparkSession, sf: str) -> DataFrame:
    """The ten symbols to reuse for each query, by name alone, with a score from 0 to 1."""
    s = _searched(spark, sf).withColumn("score", F.round(_name_tier(F.col("q"), F.col("n"), F.col("qn")) / 100, 2)).where("score IS NOT NULL")
    return top_by(s, ["query"], [F.desc("score"), F.length("name"), "id"], 10, "position").select("query", "id", "score", "position")


def x17_intent(spark: SparkSession, sf: str) -> DataFrame:
    """Bench prompts by intent."""
    return table(spark, sf, "bench_runs", "prompt").select(C.intent_of(F.col("prompt")).alias("intent")).groupBy("intent").agg(F.count(F.lit(1)).alias("prompts"))


def x17_sections(spark: SparkSession, sf: str) -> DataFrame:
    """Prompts for which each section of a brief is kept, by intent (P8: intent exclusion)."""
    kinds = table(spark, sf, "bench_runs", "prompt").select(C.intent_of(F.col("prompt")).alias("intent")).groupBy("intent").agg(F.count(F.lit(1)).alias("prompts"))
    return kinds.select("intent", F.explode(C.sections_of(F.col("intent"))).alias("section"), "prompts")


def x18_corrections(spark: SparkSession, sf: str) -> DataFrame:
    """Notes by what they correct, with the number of signals and the severity: high for generated files and packages, else medium."""
    c = W.note(spark, sf).select(C.corrections(F.col("lesson")).alias("kinds"))
    severe = F.arrays_overlap("kinds", F.array(*map(F.lit, C.SEVERE)))
    return c.select(F.coalesce(F.get("kinds", F.lit(0)), F.lit("general")).alias("kind"), F.size("kinds").alias("signals"), F.when(severe, "high").otherwise("medium").alias("severity")).groupBy("kind", "signals", "severity").agg(F.count(F.lit(1)).alias("notes"))


def _user_lines(spark: SparkSession, sf: str) -> DataFrame:
    d = W.docs(spark, sf).where("text IS NOT NULL").select("doc_id", F.explode(F.split(F.col("text"), "\n")).alias("line")).where(F.col("line").startswith("user: "))
    return d.select("doc_id", F.expr("substring(line, 7)").alias("turn"))


def _clauses(df: DataFrame, text: str) -> DataFrame:
    """Clauses of `text`: parted at line ends, after closing marks and at long dashes."""
    parts = F.split(F.regexp_replace(F.regexp_replace(F.col(text), r"([.;!?])\s+", "$1\n"), r"\s+—\s+", "\n"), r"\n+")
    return df.select(*(c for c in df.columns if c != text), F.explode(parts).alias("clause")).withColumn("clause", F.trim("clause"))


def x19_preferences(spark: SparkSession, sf: str) -> DataFrame:
    """Clauses of user turns in transcripts that state a lasting rule, without the cue that shows it, and the documents that have it."""
    rules = _clauses(_user_lines(spark, sf), "turn").select("doc_id", C.preference(F.col("clause")).alias("rule")).where("rule IS NOT NULL")
    return rules.groupBy("rule").agg(F.count_distinct("doc_id").alias("documents"))


def x20_directives(spark: SparkSession, sf: str) -> DataFrame:
    """Sentences of user turns and lessons that instruct for a place, by polarity; and all pending directives by stored and read polarity."""
    turns = _user_lines(spark, sf).select(F.lit("turn").alias("origin"), F.col("turn").alias("text"))
    lessons = W.note(spark, sf).where("lesson IS NOT NULL").select(F.lit("lesson").alias("origin"), F.col("lesson").alias("text"))
    told = _clauses(turns.unionByName(lessons), "text").where(C.directive(F.col("clause"))).select("origin", F.lit(None).cast("string").alias("stored"), C.polarity(F.col("clause")).alias("read"))
    held = W.inb(spark, sf).where("kind = 'directive' AND text IS NOT NULL").select(F.lit("inbox").alias("origin"), F.col("polarity").alias("stored"), C.polarity(F.col("text")).alias("read"))
    return told.unionByName(held).groupBy("origin", "stored", "read").agg(F.count(F.lit(1)).alias("items"))


def x21_test_corrections(spark: SparkSession, sf: str) -> DataFrame:
    """User turns that ask for tests or coverage that is missing, with the evidence in one line of up to 180 characters."""
    turns = _user_lines(spark, sf).where(C.has(F.col("turn"), C.TEST_CORRECTION))
    return turns.select("doc_id", F.substring(F.regexp_replace(F.trim("turn"), r"\s+", " "), 1, 180).alias("evidence")).distinct()


def x27_target_kind(spark: SparkSession, sf: str) -> DataFrame:
    """What symbols, files, commits and evidence of notes name: a diff, pull request, commit, file or symbol."""
    n = W.note(spark, sf)
    refs = [n.select(F.lit(c).alias("field"), F.regexp_replace(F.coalesce(c, F.lit("")), "^(?:PR #|commit )", "").alias("ref")) for c in ("symbol", "source_commit", "evidence")]
    refs.append(W.stale(spark, sf).select(F.lit("file").alias("field"), F.coalesce("file", F.lit("")).alias("ref")))
    out = refs[0]
    for r in refs[1:]:
        out = out.unionByName(r)
    return out.groupBy("field", C.target_kind(F.col("ref")).alias("kind")).agg(F.count(F.lit(1)).alias("refs"))


def x22_risk_topics(spark: SparkSession, sf: str) -> DataFrame:
    """Inbox items per risk topic of their text."""
    return W.inb(spark, sf).select(F.explode(C.risk_topics(F.col("text"))).alias("topic")).groupBy("topic").agg(F.count(F.lit(1)).alias("items"))


def x23_redaction(spark: SparkSession, sf: str) -> DataFrame:
    """Texts with secrets that earlier redaction left, and their number."""
    text, hits = C.redacted(F.col("text"))
    return table(spark, sf, "redact_results", "result_key", "text").where("text IS NOT NULL").select("result_key", text.alias("redacted"), hits.cast("bigint").alias("found"))


def x24_commit_mining(spark: SparkSession, sf: str) -> DataFrame:
    """Proposals from commit subjects: mends become notes (0.4, with an area 0.5), decisions become decisions (0.5, 0.6); by kind, area and confidence (also k13)."""
    c = W.commits(spark, sf).select("sha", F.col("subject").alias("s"), F.nullif(F.regexp_extract("subject", C.java("(?i)" + C.CONVENTIONAL), 1), F.lit("")).alias("area")).distinct()
    fix, decision = C.has(F.col("s"), C.FIX), C.has(F.col("s"), C.DECISION)
    c = c.withColumns({"kind": F.when(fix, "note").when(decision, "decision"), "confidence": F.when(fix, F.when(F.col("area").isNotNull(), 0.5).otherwise(0.4)).otherwise(F.when(F.col("area").isNotNull(), 0.6).otherwise(0.5))})
    return c.where("kind IS NOT NULL").groupBy("kind", "area", "confidence").agg(F.count_distinct("sha").alias("commits"))


def x25_failed_tests(spark: SparkSession, sf: str) -> DataFrame:
    """Runs in which each test failed, read back from the output as each runner prints it: pytest nodes, crosses or FAIL lines."""
    r = W.runs(spark, sf).where(F.size("failed_tests") > 0).select("seq", "source", F.array_distinct("failed_tests").alias("t"))
    name = F.when(F.col("source") == "pytest", F.array_join(F.transform("t", lambda n: F.concat(F.lit("FAILED tests/t.py::"), F.replace(n, F.lit(" "), F.lit("_")), F.lit(" - AssertionError"))), "\n"))
    name = name.when(F.col("source").isin("jest", "mocha"), F.array_join(F.transform("t", lambda n: F.concat(F.lit("  ✕ "), n)), "\n")).otherwise(F.array_join(F.transform("t", lambda n: F.concat(F.lit(" FAIL  src/t.test.ts > "), n)), "\n"))
    return r.select("source", F.explode(C.failed_tests(F.concat(F.lit("run\n"), name, F.lit("\ndone")))).alias("test")).groupBy("source", "test").agg(F.count(F.lit(1)).alias("runs"))


def x25_stated_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Failed and passed numbers that test output states."""
    rx = "([0-9]+) failed, ([0-9]+) passed"
    return W.runs(spark, sf).where(F.col("message").rlike(rx)).select("seq", F.regexp_extract("message", rx, 1).cast("int").alias("failed"), F.regexp_extract("message", rx, 2).cast("int").alias("passed"))


def x26_pr_numbers(spark: SparkSession, sf: str) -> DataFrame:
    """Pull requests that evidence names, with the notes that do (also k21)."""
    rx = r"(?:PR |\()#([0-9]+)"
    return W.note(spark, sf).where(F.col("evidence").rlike(rx)).select(F.regexp_extract("evidence", rx, 1).cast("int").alias("pr")).groupBy("pr").agg(F.count(F.lit(1)).alias("notes"))


def _terms(q: str) -> str:
    return f"list_filter({X.sql_split_identifier(q)}, lambda t: length(t) > 2 AND NOT list_contains({X.sql_list(X.CODE_STOP)}, t))"


def _asked_sql(queries: list[str]) -> str:
    rows = ", ".join(f"('{q}')" for q in queries)
    return f", a AS (SELECT query, lower(trim(query)) AS q, {_terms('query')} AS terms FROM (VALUES {rows}) v(query))"


_TIER = "CASE WHEN lower(qualified_name) = q THEN 100 WHEN lower(name) = q THEN 95 WHEN starts_with(lower(qualified_name), q) THEN 85 WHEN starts_with(lower(name), q) THEN 80 WHEN contains(lower(qualified_name), q) THEN 65 WHEN contains(lower(name), q) THEN 60 END"
_PRESENT = "len(list_filter(terms, lambda t: list_contains(tk, t)))"
_TOP = "row_number() OVER (PARTITION BY query ORDER BY score DESC, length(name), file NULLS FIRST, id)"
_DEDUP = "QUALIFY row_number() OVER (PARTITION BY query, name, kind, file ORDER BY score DESC, length(name), file NULLS FIRST, id) = 1"
_PEN = f"CASE WHEN regexp_matches(file, '{_TEST_PATH}') THEN 12 ELSE 0 END"

QUERIES = {f.__name__: f for f in (x1_identifier_parts, x2_code_tokens, x4_search, x5_bm25, x6_recall, x8_jaccard, x9_rejected, x10_star_clusters, x11_folding, x13_symbol_inference, x15_reusable, x17_intent, x17_sections, x18_corrections, x19_preferences, x20_directives, x21_test_corrections, x22_risk_topics, x23_redaction, x24_commit_mining, x25_failed_tests, x25_stated_counts, x26_pr_numbers, x27_target_kind)}
_TOKENS = f"list_filter(flatten(list_transform(regexp_extract_all(substr(coalesce(text, ''), 1, 4000), '[A-Za-z][A-Za-z0-9_$]*'), lambda w: {X.sql_split_identifier('w')})), lambda t: length(t) > 2 AND NOT list_contains({X.sql_list(X.CODE_STOP)}, t))"
_TURNS = "WITH turns AS (SELECT doc_id, substr(line, 7) AS turn FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents WHERE text IS NOT NULL) WHERE starts_with(line, 'user: '))"
_CLAUSES = "string_split_regex(regexp_replace(regexp_replace({t}, '([.;!?])\\s+', '\\1' || chr(10), 'g'), '\\s+—\\s+', chr(10), 'g'), '\\n+')"
# first occurrences only, in order
_DISTINCT = f"list_filter({{t}}, lambda x, i: list_position({{t}}, x) = i)[1:200]"
SQL = {
    "x1_identifier_parts": f"SELECT symbol_key, array_to_string({X.sql_split_identifier('name')}, ' ') AS parts FROM symbols",
    "x2_code_tokens": f"SELECT doc_id, array_to_string({_DISTINCT.format(t='t')}, ' ') AS tokens FROM (SELECT doc_id, {_TOKENS} AS t FROM documents)",
    "x4_search": W.sql(_asked_sql(ASKED) + f"""
, s AS (SELECT query, id, name, file, kind, coalesce({_TIER}, CASE WHEN list_contains(tk, q) THEN 50 WHEN len(terms) > 0 AND {_PRESENT} = len(terms) THEN 48 WHEN {_PRESENT} > 0 THEN 30 + floor(18.0 * {_PRESENT} / len(terms) + 0.5)::INT WHEN len(list_filter(tk, lambda t: contains(t, q))) > 0 THEN 35 END) - {_PEN} AS score FROM (SELECT *, coalesce(tokens, []) AS tk FROM sym), a),
d AS (SELECT * FROM s WHERE score IS NOT NULL {_DEDUP})
SELECT query, id, score, position FROM (SELECT *, {_TOP} AS position FROM d) WHERE position <= 20"""),
    "x5_bm25": W.sql(_asked_sql(ASKED) + f"""
, d AS (SELECT id, name, qualified_name, file, kind, list_distinct(list_concat({X.sql_split_identifier('name')}, coalesce({X.sql_split_identifier('qualified_name')}, []), coalesce(tokens, []))) AS doc FROM sym),
st AS (SELECT count(*) AS n, avg(len(doc)) AS avgdl FROM d), terms AS (SELECT query, unnest(CASE WHEN len(terms) > 0 THEN terms ELSE [q] END) AS term FROM a),
post AS (SELECT query, id, greatest(len(doc), 1) AS dl, term FROM (SELECT id, doc, unnest(doc) AS term FROM d) JOIN terms USING (term)),
df AS (SELECT term, count(DISTINCT id) AS df FROM post GROUP BY term),
bm AS (SELECT query, id, sum(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * 2.5::DOUBLE / (1 + 1.5::DOUBLE * (1 - 0.75::DOUBLE + 0.75::DOUBLE * dl / avgdl))) AS bm FROM post JOIN df USING (term), st GROUP BY query, id),
tier AS (SELECT query, id, {_TIER} AS tier FROM d, a),
s AS (SELECT t.query, t.id, d.name, d.file, d.kind, round(coalesce(tier, 0) + coalesce(bm, 0) - {_PEN}, 5) AS score FROM tier t LEFT JOIN bm ON bm.query = t.query AND bm.id = t.id JOIN d ON d.id = t.id WHERE tier IS NOT NULL OR bm IS NOT NULL),
e AS (SELECT * FROM s {_DEDUP})
SELECT query, id, score, position FROM (SELECT *, {_TOP} AS position FROM e) WHERE position <= 20"""),
    "x6_recall": W.sql(_asked_sql(RECALLED).replace(X.sql_split_identifier("query"), "string_split(lower(query), ' ')") + f"""
, m AS (SELECT 'note' AS kind, note_key AS key, lesson AS text, CASE severity WHEN 'high' THEN 8 WHEN 'low' THEN -2 ELSE 0 END AS nudge FROM note WHERE lesson IS NOT NULL UNION ALL SELECT 'issue', issue_key, summary, CASE severity WHEN 'block' THEN 10 WHEN 'warn' THEN 4 ELSE 0 END FROM iss WHERE summary IS NOT NULL),
t AS (SELECT kind, key, text, nudge, {_DISTINCT.format(t='raw')} AS tk FROM (SELECT *, {_TOKENS} AS raw FROM m)),
s AS (SELECT query, kind, key, text, nudge, greatest(CASE WHEN contains(lower(text), q) THEN 90 ELSE 0 END, CASE WHEN len(terms) = 0 THEN 0 WHEN {_PRESENT} = len(terms) THEN 70 WHEN {_PRESENT} > 0 THEN 30 + floor(38.0 * {_PRESENT} / len(terms) + 0.5)::INT WHEN len(list_filter(tk, lambda x: len(list_filter(terms, lambda y: contains(x, y))) > 0)) > 0 THEN 28 ELSE 0 END) AS base FROM t, a)
SELECT query, kind, key, score, position FROM (SELECT *, base + nudge AS score, row_number() OVER (PARTITION BY query ORDER BY base + nudge DESC, length(text), kind, key) AS position FROM s WHERE base > 0) WHERE position <= 20"""),
    "x8_jaccard": W.sql(f"SELECT note_key, similarity FROM (SELECT note_key, round({X.sql_jaccard('a', 'b')}, 6) AS similarity FROM (SELECT note_key, {X.sql_lexical('lesson')} AS a, {X.sql_lexical('evidence')} AS b FROM note)) WHERE similarity > 0"),
    "x9_rejected": W.sql(f"""
, p AS (SELECT issue_key, symbol, {X.sql_lexical('summary', X.REJECTED_STOP, 3)} AS p FROM iss WHERE kind = 'open_todo' AND symbol IS NOT NULL), d AS (SELECT note_key, symbol, {X.sql_lexical('lesson', X.REJECTED_STOP, 3)} AS d FROM note WHERE promoted AND symbol IS NOT NULL)
SELECT * FROM (SELECT issue_key, note_key, floor(sim * 100 + 0.5) / 100 AS similarity, row_number() OVER (PARTITION BY issue_key ORDER BY floor(sim * 100 + 0.5) / 100 DESC, note_key) AS position FROM (SELECT issue_key, note_key, {X.sql_jaccard('p', 'd')} AS sim FROM p JOIN d USING (symbol)) WHERE sim >= 0.25) WHERE position <= 5"""),
    "x13_symbol_inference": W.sql(f"""
, c AS (SELECT run_key, unnest(list_concat(list_concat(flatten(list_transform({C.sql_found('prompt', C.BACKTICKED, 1)}, lambda x: string_split_regex(x, '[^A-Za-z0-9_.]+'))), list_concat({C.sql_found('prompt', C.CANDIDATES[0], 1)}, list_concat({C.sql_found('prompt', C.CANDIDATES[1], 1)}, {C.sql_found('prompt', C.CANDIDATES[2], 1)}))),
 list_concat(list_filter({C.sql_found('prompt', C.SNAKE, 1)}, lambda w: contains(w, '_')), list_filter({C.sql_found('prompt', C.LONG_WORD, 1)}, lambda w: NOT list_contains({X.sql_list(C.FILLERS)}, w))))) AS w FROM bench_runs),
d AS (SELECT DISTINCT run_key, lower(w) AS cand FROM c WHERE length(w) >= 4 AND NOT list_contains({X.sql_list(C.NO_CANDIDATES)}, w)), u AS (SELECT DISTINCT cand FROM d),
b AS (SELECT cand, id, coalesce(qualified_name, name) AS key, CASE WHEN lower(qualified_name) = cand THEN 100 WHEN lower(name) = cand THEN 95 WHEN suffix(lower(qualified_name), '.' || cand) THEN 85 WHEN starts_with(lower(qualified_name), cand) THEN 70 ELSE 65 END AS score
 FROM u JOIN sym ON starts_with(lower(qualified_name), cand) OR starts_with(lower(name), cand) OR suffix(lower(qualified_name), '.' || cand) QUALIFY row_number() OVER (PARTITION BY cand ORDER BY score DESC, symbol_key) = 1),
h AS (SELECT label, id AS name, floor(90 + weight * 10 + 0.5)::INT AS score FROM weights QUALIFY row_number() OVER (PARTITION BY label ORDER BY round(weight, 6) DESC, id) <= 5), n AS (SELECT name, arg_min(id, symbol_key) AS id, arg_min(coalesce(qualified_name, name), symbol_key) AS key FROM sym GROUP BY name),
a AS (SELECT run_key, id, key, score FROM d JOIN b USING (cand) UNION ALL SELECT run_key, n.id, n.key, score FROM (SELECT run_key, unnest(list_distinct(string_split_regex(lower(prompt), '[^a-z0-9-]+'))) AS label FROM bench_runs) JOIN h USING (label) JOIN n USING (name)),
e AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY run_key, key ORDER BY score DESC, id) = 1)
SELECT run_key, id, score, position FROM (SELECT *, row_number() OVER (PARTITION BY run_key ORDER BY score DESC, id) AS position FROM e) WHERE position <= 5"""),
    "x15_reusable": W.sql(_asked_sql(ASKED) + f" SELECT query, id, score, position FROM (SELECT query, id, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, length(name), id) AS position FROM (SELECT query, id, name, round({_TIER} / 100.0::DOUBLE, 2) AS score FROM sym, a) WHERE score IS NOT NULL) WHERE position <= 10"),
    "x17_intent": f"SELECT {C.sql_intent('prompt')} AS intent, count(*) AS prompts FROM bench_runs GROUP BY 1",
    "x17_sections": f"""
SELECT intent, section, prompts FROM (SELECT {C.sql_intent('prompt')} AS intent, count(*) AS prompts FROM bench_runs GROUP BY 1), (SELECT unnest({X.sql_list(C.SECTIONS)}) AS section)
WHERE NOT ({" OR ".join(f"intent = '{k}' AND section IN ({', '.join(map(repr, v))})" for k, v in C.LEFT_OUT.items())})""",
    "x18_corrections": W.sql(f"SELECT coalesce(k[1], 'general') AS kind, len(k)::INT AS signals, CASE WHEN list_has_any(k, {X.sql_list(list(C.SEVERE))}) THEN 'high' ELSE 'medium' END AS severity, count(*) AS notes FROM (SELECT {C.sql_corrections("coalesce(lesson, '')")} AS k FROM note) GROUP BY 1, 2, 3"),
    "x19_preferences": _TURNS + f"""
, c AS (SELECT doc_id, trim(unnest({_CLAUSES.format(t='turn')})) AS clause FROM turns),
k AS (SELECT doc_id, trim(regexp_replace(trim(regexp_replace({C.sql_cue('clause')}, '^[,:\\s]+', '')), '[.!?]+$', '')) AS rule FROM c WHERE length(clause) BETWEEN 1 AND 239 AND NOT {C.sql_has('clause', *C.TRANSIENT)} AND NOT suffix(clause, '?'))
SELECT rule, count(DISTINCT doc_id) AS documents FROM k WHERE len(list_filter(string_split_regex(rule, '\\s+'), lambda w: length(w) > 2)) >= 3 AND length(rule) <= 200 GROUP BY rule""",
    "x20_directives": W.sql(_TURNS.replace("WITH turns", ", turns") + f"""
, c AS (SELECT origin, trim(unnest({_CLAUSES.format(t='text')})) AS clause FROM (SELECT 'turn' AS origin, turn AS text FROM turns UNION ALL SELECT 'lesson', lesson FROM note WHERE lesson IS NOT NULL)),
d AS (SELECT origin, NULL::VARCHAR AS stored, clause AS t FROM c WHERE length(clause) BETWEEN 1 AND 280 AND NOT {C.sql_has('clause', *C.DIRECTIVE_TRANSIENT)} AND {C.sql_has('clause', C.POSITIONAL)} AND {C.sql_has('clause', C.POLICY)} UNION ALL SELECT 'inbox', polarity, text FROM inb WHERE kind = 'directive' AND text IS NOT NULL)
SELECT origin, stored, CASE WHEN {C.sql_has('t', C.NEGATIVE)} THEN 'dont' ELSE 'do' END AS read, count(*) AS items FROM d GROUP BY 1, 2, 3"""),
    "x21_test_corrections": _TURNS + f" SELECT DISTINCT doc_id, substr(regexp_replace(trim(turn), '\\s+', ' ', 'g'), 1, 180) AS evidence FROM turns WHERE {C.sql_has('turn', C.TEST_CORRECTION)}",
    "x27_target_kind": W.sql("""
, r AS (SELECT 'symbol' AS field, symbol AS ref FROM note UNION ALL SELECT 'source_commit', source_commit FROM note UNION ALL SELECT 'evidence', evidence FROM note UNION ALL SELECT 'file', file FROM stale_entries),
v AS (SELECT field, trim(regexp_replace(coalesce(ref, ''), '^(?:PR #|commit )', '')) AS v FROM r)
SELECT field, CASE WHEN v = '' THEN 'diff' WHEN regexp_matches(v, '^\\d+$') THEN 'pr' WHEN regexp_matches(v, '^HEAD\\b') OR regexp_matches(v, '[~^]') OR contains(v, '..') OR regexp_matches(v, '(?i)^[0-9a-f]{7,40}$') THEN 'commit' WHEN contains(v, '/') OR regexp_matches(v, '(?i)\\.[a-z0-9]+$') THEN 'file' ELSE 'symbol' END AS kind, count(*) AS refs FROM v GROUP BY 1, 2"""),
    "x22_risk_topics": W.sql(f"SELECT topic, count(*) AS items FROM (SELECT unnest({C.sql_topics('text')}) AS topic FROM inb) GROUP BY topic"),
    "x23_redaction": C.sql_redacted("redact_results", "result_key", "text"),
    "x24_commit_mining": W.sql(f"""
, c AS (SELECT DISTINCT sha, subject AS s, nullif(regexp_extract(subject, '(?i){C.CONVENTIONAL}', 1), '') AS area FROM commits),
k AS (SELECT sha, area, CASE WHEN {C.sql_has('s', C.FIX)} THEN 'note' WHEN {C.sql_has('s', C.DECISION)} THEN 'decision' END AS kind FROM c)
SELECT kind, area, CASE kind WHEN 'note' THEN 0.4::DOUBLE ELSE 0.5::DOUBLE END + CASE WHEN area IS NULL THEN 0 ELSE 0.1::DOUBLE END AS confidence, count(DISTINCT sha) AS commits FROM k WHERE kind IS NOT NULL GROUP BY ALL"""),
    "x25_failed_tests": W.sql("""
SELECT source, CASE WHEN source = 'pytest' THEN 'tests/t.py::' || replace(t, ' ', '_') WHEN source IN ('jest', 'mocha') THEN t ELSE 'src/t.test.ts > ' || t END AS test, count(*) AS runs FROM (SELECT source, unnest(list_distinct(failed_tests)) AS t FROM runs) GROUP BY 1, 2"""),
    "x25_stated_counts": W.sql("SELECT seq, regexp_extract(message, '([0-9]+) failed, ([0-9]+) passed', 1)::INT AS failed, regexp_extract(message, '([0-9]+) failed, ([0-9]+) passed', 2)::INT AS passed FROM runs WHERE regexp_matches(message, '([0-9]+) failed, ([0-9]+) passed')"),
    "x26_pr_numbers": W.sql(r"SELECT regexp_extract(evidence, '(?:PR |\()#([0-9]+)', 1)::INT AS pr, count(*) AS notes FROM note WHERE regexp_matches(evidence, '(?:PR |\()#([0-9]+)') GROUP BY 1"),
}
