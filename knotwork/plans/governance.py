"""Knowledge governance queries: pruning, records, audits, health, reviews and the compositions over them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import classify as C
from ..functions import text as X
from ..operators.patterns import pattern_matches
from ..operators.ranking import first_by, severity_rank, top_by
from ..sources.tables import table
from . import aggregates, lifecycle, streams
from . import warehouse as W

AS_OF = "2026-07-01"


def _age(c: str):
    """Whole days from `c` to AS_OF."""
    return F.floor((F.unix_micros(F.lit(AS_OF).cast("timestamp")) - F.unix_micros(F.col(c).cast("timestamp"))) / 86_400_000_000).cast("int")


def k6_prune(spark: SparkSession, sf: str, days: int = 90, least_confidence: float = 0.8) -> DataFrame:
    """Notes that may be pruned, with the reason: not from people, documents, incidents or pull requests, not promoted, not of high severity,
    not confident; and expired, or recorded `days` ago and never surfaced or not for as long. A note without a time of record stays."""
    n = W.note(spark, sf).where("coalesce(source, '') NOT IN ('human', 'doc', 'incident', 'pr') AND NOT coalesce(promoted, false) AND coalesce(severity, '') <> 'high'")
    n = n.where(F.coalesce("confidence", "classifier.confidence", F.lit(0.0)) < least_confidence).withColumns({"recorded": _age("recorded_at"), "surfaced": _age("last_surfaced_at")})
    expired = F.coalesce(F.try_to_timestamp("expires_at") < F.lit(AS_OF).cast("timestamp"), F.lit(False))
    old = F.col("recorded") >= days
    reason = F.when(expired, "expired").when(old & F.col("surfaced").isNull(), "never surfaced").when(old & (F.col("surfaced") >= days), "not surfaced lately")
    return n.select("note_key", reason.alias("reason")).where("reason IS NOT NULL")


def k17_record(spark: SparkSession, sf: str) -> DataFrame:
    """What recording every captured preference leaves: one record for each text (an id of its hash), the first text, and the hits of the others."""
    i = W.inb(spark, sf).where("kind = 'preference' AND text IS NOT NULL").select(F.substring(F.sha1(F.lower(F.trim("text"))), 1, 12).alias("id"), "item_key")
    return i.groupBy("id").agg(F.min("item_key").alias("item_key"), (F.count(F.lit(1)) - 1).alias("hits"))


def k18_status(spark: SparkSession, sf: str) -> DataFrame:
    """Moves of inbox items between states, each delivery being a status event: the first and last state of each id, and the open ones that stay open."""
    i = table(spark, sf, "inbox", "id", "item_key", "status").where("id IS NOT NULL")
    moved = i.groupBy("id").agg(F.min_by("status", "item_key").alias("was"), F.max_by("status", "item_key").alias("is"), F.count(F.lit(1)).alias("events"))
    return moved.groupBy("was", "is").agg(F.count(F.lit(1)).alias("items"), F.sum("events").alias("events"))


def k23_why(spark: SparkSession, sf: str) -> DataFrame:
    """Why a symbol is as it is, for every symbol that issues name by id: last commit of its file, newest decision, open questions, notes, and its heaviest feature."""
    s = W.sym(spark, sf).select("id", "name", "file").join(W.iss(spark, sf).select(F.col("symbol").alias("id")).distinct(), "id", "left_semi")
    commit = W.file_commits(spark, sf).groupBy("file").agg(F.max_by("commit", F.struct("at", "commit")).alias("last_commit"))
    n = W.note(spark, sf).where("symbol IS NOT NULL")
    decision = first_by(n.where("promoted"), ["symbol"], [F.col("recorded_at").desc_nulls_last(), "note_key"]).select(F.col("symbol").alias("name"), F.col("note_key").alias("decision"))
    notes = n.where("NOT coalesce(promoted, false)").groupBy(F.col("symbol").alias("name")).agg(F.count(F.lit(1)).alias("notes"))
    open_ = W.iss(spark, sf).where("kind = 'open_question'").groupBy(F.col("symbol").alias("id")).agg(F.count(F.lit(1)).alias("questions"))
    feature = first_by(W.weights(spark, sf).withColumn("weight", F.round("weight", 6)), ["id"], [F.desc("weight"), "label"]).select(F.col("id").alias("name"), F.col("label").alias("feature"))
    out = s.join(commit, "file", "left").join(decision, "name", "left").join(notes, "name", "left").join(open_, "id", "left").join(feature, "name", "left")
    return out.select("id", "last_commit", "decision", F.coalesce("notes", F.lit(0)).alias("notes"), F.coalesce("questions", F.lit(0)).alias("questions"), "feature")


def k23_prime(spark: SparkSession, sf: str) -> DataFrame:
    """A primer in order: standing preferences, gating rules (block first), the five newest decisions, global lessons; up to twenty items of each."""
    p = first_by(W.inb(spark, sf).where("kind = 'preference' AND status = 'approved' AND text IS NOT NULL"), ["text"], ["item_key"]).select(F.lit(1).alias("section"), F.lit(0).alias("o"), F.lpad(F.col("item_key").cast("string"), 12, "0").alias("key"))
    r = W.rules(spark, sf).where("severity IN ('block', 'warn')").select(F.lit(2).alias("section"), F.when(F.col("severity") == "block", 0).otherwise(1).alias("o"), F.col("name").alias("key"))
    n = W.note(spark, sf)
    d = n.where("promoted AND symbol IS NOT NULL AND recorded_at IS NOT NULL").orderBy(F.desc("recorded_at"), "note_key").limit(5).select(F.lit(3).alias("section"), F.lit(0).alias("o"), F.lpad(F.col("note_key").cast("string"), 12, "0").alias("key"))
    g = n.where("scope = 'global' AND lesson IS NOT NULL").select(F.lit(4).alias("section"), F.lit(0).alias("o"), F.lpad(F.col("note_key").cast("string"), 12, "0").alias("key"))
    return top_by(p.unionByName(r).unionByName(d).unionByName(g), ["section"], ["o", "key"], 20, "position").select("section", "key", "position")


def k30_post_edit_audit(spark: SparkSession, sf: str) -> DataFrame:
    """The audit after an edit: sessions that fail a check, hard searches, repeated mistakes, learned commands and suggestions, as one result."""
    audit = streams.r9_session_audit(spark, sf)
    parts = {
        "failed_audits": audit.where("NOT passed"), "hard_searches": streams.r8_hard_searches(spark, sf), "repeated_mistakes": aggregates.a7_repeated_mistakes(spark, sf),
        "learned_commands": aggregates.a6_learned_commands(spark, sf), "suggestions": lifecycle.k10_suggestions(spark, sf),
    }
    out = None
    for name, df in parts.items():
        one = df.agg(F.count(F.lit(1)).alias("items")).select(F.lit(name).alias("section"), "items")
        out = one if out is None else out.unionByName(one)
    return out


def r11_maintenance(spark: SparkSession, sf: str, days: int = 7) -> DataFrame:
    """Sources whose maintenance is due: the last run is `days` or more before the date, or there was none."""
    every = table(spark, sf, "stale_entries", "source").unionByName(table(spark, sf, "test_runs", "source")).dropna().distinct()
    last = W.runs(spark, sf).where("exit = 0").groupBy("source").agg(F.max("at").alias("last_run"))
    m = every.join(last, "source", "left").withColumn("age", _age("last_run"))
    return m.select("source", "last_run", (F.col("age").isNull() | (F.col("age") >= days)).alias("due"))


def a11_feature_health(spark: SparkSession, sf: str) -> DataFrame:
    """Health of each feature: 0.25 of coverage by rules (four are enough) and 0.15 each of fresh notes (180 days), young questions (30 days), verified assumptions, absence of conflicts (exp(-n/3)) and decisions (six)."""
    w = W.weights(spark, sf).select("label", F.col("id").alias("symbol"))
    n = W.note(spark, sf).where("symbol IS NOT NULL").select("symbol", F.coalesce("promoted", F.lit(False)).alias("promoted"), (F.coalesce(_age("recorded_at"), F.lit(0)) > 180).alias("old"))
    notes = w.join(n, "symbol").groupBy("label").agg(F.sum((~F.col("promoted")).cast("bigint")).alias("notes"), F.sum((~F.col("promoted") & F.col("old")).cast("bigint")).alias("old_notes"), F.sum(F.col("promoted").cast("bigint")).alias("decisions"))
    i = W.iss(spark, sf).where("symbol IS NOT NULL").select("symbol", "kind", "severity", (F.coalesce(_age("raised_at"), F.lit(0)) > 30).alias("old"))
    one = lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("bigint"))
    q, u = F.col("kind") == "open_question", F.col("kind") == "unverified_assumption"
    issues = w.join(i, "symbol").groupBy("label").agg(one(q).alias("questions"), one(q & F.col("old")).alias("old_questions"), one(u).alias("assumptions"), one(u & (F.col("severity") != "info")).alias("unverified"), one(F.col("kind") == "conflict").alias("conflicts"))
    r = W.rules(spark, sf).select("name", F.explode("applies_to").alias("pattern"))
    hit = pattern_matches(w.select(F.col("symbol").alias("name")), r.select("pattern")).select(F.col("name").alias("symbol"), "pattern")
    rules = w.join(hit, "symbol").join(r, "pattern").groupBy("label").agg(F.count_distinct("name").alias("rules"))
    m = w.select("label").distinct().join(notes, "label", "left").join(issues, "label", "left").join(rules, "label", "left").fillna(0)
    part = lambda bad, all_: F.when(F.col(all_) > 0, 1 - F.col(bad) / F.col(all_)).otherwise(1.0)
    score = 0.25 * F.least(F.lit(1.0), F.col("rules") / 4) + 0.15 * (part("old_notes", "notes") + part("old_questions", "questions") + part("unverified", "assumptions") + F.exp(-F.col("conflicts") / 3) + F.least(F.lit(1.0), F.col("decisions") / 6))
    return m.select("label", "rules", "notes", "old_notes", "questions", "old_questions", "assumptions", "unverified", "conflicts", "decisions", F.round(score, 6).alias("health"))


def x12_merge_clusters(spark: SparkSession, sf: str) -> DataFrame:
    """Pending inbox items that say the same: equal texts of a kind (and, for directives, an area) apart from case and blanks, the first of them and how many follow. Similar texts are in j22."""
    i = W.inb(spark, sf).where("status = 'pending' AND text IS NOT NULL").select("item_key", "kind", F.when(F.col("kind") == "directive", F.col("area")).alias("area"), F.array_sort(X.lexical_tokens(F.col("text"))).alias("t"))
    g = i.where(F.size("t") > 0).groupBy("kind", "area", "t").agg(F.min("item_key").alias("canonical"), (F.count(F.lit(1)) - 1).alias("duplicates"))
    return g.where("duplicates > 0").select("kind", "area", "canonical", "duplicates")


def k12_scope_hints(spark: SparkSession, sf: str) -> DataFrame:
    """Pending items that may belong elsewhere: preferences with words of place, directives without an area, and directives with lasting words but none of place."""
    i = W.inb(spark, sf).where("status = 'pending' AND text IS NOT NULL")
    here, lasting = C.has(F.col("text"), C.LOCATION_CUE), C.has(F.col("text"), C.DURABLE_CUE)
    preference, directive = F.col("kind") == "preference", F.col("kind") == "directive"
    hint = F.when(preference & here, "location-scoped").when(directive & (F.coalesce("area", F.lit("")) == ""), "no area").when(directive & lasting & ~here, "repo-wide")
    return i.select("item_key", hint.alias("hint")).where("hint IS NOT NULL")


def k8_promotion(spark: SparkSession, sf: str) -> DataFrame:
    """Rules that groups of three or more equal lessons of a symbol become: named by a hash, with the highest severity; held back where a risk topic shows."""
    n = W.note(spark, sf).where("symbol IS NOT NULL AND lesson IS NOT NULL AND NOT coalesce(promoted, false)").select("symbol", "note_key", "lesson", severity_rank("severity").alias("rank"), F.array_sort(X.lexical_tokens(F.col("lesson"))).alias("t"))
    g = n.where(F.size("t") > 0).groupBy("symbol", "t").agg(F.count(F.lit(1)).alias("notes"), F.min_by("lesson", "note_key").alias("rule"), F.max("rank").alias("rank")).where("notes >= 3")
    name = F.concat(F.col("symbol"), F.lit("-"), F.substring(F.sha1(F.concat("symbol", F.lit("::"), "rule")), 1, 8))
    severity = F.when(F.col("rank") == 3, "block").when(F.col("rank") == 2, "warn").otherwise("info")
    return g.select(name.alias("name"), severity.alias("severity"), "notes", (F.size(C.risk_topics(F.col("rule"))) > 0).alias("held_back"))


def g7_gap_and_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    """The eight sources of graph issues in one list: those reported by kind, and symbols in conflict or with failing runs to which no note is attached (gap)."""
    told = W.iss(spark, sf).where("kind IN ('conflict', 'stale', 'orphan_anchor', 'promotion_candidate', 'open_question', 'unverified_assumption', 'open_todo')").select("kind", "symbol")
    failing = W.runs(spark, sf).where("exit <> 0").select(F.explode("symbols").alias("symbol")).distinct()
    noted = W.note(spark, sf).select("symbol").dropna().distinct()
    gap = failing.join(noted, "symbol", "left_anti").select(F.lit("memory_gap").alias("kind"), "symbol")
    return told.unionByName(gap).groupBy("kind").agg(F.count(F.lit(1)).alias("issues"), F.count_distinct("symbol").alias("symbols"))


def u2_recalled_kinds(spark: SparkSession, sf: str) -> DataFrame:
    """All eight kinds of memory in one scored list: the five best of each for a phrase, by whole phrase (90), all words (70), some (30 and up)."""
    n, i, v = W.note(spark, sf), W.inb(spark, sf), W.iss(spark, sf)
    one = lambda d, kind, key, text: d.select(F.lit(kind).alias("kind"), F.col(key).alias("key"), F.col(text).alias("text"))
    parts = [
        one(n.where("NOT coalesce(promoted, false)"), "note", "note_key", "lesson"), one(n.where("promoted"), "decision", "note_key", "lesson"), one(i.where("kind = 'preference'"), "preference", "item_key", "text"), one(i.where("kind = 'directive'"), "directive", "item_key", "text"),
        one(v.where("kind = 'open_question'"), "question", "issue_key", "summary"), one(v.where("kind = 'unverified_assumption'"), "assumption", "issue_key", "summary"), one(v.where("kind = 'open_todo'"), "todo", "issue_key", "summary"), one(v.where("kind = 'promotion_candidate'"), "invariant", "issue_key", "summary"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    words = ["retry", "counter", "batch"]
    low = F.lower("text")
    hits = sum((low.contains(w).cast("int") for w in words), F.lit(0))
    score = F.when(low.contains("retry counter"), 90).when(hits == len(words), 70).when(hits > 0, 30 + F.floor(38 * hits / len(words) + 0.5)).otherwise(0).cast("int")
    scored = out.where("text IS NOT NULL").withColumn("score", score).where("score > 0")
    return top_by(scored, ["kind"], [F.desc("score"), F.length("text"), "key"], 5, "position").select("kind", "key", "score", "position")


def u6_edited_and_prepared(spark: SparkSession, sf: str) -> DataFrame:
    """Symbols by what sessions did with them: edited (failing runs) and prepared (passing runs) alike, only the one or only the other."""
    r = W.runs(spark, sf).select("exit", F.explode("symbols").alias("symbol")).where("symbol IS NOT NULL")
    g = r.groupBy("symbol").agg(F.max((F.col("exit") == 0).cast("int")).alias("p"), F.max((F.col("exit") != 0).cast("int")).alias("e"))
    return g.select("symbol", F.when(F.expr("p = 1 AND e = 1"), "both").when(F.col("p") == 1, "prepared").otherwise("edited").alias("side"))


def u7_content_merge(spark: SparkSession, sf: str) -> DataFrame:
    """Notes of all replicas merged: by id, else by symbol and lesson (240 characters of both), the first delivery."""
    n = table(spark, sf, "notes", "note_key", "id", "symbol", "lesson", "source")
    key = F.coalesce(F.nullif(F.col("id"), F.lit("")), F.substring(F.concat(F.coalesce("symbol", F.lit("")), F.lit("::"), F.coalesce("lesson", F.lit(""))), 1, 240))
    return n.groupBy(key.alias("k")).agg(F.min("note_key").alias("note_key"), F.count(F.lit(1)).alias("deliveries")).select("note_key", "deliveries")


def a14_change_stats(spark: SparkSession, sf: str) -> DataFrame:
    """Change statistics of the diffs among the documents by repository: files, added and deleted lines, changed call sites with high notes on their callers."""
    lines = W.diff_lines(spark, sf).join(W.docs(spark, sf).select("doc_id", "repo"), "doc_id")
    callee = F.nullif(F.regexp_extract("content", r"^\s*([A-Za-z_][A-Za-z0-9_]*)\(", 1), F.lit(""))
    high = W.note(spark, sf).where("severity = 'high' AND symbol IS NOT NULL").select(F.col("symbol").alias("callee")).distinct().withColumn("high", F.lit(1))
    m = lines.withColumn("callee", callee).join(high, "callee", "left")
    return m.groupBy("repo").agg(F.count_distinct("doc_id").alias("documents"), F.sum((F.col("tag") == "add").cast("bigint")).alias("added"), F.sum((F.col("tag") == "del").cast("bigint")).alias("deleted"), F.coalesce(F.sum(F.when(F.col("tag") == "add", F.col("high"))), F.lit(0)).cast("bigint").alias("annotated"))


def a16_recall(spark: SparkSession, sf: str) -> DataFrame:
    """Precision, recall and coverage of resolved edges against oracle labels: the only symbol that has the target's name, where there is one."""
    s = W.sym(spark, sf)
    oracle = s.groupBy(F.col("name").alias("to_name")).agg(F.when(F.count(F.lit(1)) == 1, F.min("id")).alias("truth")).where("truth IS NOT NULL")
    e = table(spark, sf, "edges", "edge_key", "to_id", "to_name").where("to_name IS NOT NULL").withColumn("to_id", F.nullif(F.btrim("to_id"), F.lit("")))
    m = e.join(oracle, "to_name", "left")
    g = m.agg(F.count(F.lit(1)).alias("edges"), F.count("to_id").alias("resolved"), F.count("truth").alias("labelled"), F.sum((F.col("to_id") == F.col("truth")).cast("bigint")).alias("confirmed"), F.sum((F.col("to_id") != F.col("truth")).cast("bigint")).alias("contradicted"))
    ratio = lambda a, b: F.round(a / F.greatest(b, F.lit(1)), 6)
    return g.select("*", ratio(F.col("confirmed"), F.col("confirmed") + F.col("contradicted")).alias("precision"), ratio(F.col("confirmed"), F.col("labelled")).alias("recall"), ratio(F.col("resolved"), F.col("edges")).alias("coverage"))


def a20_panel_kappa(spark: SparkSession, sf: str) -> DataFrame:
    """Mean agreement beyond chance of three judges of each bench run, pair by pair: timed out, output under 40 characters, duration over 300 seconds."""
    b = table(spark, sf, "bench_runs", "timed_out", "output", "duration_sec").select(F.coalesce("timed_out", F.lit(False)).alias("a"), (F.coalesce(F.length("output"), F.lit(0)) < 40).alias("b"), F.coalesce(F.col("duration_sec") > 300, F.lit(False)).alias("c"))
    p = lambda c: F.avg(F.col(c).cast("double"))

    def kappa(x: str, y: str):
        agree, chance = F.avg((F.col(x) == F.col(y)).cast("double")), p(x) * p(y) + (1 - p(x)) * (1 - p(y))
        return F.when(chance == 1, 1.0).otherwise((agree - chance) / (1 - chance))

    return b.agg(F.count(F.lit(1)).alias("n"), F.round((kappa("a", "b") + kappa("a", "c") + kappa("b", "c")) / 3, 6).alias("kappa"))


def a21_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """Memory metrics of bench sessions by arm: surfaced (the output names the symbol of the prompt), adherence (of those with an output, not timed out), rediscovery (the output repeats the prompt's opening) and, for the baseline, leakage (surfaced all the same)."""
    name = F.nullif(F.regexp_extract("prompt", "([a-z]+(?:[A-Z][A-Za-z0-9]*|_[a-z0-9]+)+)", 1), F.lit(""))
    b = table(spark, sf, "bench_runs", "prompt", "output", "timed_out", "arm").withColumn("name", name).where("name IS NOT NULL AND arm IS NOT NULL")
    surfaced, given = F.coalesce(F.col("output").contains(F.col("name")), F.lit(False)), F.coalesce(F.length("output"), F.lit(0)) > 0
    again = F.coalesce(F.col("output").startswith(F.substring("prompt", 1, 20)), F.lit(False))
    sum_ = lambda c: F.sum(c.cast("bigint"))
    g = b.groupBy("arm").agg(F.count(F.lit(1)).alias("sessions"), sum_(surfaced).alias("surfaced"), sum_(given).alias("applicable"), sum_(given & ~F.coalesce("timed_out", F.lit(False))).alias("honored"), sum_(again).alias("rediscovered"))
    return g.select("*", F.round(F.col("surfaced") / F.col("sessions"), 6).alias("surface_rate"), F.round(F.col("honored") / F.greatest("applicable", F.lit(1)), 6).alias("adherence"), F.when(F.col("arm") == "baseline", F.col("surfaced")).otherwise(0).alias("leakage"))


def t1_section_caps(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of a brief and of a full packet for each symbol that issues name, by section within its caps (brief 5, 5, 1, 2, 1, 1, 0, 3; full 25, 25, 5, 5, 3, 5, 5, 10)."""
    s = W.sym(spark, sf).select("id", "name", "file").join(W.iss(spark, sf).select(F.col("symbol").alias("id")).distinct(), "id", "left_semi")
    e, n = W.edg(spark, sf), W.note(spark, sf)
    by_name = lambda d, section: s.select("id", "name").join(d.groupBy(F.col("symbol").alias("name")).agg(F.count(F.lit(1)).alias("rows")), "name").select("id", F.lit(section).alias("section"), "rows")
    parts = [
        s.select("id").join(e.groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("rows")), "id").select("id", F.lit("callers").alias("section"), "rows"),
        s.select("id").join(e.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("rows")), "id").select("id", F.lit("callees").alias("section"), "rows"),
        by_name(n.where("NOT coalesce(promoted, false) AND symbol IS NOT NULL"), "notes"), by_name(n.where("promoted AND symbol IS NOT NULL"), "decisions"),
        s.select("id", "file").join(n.where("scope = 'file'").groupBy(F.col("symbol").alias("file")).agg(F.count(F.lit(1)).alias("rows")), "file").select("id", F.lit("pathNotes").alias("section"), "rows"),
        s.select("id", "file").join(W.file_commits(spark, sf).groupBy("file").agg(F.count(F.lit(1)).alias("rows")), "file").select("id", F.lit("provenance").alias("section"), "rows"),
        s.select("id").join(W.iss(spark, sf).where("kind = 'open_todo'").groupBy(F.col("symbol").alias("id")).agg(F.count(F.lit(1)).alias("rows")), "id").select("id", F.lit("todos").alias("section"), "rows"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    cap = lambda caps: F.coalesce(*(F.when(F.col("section") == k, F.lit(v)) for k, v in caps.items()))
    return out.select("id", "section", "rows", F.least("rows", cap(BRIEF)).cast("bigint").alias("brief"), F.least("rows", cap(FULL)).cast("bigint").alias("full"))


# Rows of each section in a brief and in a full packet.
BRIEF = {"callers": 5, "callees": 5, "notes": 1, "pathNotes": 2, "decisions": 1, "preferences": 1, "provenance": 0, "todos": 3}
FULL = {"callers": 25, "callees": 25, "notes": 5, "pathNotes": 5, "decisions": 3, "preferences": 5, "provenance": 5, "todos": 10}


def k27_annotations(spark: SparkSession, sf: str) -> DataFrame:
    """Changed lines of the diffs in each repository that a note on the changed symbol annotates, and gaps without one."""
    lines = W.diff_lines(spark, sf).where("tag <> 'del'").join(W.docs(spark, sf).select("doc_id", "repo"), "doc_id")
    named = lines.withColumn("symbol", F.regexp_extract("content", r"^\s*([A-Za-z_][A-Za-z0-9_]*)\(", 1))
    noted = W.note(spark, sf).where("symbol IS NOT NULL").select("symbol").distinct().withColumn("noted", F.lit(True))
    return named.join(noted, "symbol", "left").groupBy("repo").agg(F.count("noted").alias("annotated"), F.sum(F.col("noted").isNull().cast("bigint")).alias("gaps"))


def k21_commits_and_pulls(spark: SparkSession, sf: str) -> DataFrame:
    """Change summary of each repository: its last commits, up to twenty, their areas, and the pull requests that notes on its files name."""
    c = top_by(W.commits(spark, sf).where("repo IS NOT NULL"), ["repo"], [F.col("at").desc_nulls_last(), "doc_id", "sha"], 20)
    area = F.regexp_extract("subject", r"\(([a-z-]+)\)", 1)
    g = c.groupBy("repo").agg(F.count(F.lit(1)).alias("commits"), F.count_distinct(area).alias("areas"), F.max("at").alias("last_at"))
    pulls = W.note(spark, sf).select(F.nullif(F.regexp_extract("evidence", r"(?:PR |\()#([0-9]+)", 1), F.lit("")).alias("pr")).agg(F.count_distinct("pr").alias("pulls"))
    return g.join(F.broadcast(pulls))  # one row


def s10_file_log(spark: SparkSession, sf: str) -> DataFrame:
    """The last five commits of each file."""
    return top_by(W.file_commits(spark, sf), ["file"], [F.col("at").desc(), "commit"], 5, "position").select("file", "commit", "author", "at", "position")


def s11_changed_files(spark: SparkSession, sf: str) -> DataFrame:
    """Files of the working tree that differ: tracked ones that changed, and those that no symbol stands in (untracked)."""
    tracked = W.stale(spark, sf).where("file_changed_since AND file IS NOT NULL").select("file", F.lit("changed").alias("state"))
    known = table(spark, sf, "symbols", "file").dropna().distinct()
    new = table(spark, sf, "edges", "file").dropna().distinct().join(known, "file", "left_anti").select("file", F.lit("untracked").alias("state"))
    return tracked.unionByName(new).groupBy("file").agg(F.min("state").alias("state"))


def s15_pull_threads(spark: SparkSession, sf: str) -> DataFrame:
    """Review threads among the documents: their comments, who wrote first and last, and how many wrote."""
    rx = r"^([a-z]+-[0-9]+) wrote: "
    c = W.docs(spark, sf).where("lower(trim(source)) = 'review_thread' AND text IS NOT NULL").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line")).where(F.col("line").rlike(rx))
    c = c.withColumn("author", F.regexp_extract("line", rx, 1))
    return c.groupBy("doc_id").agg(F.count(F.lit(1)).alias("comments"), F.count_distinct("author").alias("authors"), F.min_by("author", "pos").alias("first"), F.max_by("author", "pos").alias("last"))


def s17_user_text(spark: SparkSession, sf: str) -> DataFrame:
    """What users say in each transcript, as one text of up to the last 60,000 characters."""
    lines = F.filter(F.split("text", "\n"), lambda x: x.startswith("user: "))
    d = W.docs(spark, sf).where("text IS NOT NULL").select("doc_id", F.array_join(F.transform(lines, lambda x: F.substring(x, 7, 2_000_000_000)), "\n\n").alias("said")).where("said <> ''")
    return d.select("doc_id", F.right("said", F.lit(60_000)).alias("said"))


_ISSUE = "CASE severity WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END"
_DAYS = "floor((epoch_us(TIMESTAMP '2026-07-01') - epoch_us({c})) / 86400000000)"
_old = lambda c, n: f"{_DAYS.format(c=c)} {n}"
_CAP = lambda caps: "CASE section " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in caps.items()) + " END"
_NAME = "nullif(regexp_extract(prompt, '[a-z]+(?:[A-Z][A-Za-z0-9]*|_[a-z0-9]+)+'), '')"
_KAPPA = lambda x, y: f"(SELECT CASE WHEN c = 1 THEN 1.0::DOUBLE ELSE (g - c) / (1 - c) END FROM (SELECT avg(({x} = {y})::INT) AS g, avg({x}::INT) * avg({y}::INT) + (1 - avg({x}::INT)) * (1 - avg({y}::INT)) AS c FROM j))"

_FUNCS = (k6_prune, k17_record, k18_status, k23_why, k23_prime, k30_post_edit_audit, r11_maintenance, a11_feature_health, x12_merge_clusters, k12_scope_hints, k8_promotion, g7_gap_and_duplicates, u2_recalled_kinds, u6_edited_and_prepared, u7_content_merge, a14_change_stats, a16_recall, a20_panel_kappa, a21_metrics, t1_section_caps, k27_annotations, k21_commits_and_pulls, s10_file_log, s11_changed_files, s15_pull_threads, s17_user_text)
QUERIES = {f.__name__: f for f in _FUNCS}
SQL = {
    "k6_prune": W.sql(f"""
SELECT * FROM (SELECT note_key, CASE WHEN coalesce(try_cast(expires_at AS TIMESTAMP) < TIMESTAMP '2026-07-01', false) THEN 'expired' WHEN {_old('recorded_at', '>= 90')} AND last_surfaced_at IS NULL THEN 'never surfaced' WHEN {_old('recorded_at', '>= 90')} AND {_old('last_surfaced_at', '>= 90')} THEN 'not surfaced lately' END AS reason
FROM note WHERE coalesce(source, '') NOT IN ('human', 'doc', 'incident', 'pr') AND NOT coalesce(promoted, false) AND coalesce(severity, '') <> 'high' AND coalesce(confidence, classifier.confidence, 0.0::DOUBLE) < 0.8::DOUBLE) WHERE reason IS NOT NULL"""),
    "k17_record": W.sql("SELECT substr(sha1(lower(trim(text))), 1, 12) AS id, min(item_key) AS item_key, count(*) - 1 AS hits FROM inb WHERE kind = 'preference' AND text IS NOT NULL GROUP BY 1"),
    "k18_status": 'SELECT was, "is", count(*) AS items, sum(events)::BIGINT AS events FROM (SELECT id, arg_min(status, item_key) AS was, arg_max(status, item_key) AS "is", count(*) AS events FROM inbox WHERE id IS NOT NULL GROUP BY id) GROUP BY 1, 2',
    "k23_why": W.sql("""
, fc AS (SELECT file, arg_max(commit, ("at", commit)) AS last_commit FROM file_commits GROUP BY file), de AS (SELECT symbol, note_key AS decision FROM note WHERE promoted AND symbol IS NOT NULL QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY recorded_at DESC NULLS LAST, note_key) = 1),
nn AS (SELECT symbol, count(*) AS notes FROM note WHERE NOT coalesce(promoted, false) AND symbol IS NOT NULL GROUP BY 1), qq AS (SELECT symbol, count(*) AS questions FROM iss WHERE kind = 'open_question' GROUP BY 1), fe AS (SELECT id, label FROM weights QUALIFY row_number() OVER (PARTITION BY id ORDER BY round(weight, 6) DESC, label) = 1)
SELECT s.id, last_commit, decision, coalesce(notes, 0) AS notes, coalesce(questions, 0) AS questions, fe.label AS feature FROM sym s LEFT JOIN fc ON fc.file = s.file LEFT JOIN de ON de.symbol = s.name LEFT JOIN nn ON nn.symbol = s.name LEFT JOIN qq ON qq.symbol = s.id LEFT JOIN fe ON fe.id = s.name WHERE s.id IN (SELECT symbol FROM iss WHERE symbol IS NOT NULL)"""),
    "k23_prime": W.sql("""
, p AS (SELECT 1 AS section, 0 AS o, lpad(min(item_key)::VARCHAR, 12, '0') AS key FROM inb WHERE kind = 'preference' AND status = 'approved' AND text IS NOT NULL GROUP BY text), r AS (SELECT 2, CASE severity WHEN 'block' THEN 0 ELSE 1 END, name FROM rules WHERE severity IN ('block', 'warn')),
d AS (SELECT 3, 0, lpad(note_key::VARCHAR, 12, '0') FROM (SELECT note_key FROM note WHERE promoted AND symbol IS NOT NULL AND recorded_at IS NOT NULL ORDER BY recorded_at DESC, note_key LIMIT 5)), g AS (SELECT 4, 0, lpad(note_key::VARCHAR, 12, '0') FROM note WHERE scope = 'global' AND lesson IS NOT NULL)
SELECT section, key, position FROM (SELECT *, row_number() OVER (PARTITION BY section ORDER BY o, key) AS position FROM (SELECT * FROM p UNION ALL SELECT * FROM r UNION ALL SELECT * FROM d UNION ALL SELECT * FROM g)) WHERE position <= 20"""),
    "k30_post_edit_audit": f"SELECT 'failed_audits' AS section, count(*) AS items FROM ({streams.SQL['r9_session_audit']}) WHERE NOT passed UNION ALL SELECT 'hard_searches', count(*) FROM ({streams.SQL['r8_hard_searches']}) UNION ALL SELECT 'repeated_mistakes', count(*) FROM ({aggregates.SQL['a7_repeated_mistakes']}) UNION ALL SELECT 'learned_commands', count(*) FROM ({aggregates.SQL['a6_learned_commands']}) UNION ALL SELECT 'suggestions', count(*) FROM ({lifecycle.SQL['k10_suggestions']})",
    "r11_maintenance": W.sql(f"""SELECT source, last_run, last_run IS NULL OR {_old('last_run', '>= 7')} AS due FROM (SELECT source FROM stale_entries WHERE source IS NOT NULL UNION SELECT source FROM test_runs WHERE source IS NOT NULL) LEFT JOIN (SELECT source, max("at") AS last_run FROM runs WHERE exit = 0 GROUP BY source) USING (source)"""),
    "a11_feature_health": W.sql(f"""
, n AS (SELECT label, count(*) FILTER (WHERE NOT coalesce(promoted, false)) AS notes, count(*) FILTER (WHERE NOT coalesce(promoted, false) AND {_old('recorded_at', '> 180')}) AS old_notes, count(*) FILTER (WHERE promoted) AS decisions FROM weights w JOIN note ON note.symbol = w.id GROUP BY label),
i AS (SELECT label, count(*) FILTER (WHERE kind = 'open_question') AS questions, count(*) FILTER (WHERE kind = 'open_question' AND {_old('raised_at', '> 30')}) AS old_questions, count(*) FILTER (WHERE kind = 'unverified_assumption') AS assumptions, count(*) FILTER (WHERE kind = 'unverified_assumption' AND severity <> 'info') AS unverified, count(*) FILTER (WHERE kind = 'conflict') AS conflicts FROM weights w JOIN iss ON iss.symbol = w.id GROUP BY label),
r AS (SELECT label, count(DISTINCT name) AS rules FROM weights w JOIN (SELECT name, unnest(applies_to) AS p FROM rules) ON {lifecycle._FITS.format(p='p', q='w.id')} GROUP BY label),
m AS (SELECT l.label, coalesce(rules, 0) AS rules, coalesce(notes, 0) AS notes, coalesce(old_notes, 0) AS old_notes, coalesce(questions, 0) AS questions, coalesce(old_questions, 0) AS old_questions, coalesce(assumptions, 0) AS assumptions, coalesce(unverified, 0) AS unverified, coalesce(conflicts, 0) AS conflicts, coalesce(decisions, 0) AS decisions FROM (SELECT DISTINCT label FROM weights) l LEFT JOIN n USING (label) LEFT JOIN i USING (label) LEFT JOIN r USING (label))
SELECT *, round(0.25::DOUBLE * least(1.0::DOUBLE, rules / 4.0::DOUBLE) + 0.15::DOUBLE * (CASE WHEN notes > 0 THEN 1 - old_notes::DOUBLE / notes ELSE 1 END + CASE WHEN questions > 0 THEN 1 - old_questions::DOUBLE / questions ELSE 1 END + CASE WHEN assumptions > 0 THEN 1 - unverified::DOUBLE / assumptions ELSE 1 END + exp(-conflicts / 3.0::DOUBLE) + least(1.0::DOUBLE, decisions / 6.0::DOUBLE)), 6) AS health FROM m"""),
    "x12_merge_clusters": W.sql(f"SELECT kind, area, min(item_key) AS canonical, count(*) - 1 AS duplicates FROM (SELECT item_key, kind, CASE WHEN kind = 'directive' THEN area END AS area, list_sort({X.sql_lexical('text')}) AS t FROM inb WHERE status = 'pending' AND text IS NOT NULL) WHERE len(t) > 0 GROUP BY kind, area, t HAVING count(*) > 1"),
    "k12_scope_hints": W.sql(f"SELECT * FROM (SELECT item_key, CASE WHEN kind = 'preference' AND {C.sql_has('text', C.LOCATION_CUE)} THEN 'location-scoped' WHEN kind = 'directive' AND coalesce(area, '') = '' THEN 'no area' WHEN kind = 'directive' AND {C.sql_has('text', C.DURABLE_CUE)} AND NOT {C.sql_has('text', C.LOCATION_CUE)} THEN 'repo-wide' END AS hint FROM inb WHERE status = 'pending' AND text IS NOT NULL) WHERE hint IS NOT NULL"),
    "k8_promotion": W.sql(f"""
, g AS (SELECT symbol, count(*) AS notes, arg_min(lesson, note_key) AS rule, max({_ISSUE}) AS rank FROM (SELECT *, list_sort({X.sql_lexical('lesson')}) AS t FROM note WHERE symbol IS NOT NULL AND lesson IS NOT NULL AND NOT coalesce(promoted, false)) WHERE len(t) > 0 GROUP BY symbol, t HAVING count(*) >= 3)
SELECT symbol || '-' || substr(sha1(symbol || '::' || rule), 1, 8) AS name, CASE rank WHEN 3 THEN 'block' WHEN 2 THEN 'warn' ELSE 'info' END AS severity, notes, len({C.sql_topics('rule')}) > 0 AS held_back FROM g"""),
    "g7_gap_and_duplicates": W.sql("SELECT kind, count(*) AS issues, count(DISTINCT symbol) AS symbols FROM (SELECT kind, symbol FROM iss WHERE kind <> 'memory_gap' UNION ALL SELECT DISTINCT 'memory_gap', s FROM (SELECT unnest(symbols) AS s FROM runs WHERE exit <> 0) WHERE s NOT IN (SELECT symbol FROM note WHERE symbol IS NOT NULL)) GROUP BY kind"),
    "u2_recalled_kinds": W.sql("""
, m AS (SELECT CASE WHEN promoted THEN 'decision' ELSE 'note' END AS kind, note_key AS key, lesson AS text FROM note UNION ALL SELECT kind, item_key, text FROM inb WHERE kind IN ('preference', 'directive')
 UNION ALL SELECT CASE kind WHEN 'open_question' THEN 'question' WHEN 'unverified_assumption' THEN 'assumption' WHEN 'open_todo' THEN 'todo' ELSE 'invariant' END, issue_key, summary FROM iss WHERE kind IN ('open_question', 'unverified_assumption', 'open_todo', 'promotion_candidate')),
h AS (SELECT *, contains(lower(text), 'retry')::INT + contains(lower(text), 'counter')::INT + contains(lower(text), 'batch')::INT AS n FROM m WHERE text IS NOT NULL),
s AS (SELECT kind, key, text, CASE WHEN contains(lower(text), 'retry counter') THEN 90 WHEN n = 3 THEN 70 WHEN n > 0 THEN 30 + floor(38.0 * n / 3 + 0.5)::INT ELSE 0 END AS score FROM h)
SELECT kind, key, score, position FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY score DESC, length(text), key) AS position FROM s WHERE score > 0) WHERE position <= 5"""),
    "u6_edited_and_prepared": W.sql("SELECT symbol, CASE WHEN p AND e THEN 'both' WHEN p THEN 'prepared' ELSE 'edited' END AS side FROM (SELECT s AS symbol, bool_or(exit = 0) AS p, bool_or(exit <> 0) AS e FROM (SELECT unnest(symbols) AS s, exit FROM runs) WHERE s IS NOT NULL GROUP BY s)"),
    "u7_content_merge": "SELECT min(note_key) AS note_key, count(*) AS deliveries FROM (SELECT note_key, coalesce(nullif(id, ''), substr(coalesce(symbol, '') || '::' || coalesce(lesson, ''), 1, 240)) AS k FROM notes) GROUP BY k",
    "a14_change_stats": W.sql("""
SELECT repo, count(DISTINCT doc_id) AS documents, count(*) FILTER (WHERE tag = 'add') AS added, count(*) FILTER (WHERE tag = 'del') AS deleted, count(*) FILTER (WHERE tag = 'add' AND callee IN (SELECT symbol FROM note WHERE severity = 'high' AND symbol IS NOT NULL)) AS annotated
FROM (SELECT *, nullif(regexp_extract(content, '^\\s*([A-Za-z_][A-Za-z0-9_]*)\\(', 1), '') AS callee FROM difflines JOIN (SELECT doc_id, repo FROM documents) USING (doc_id)) GROUP BY repo"""),
    "a16_recall": W.sql("""
, t AS (SELECT name, min(id) AS truth FROM sym GROUP BY name HAVING count(*) = 1), e AS (SELECT nullif(trim(to_id), '') AS to_id, truth FROM edges LEFT JOIN t ON t.name = to_name WHERE to_name IS NOT NULL),
g AS (SELECT count(*) AS edges, count(to_id) AS resolved, count(truth) AS labelled, count(*) FILTER (WHERE to_id = truth) AS confirmed, count(*) FILTER (WHERE to_id <> truth) AS contradicted FROM e)
SELECT *, round(confirmed::DOUBLE / greatest(confirmed + contradicted, 1), 6) AS precision, round(confirmed::DOUBLE / greatest(labelled, 1), 6) AS recall, round(resolved::DOUBLE / greatest(edges, 1), 6) AS coverage FROM g"""),
    "a20_panel_kappa": f"WITH j AS (SELECT coalesce(timed_out, false) AS a, coalesce(length(output), 0) < 40 AS b, coalesce(duration_sec > 300, false) AS c FROM bench_runs) SELECT count(*) AS n, round(({_KAPPA('a', 'b')} + {_KAPPA('a', 'c')} + {_KAPPA('b', 'c')}) / 3, 6) AS kappa FROM j",
    "a21_metrics": f"""
WITH b AS (SELECT arm, prompt, output, timed_out, {_NAME} AS name FROM bench_runs WHERE arm IS NOT NULL), g AS (SELECT arm, count(*) AS sessions, count(*) FILTER (WHERE contains(output, name)) AS surfaced, count(*) FILTER (WHERE coalesce(length(output), 0) > 0) AS applicable,
 count(*) FILTER (WHERE coalesce(length(output), 0) > 0 AND NOT coalesce(timed_out, false)) AS honored, count(*) FILTER (WHERE starts_with(output, substr(prompt, 1, 20))) AS rediscovered FROM b WHERE name IS NOT NULL GROUP BY arm)
SELECT *, round(surfaced::DOUBLE / sessions, 6) AS surface_rate, round(honored::DOUBLE / greatest(applicable, 1), 6) AS adherence, CASE WHEN arm = 'baseline' THEN surfaced ELSE 0 END AS leakage FROM g""",
    "t1_section_caps": W.sql(f"""
, s AS (SELECT id, name, file FROM sym WHERE id IN (SELECT symbol FROM iss WHERE symbol IS NOT NULL)),
p AS (SELECT s.id, 'callers' AS section, count(*) AS rows FROM s JOIN edg ON dst = s.id GROUP BY 1 UNION ALL SELECT s.id, 'callees', count(*) FROM s JOIN edg ON src = s.id GROUP BY 1 UNION ALL SELECT s.id, CASE WHEN promoted THEN 'decisions' ELSE 'notes' END, count(*) FROM s JOIN note n ON n.symbol = s.name GROUP BY 1, 2
 UNION ALL SELECT s.id, 'pathNotes', count(*) FROM s JOIN note n ON n.symbol = s.file AND n.scope = 'file' GROUP BY 1 UNION ALL SELECT s.id, 'provenance', count(*) FROM s JOIN file_commits f ON f.file = s.file GROUP BY 1 UNION ALL SELECT s.id, 'todos', count(*) FROM s JOIN iss i ON i.symbol = s.id AND i.kind = 'open_todo' GROUP BY 1)
SELECT id, section, rows, least(rows, {_CAP(BRIEF)})::BIGINT AS brief, least(rows, {_CAP(FULL)})::BIGINT AS "full" FROM p"""),
    "k27_annotations": W.sql("SELECT repo, count(*) FILTER (WHERE noted) AS annotated, count(*) FILTER (WHERE NOT noted) AS gaps FROM (SELECT repo, regexp_extract(content, '^\\s*([A-Za-z_][A-Za-z0-9_]*)\\(', 1) IN (SELECT symbol FROM note WHERE symbol IS NOT NULL) AS noted FROM difflines JOIN (SELECT doc_id, repo FROM documents) USING (doc_id) WHERE tag <> 'del') GROUP BY repo"),
    "k21_commits_and_pulls": W.sql("""
SELECT repo, count(*) AS commits, count(DISTINCT regexp_extract(subject, '\\(([a-z-]+)\\)', 1)) AS areas, max("at") AS last_at, (SELECT count(DISTINCT nullif(regexp_extract(evidence, '(?:PR |\\()#([0-9]+)', 1), '')) FROM note) AS pulls
FROM (SELECT * FROM commits WHERE repo IS NOT NULL QUALIFY row_number() OVER (PARTITION BY repo ORDER BY "at" DESC NULLS LAST, doc_id, sha) <= 20) GROUP BY repo"""),
    "s10_file_log": W.sql("""SELECT file, commit, author, "at", position FROM (SELECT *, row_number() OVER (PARTITION BY file ORDER BY "at" DESC, commit) AS position FROM file_commits) WHERE position <= 5"""),
    "s11_changed_files": "SELECT file, min(state) AS state FROM (SELECT file, 'changed' AS state FROM stale_entries WHERE file_changed_since AND file IS NOT NULL UNION ALL SELECT file, 'untracked' FROM edges WHERE file IS NOT NULL AND file NOT IN (SELECT file FROM symbols WHERE file IS NOT NULL)) GROUP BY file",
    "s15_pull_threads": "SELECT doc_id, count(*) AS comments, count(DISTINCT author) AS authors, arg_min(author, pos) AS first, arg_max(author, pos) AS last FROM (SELECT doc_id, pos, regexp_extract(line, '^([a-z]+-[0-9]+) wrote: ', 1) AS author FROM (SELECT doc_id, generate_subscripts(ls, 1) AS pos, unnest(ls) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE lower(trim(source)) = 'review_thread' AND text IS NOT NULL))) WHERE author <> '' GROUP BY doc_id",
    "s17_user_text": "SELECT doc_id, right(said, 60000) AS said FROM (SELECT doc_id, array_to_string(list_transform(list_filter(string_split(text, chr(10)), lambda x: starts_with(x, 'user: ')), lambda x: substr(x, 7)), chr(10) || chr(10)) AS said FROM documents WHERE text IS NOT NULL) WHERE said <> ''",
}
