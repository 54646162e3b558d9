"""Join queries: patterns, anchors, folders, line ranges, as-of, similarity and their anti-joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.keys import fingerprint
from ..operators.intervals import folders_above, overlaps
from ..operators.patterns import pattern_matches
from ..operators.sequences import carried
from ..operators.ranking import first_by, top_by
from ..operators.similar import nearest_names, similar_sets
from ..session import cut, kept
from ..sources.tables import table
from . import warehouse as W


def _patterns(spark: SparkSession, sf: str) -> DataFrame:
    """Rules of promotion candidates with one pattern each: info applies to a symbol, warn to a prefix*, block to a *suffix."""
    i = W.iss(spark, sf).where("kind = 'promotion_candidate' AND symbol IS NOT NULL")
    bare = F.regexp_extract("symbol", r"([A-Za-z0-9_]+)(?:@[0-9a-f]+)?$", 1)
    shape = F.when(F.col("severity") == "warn", F.concat(F.substring(bare, 1, 6), F.lit("*"))).when(F.col("severity") == "block", F.concat(F.lit("*"), F.expr("right(regexp_extract(symbol, '([A-Za-z0-9_]+)(?:@[0-9a-f]+)?$', 1), 6)")))
    return i.select("issue_key", "severity", F.coalesce(shape, F.col("symbol")).alias("pattern"))


def j5_pattern_hits(spark: SparkSession, sf: str) -> DataFrame:
    """Rules with the number of symbols their pattern fits: equal, prefix*, *suffix, or the part after a '.' or '/' (P1)."""
    s = W.sym(spark, sf).select("id", F.coalesce("qualified_name", "name").alias("name")).where("name IS NOT NULL")
    wanted = _patterns(spark, sf)
    met = pattern_matches(s, wanted).join(s.groupBy("name").agg(F.count(F.lit(1)).alias("n")), "name").groupBy("pattern").agg(F.sum("n").alias("hits"))
    return wanted.join(met, "pattern").select("issue_key", "severity", "hits")


def j6_anchored_notes(spark: SparkSession, sf: str) -> DataFrame:
    """Notes per symbol, anchored by bare or qualified name, each note once."""
    names = W.sym(spark, sf).select("id", F.explode(F.array_distinct(F.array("name", "qualified_name"))).alias("symbol")).where("symbol IS NOT NULL")
    n = W.note(spark, sf).where("scope = 'symbol'").select("symbol", "note_key")
    return names.join(n, "symbol").groupBy("id").agg(F.count_distinct("note_key").alias("notes"))


def _areas(spark: SparkSession, sf: str) -> DataFrame:
    return W.note(spark, sf).where("scope = 'area' AND symbol IS NOT NULL").select(F.rtrim(F.col("symbol"), F.lit("/")).alias("area"), "note_key")


def j7_area_notes(spark: SparkSession, sf: str) -> DataFrame:
    """Notes on any folder above each file of a symbol."""
    files = W.sym(spark, sf).select("file").where("file IS NOT NULL").distinct()
    above = files.select("file", F.explode(folders_above(F.col("file"))).alias("area"))
    notes = _areas(spark, sf).groupBy("area").agg(F.count(F.lit(1)).alias("n"))
    return above.join(notes, "area").groupBy("file").agg(F.sum("n").alias("notes"))


def j10_deepest_area(spark: SparkSession, sf: str) -> DataFrame:
    """The deepest registered folder above each file."""
    files = W.sym(spark, sf).select("file").where("file IS NOT NULL").distinct()
    above = files.select("file", F.explode(folders_above(F.col("file"))).alias("area"))
    return above.join(_areas(spark, sf).select("area").distinct(), "area", "left_semi").groupBy("file").agg(F.max_by("area", F.length("area")).alias("area"))


def _hunks(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "edges", "edge_key", "file", "line").where("file IS NOT NULL AND line IS NOT NULL")
    return e.select("file", F.col("line").alias("lo"), (F.col("line") + 2).alias("hi"), F.col("edge_key").alias("l"))


def _ranges(spark: SparkSession, sf: str) -> DataFrame:
    s = W.sym(spark, sf).where("file IS NOT NULL AND line IS NOT NULL")
    known = F.col("end_line").isNotNull()
    return s.select("file", F.when(known, F.col("line")).otherwise(F.col("line") - 1).alias("lo"), F.when(known, F.col("end_line")).otherwise(F.col("line") + 1).alias("hi"), F.col("symbol_key").alias("r"))


def j8_hunk_overlap(spark: SparkSession, sf: str) -> DataFrame:
    """Hunks (three lines at each call site) per symbol whose lines they touch; a symbol without an end counts one line around its start."""
    return overlaps(_hunks(spark, sf), _ranges(spark, sf)).groupBy(F.col("r").alias("symbol_key")).agg(F.count(F.lit(1)).alias("hunks"))


def j9_uncovered_hunks(spark: SparkSession, sf: str) -> DataFrame:
    """Hunks that touch no symbol, counted per file."""
    h = _hunks(spark, sf)
    return h.join(overlaps(h, _ranges(spark, sf)).select("l"), "l", "left_anti").groupBy("file").agg(F.count(F.lit(1)).alias("gaps"))


def j11_asof_note(spark: SparkSession, sf: str) -> DataFrame:
    """For each issue the latest note on its symbol recorded by then; a hot symbol is spread by day."""
    n = W.note(spark, sf).where("symbol IS NOT NULL AND recorded_at IS NOT NULL").select("symbol", F.col("recorded_at").alias("t"), F.lit(0).alias("probe"), F.col("note_key").alias("key"), "note_key", F.lit(None).cast("bigint").alias("issue_key"))
    i = W.iss(spark, sf).where("symbol IS NOT NULL AND raised_at IS NOT NULL").select("symbol", F.col("raised_at").alias("t"), F.lit(1).alias("probe"), F.col("issue_key").alias("key"), F.lit(None).cast("bigint").alias("note_key"), "issue_key")
    seen = carried(n.unionByName(i), ["symbol"], F.datediff(F.to_date("t"), F.lit("2000-01-01").cast("date")), ["t", "probe", "key"], "note_key", "last_note")
    return seen.where("probe = 1 AND last_note IS NOT NULL").select("issue_key", F.col("last_note").alias("note_key"))


def j12_feature_overlap(spark: SparkSession, sf: str) -> DataFrame:
    """Symbols that two features share with a weight of 0.2 or more in both."""
    w = W.weights(spark, sf).where("weight >= 0.2").select("label", "id", "weight")
    pairs = w.alias("a").join(w.alias("b"), (F.col("a.id") == F.col("b.id")) & (F.col("a.label") < F.col("b.label")))
    return pairs.select(F.col("a.id").alias("id"), F.col("a.label").alias("a"), F.col("b.label").alias("b"), F.round(F.col("a.weight") * F.col("b.weight"), 6).alias("strength"))


def j13_feature_isolate(spark: SparkSession, sf: str) -> DataFrame:
    """Symbols of a feature that no other feature holds with 0.1 or more."""
    w = W.weights(spark, sf)
    others = w.where("weight >= 0.1").groupBy("id").agg(F.collect_set("label").alias("labels"))
    return w.join(others, "id", "left").where(F.coalesce(F.size(F.array_except("labels", F.array("label"))), F.lit(0)) <= 0).select("label", "id")


def j14_feature_diff(spark: SparkSession, sf: str) -> DataFrame:
    """What entered, left or changed its weight by more than 0.05 in the twenty heaviest symbols of each feature, between the state as of April and now."""
    then = W.ranked_weights(W.touches(spark, sf).where("ts <= '2026-04-01'")).select("label", "id", F.col("weight").alias("w_then"))
    now = W.ranked_weights(W.touches(spark, sf)).select("label", "id", F.col("weight").alias("w_now"))
    both = then.join(now, ["label", "id"], "full_outer")
    change = F.when(F.col("w_then").isNull(), "entered").when(F.col("w_now").isNull(), "left").when(F.abs(F.col("w_now") - F.col("w_then")) > 0.05, "weight")
    return both.select("label", "id", change.alias("change"), F.round("w_then", 6).alias("weight_then"), F.round("w_now", 6).alias("weight_now")).where("change IS NOT NULL")


def j15_test_coverage(spark: SparkSession, sf: str) -> DataFrame:
    """Runs, and failing ones, that name each symbol in their list or in their message, and whether a test file stands beside the symbol's own."""
    r = W.runs(spark, sf)
    said = r.select("seq", "exit", F.explode(F.array_distinct(F.concat(F.coalesce("symbols", F.array()), F.regexp_extract_all(F.coalesce("message", F.lit("")), F.lit("([A-Za-z_$][A-Za-z0-9_$]*)"), F.lit(1))))).alias("name"))
    s = W.sym(spark, sf).select("id", "name", "file")
    stem = F.regexp_replace("file", r"\.[jt]sx?$|\.py$", "")
    folder, base = F.regexp_extract("file", "^(.*/)?[^/]*$", 1), F.regexp_extract(stem, "([^/]*)$", 1)
    beside = F.array(*(F.concat(stem, F.lit(e)) for e in (".test.ts", ".test.tsx", ".test.js", ".spec.ts", ".spec.js", "_test.py")), F.concat(folder, F.lit("test_"), base, F.lit(".py")))
    files = s.select("file").dropna().distinct()
    near = files.select(F.col("file").alias("own"), F.explode(beside).alias("file")).join(files, "file", "left_semi").select(F.col("own").alias("file")).distinct().withColumn("beside", F.lit(True))
    runs = s.join(said, "name").groupBy("id").agg(F.count_distinct("seq").alias("runs"), F.count_distinct(F.when(F.col("exit") != 0, F.col("seq"))).alias("failing"))
    m = s.select("id", "file").join(runs, "id", "left").join(near, "file", "left")
    return m.where("runs IS NOT NULL OR beside").select("id", F.coalesce("runs", F.lit(0)).alias("runs"), F.coalesce("failing", F.lit(0)).alias("failing"), F.coalesce("beside", F.lit(False)).alias("beside"))


def j16_test_gaps(spark: SparkSession, sf: str) -> DataFrame:
    """Called symbols that no run names: untested, or tested only by way of a caller."""
    tested = W.runs(spark, sf).select(F.explode("symbols").alias("name")).distinct()
    s = W.sym(spark, sf).select("id", "name").join(tested.withColumn("own", F.lit(True)), "name", "left")
    e = W.edg(spark, sf)
    via = e.join(s.where("own").select(F.col("id").alias("src")), "src", "left_semi").select(F.col("dst").alias("id")).distinct().withColumn("via", F.lit(True))
    called = s.where("own IS NULL").join(e.select(F.col("dst").alias("id")).distinct(), "id", "left_semi")
    return called.join(via, "id", "left").select("id", F.when(F.col("via"), "by caller only").otherwise("no test").alias("reason"))


def j17_uncovered_issues(spark: SparkSession, sf: str) -> DataFrame:
    """Issues whose symbol has no note."""
    noted = W.note(spark, sf).select("symbol").dropna().distinct()
    return W.iss(spark, sf).where("symbol IS NOT NULL").join(noted, "symbol", "left_anti").select("issue_key")


def j18_waived_rules(spark: SparkSession, sf: str) -> DataFrame:
    """Rules with whether a waiver names them, and the first that does."""
    w = W.waivers(spark, sf).select(F.col("invariant").alias("name"), "item_key")
    return W.rules(spark, sf).select("name", "severity").join(w, "name", "left").select("name", "severity", F.col("item_key").isNotNull().alias("waived"), "item_key")


def j19_missing_anchor(spark: SparkSession, sf: str) -> DataFrame:
    """Symbol notes whose anchor is neither an id nor a name, nor one in lower case."""
    known = W.sym(spark, sf).select(F.explode(F.array(F.lower("id"), F.lower("qualified_name"), F.lower("name"))).alias("k")).dropna().distinct()
    n = W.note(spark, sf).where("scope = 'symbol' AND symbol IS NOT NULL").withColumn("k", F.lower("symbol"))
    return n.join(known, "k", "left_anti").select("note_key", "symbol")


def j20_nearest_anchor(spark: SparkSession, sf: str) -> DataFrame:
    """For each missing anchor the most similar symbol name by edit distance, 0.6 or more, both of four characters or more.

    The anchors asked for are the query set. Every name is compared, by blocks (`nearest_names`).
    """
    asked = j19_missing_anchor(spark, sf).select("symbol").distinct().where(F.length("symbol") >= 4)
    names = W.sym(spark, sf).select("name").where(F.length("name") >= 4).distinct()
    longest = F.greatest(F.length("symbol"), F.length("name"))
    near = nearest_names(asked, names)
    near = near.withColumn("similarity", F.round(1 - F.col("d") / longest, 6))
    return first_by(near, ["symbol"], [F.col("similarity").desc(), "name"]).select("symbol", "name", "similarity")


def j21_similar_notes(spark: SparkSession, sf: str) -> DataFrame:
    """For every twentieth note: how many other notes of its symbol have a lesson of Jaccard 0.4 or more. Equal lessons are compared once."""
    n = W.note(spark, sf).where("symbol IS NOT NULL").select("note_key", "symbol", X.lexical_tokens(F.col("lesson")).alias("t"))
    groups = n.groupBy("symbol", F.array_sort("t").alias("t")).agg(F.count(F.lit(1)).alias("n"))
    asked = n.where("note_key % 20 = 0").select("note_key", "symbol", F.array_sort("t").alias("q"))
    met = asked.join(groups, "symbol").where(X.jaccard(F.col("q"), F.col("t")) >= 0.4)
    return met.groupBy("note_key").agg((F.sum("n") - 1).alias("similar"))


def j22_inbox_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    """For every twentieth pending item the approved item of its kind and area it repeats: the same text, else the first of highest Jaccard of 0.7 or more."""
    i = W.inb(spark, sf).select("item_key", "kind", "area", "status", F.lower(F.trim("text")).alias("plain"), X.lexical_tokens(F.col("text")).alias("t"))
    asked = i.where("status = 'pending' AND item_key % 20 = 0")
    had = i.where("status = 'approved'").select(F.col("item_key").alias("other"), F.col("kind").alias("k"), F.col("area").alias("a"), F.col("plain").alias("p"), F.col("t").alias("u"))
    met = asked.join(had, (F.col("kind") == F.col("k")) & F.col("area").eqNullSafe(F.col("a")))
    score = F.when(F.col("plain") == F.col("p"), F.lit(1.0)).otherwise(X.jaccard(F.col("t"), F.col("u")))
    met = met.withColumns({"exact": (F.col("plain") == F.col("p")).cast("int"), "score": F.round(score, 6)}).where("exact = 1 OR score >= 0.7")
    return first_by(met, ["item_key"], [F.col("exact").desc(), F.col("score").desc(), "other"]).select("item_key", "other", "score", F.when(F.col("exact") == 1, "exact").otherwise("near").alias("match"))


def j21_all_similar_notes(spark: SparkSession, sf: str) -> DataFrame:
    """For every note of a symbol: how many other notes of it have a lesson of Jaccard 0.4 or more; 0 where none has. Equal lessons are compared once."""
    n = kept(W.note(spark, sf).where("symbol IS NOT NULL").select("note_key", "symbol", F.array_join(F.array_sort(X.lexical_tokens(F.col("lesson"))), " ").alias("t")))
    groups = kept(n.groupBy("symbol", "t").agg(F.count(F.lit(1)).alias("n"), F.min("note_key").alias("id")))
    sets = groups.where("t <> ''").select(F.col("symbol").alias("keys"), "t", "id", "n")
    met = similar_sets(sets, sets, 0.4).select(F.col("a").alias("id"), "others")
    one, two = (c.alias(name) for c, name in zip(fingerprint("t"), ("t1", "t2")))
    counts = groups.select("id", "symbol", one, two).join(met.hint("merge"), "id", "left").select("symbol", "t1", "t2", (F.coalesce("others", F.lit(1)) - 1).alias("similar"))
    return n.select("note_key", "symbol", one, two).join(counts.hint("merge"), ["symbol", "t1", "t2"]).select("note_key", "similar")


def j22_all_inbox_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    """For every pending item the approved item of its kind and area it repeats: the same text, else the first of highest Jaccard of 0.7 or more. Equal texts are compared once."""
    one, two = (F.when(F.col("text").isNotNull(), c).alias(name) for c, name in zip(fingerprint(F.lower(F.trim("text"))), ("p1", "p2")))
    i = W.inb(spark, sf).where("status IN ('pending', 'approved') AND kind IS NOT NULL")
    i = cut(i.select("item_key", F.to_json(F.struct("kind", "area")).alias("keys"), "status", one, two, F.array_join(F.array_sort(X.lexical_tokens(F.col("text"))), " ").alias("t")))
    had = i.where("status = 'approved'")
    first = had.groupBy("keys", "p1", "p2").agg(F.min("item_key").alias("other"))
    asked = i.where("status = 'pending'").join(first.hint("merge"), ["keys", "p1", "p2"], "left").select("item_key", "keys", "t", "other")
    exact = asked.where("other IS NOT NULL").select("item_key", "other", F.lit(1.0).alias("score"), F.lit("exact").alias("match"))
    rest = asked.where("other IS NULL").drop("other")
    sets = lambda d: cut(d.where("t <> ''").groupBy("keys", "t").agg(F.min("item_key").alias("id"), F.count(F.lit(1)).alias("n")))
    own = sets(rest)
    best = similar_sets(own, sets(had), 0.7, best=True).select(F.col("a").alias("id"), "other", F.round(F.col("common") / F.col("every"), 6).alias("score"))
    near = own.select("id", "keys", "t").join(best.hint("merge"), "id").hint("merge").join(rest, ["keys", "t"]).select("item_key", "other", "score", F.lit("near").alias("match"))
    return exact.unionByName(near)


_NUMBER = r"(\$?[0-9]{1,3}(?:[,_]?[0-9]{3})*(?:\.[0-9]+)?%?)"


def j23_conflicts(spark: SparkSession, sf: str) -> DataFrame:
    """High notes against issues of the same symbol: two or more topic words in common and no number in common (also k4, x28)."""
    words = lambda c: X.lexical_tokens(F.col(c), X.TOPIC_STOP, 3, keep_underscore=False)
    numbers = lambda c: F.array_distinct(F.regexp_extract_all(F.col(c), F.lit(_NUMBER), 1))
    n = W.note(spark, sf).where("severity = 'high' AND symbol IS NOT NULL AND lesson IS NOT NULL").select("note_key", "symbol", words("lesson").alias("w"), numbers("lesson").alias("x")).where(F.size("x") > 0)
    i = W.iss(spark, sf).where("symbol IS NOT NULL AND summary IS NOT NULL").select("issue_key", "symbol", words("summary").alias("v"), numbers("summary").alias("y")).where(F.size("y") > 0)
    met = n.join(i, "symbol").where((F.size(F.array_intersect("w", "v")) >= 2) & ~F.arrays_overlap("x", "y"))
    return met.groupBy("note_key").agg(F.count(F.lit(1)).alias("conflicts"))


def j24_changed_since(spark: SparkSession, sf: str) -> DataFrame:
    """Stale entries whose file has, among its last ten commits, one after they were listed."""
    last = top_by(W.file_commits(spark, sf), ["file"], [F.col("at").desc(), "commit"], 10)
    newest = last.groupBy("file").agg(F.max("at").alias("changed"))
    return W.stale(spark, sf).join(newest, "file").where("changed > listed_at").select("entry_key")


_PAT = """
, pat AS (SELECT issue_key, severity, CASE severity WHEN 'warn' THEN substr(bare, 1, 6) || '*' WHEN 'block' THEN '*' || right(bare, 6) ELSE symbol END AS pattern FROM (SELECT *, regexp_extract(symbol, '([A-Za-z0-9_]+)(?:@[0-9a-f]+)?$', 1) AS bare FROM iss WHERE kind = 'promotion_candidate' AND symbol IS NOT NULL)),
s AS (SELECT id, coalesce(qualified_name, name) AS q FROM sym WHERE coalesce(qualified_name, name) IS NOT NULL)"""
_AREAS = ", areas AS (SELECT rtrim(symbol, '/') AS area, note_key FROM note WHERE scope = 'area' AND symbol IS NOT NULL), files AS (SELECT DISTINCT file FROM sym WHERE file IS NOT NULL)"
_RANGES = """
, h AS (SELECT edge_key, file, line AS lo, line + 2 AS hi FROM edges WHERE file IS NOT NULL AND line IS NOT NULL),
r AS (SELECT symbol_key, file, CASE WHEN end_line IS NULL THEN line - 1 ELSE line END AS lo, coalesce(end_line, line + 1) AS hi FROM sym WHERE file IS NOT NULL AND line IS NOT NULL),
met AS (SELECT edge_key, symbol_key FROM h JOIN r ON h.file = r.file AND h.lo <= r.hi AND r.lo <= h.hi)"""
_MISSING = ", known AS (SELECT lower(id) AS k FROM sym UNION SELECT lower(qualified_name) FROM sym WHERE qualified_name IS NOT NULL UNION SELECT lower(name) FROM sym WHERE name IS NOT NULL), missing AS (SELECT note_key, symbol FROM note WHERE scope = 'symbol' AND symbol IS NOT NULL AND lower(symbol) NOT IN (SELECT k FROM known))"

QUERIES = {f.__name__: f for f in (j5_pattern_hits, j6_anchored_notes, j7_area_notes, j8_hunk_overlap, j9_uncovered_hunks, j10_deepest_area, j11_asof_note, j12_feature_overlap, j13_feature_isolate, j14_feature_diff, j15_test_coverage, j16_test_gaps, j17_uncovered_issues, j18_waived_rules, j19_missing_anchor, j20_nearest_anchor, j21_similar_notes, j21_all_similar_notes, j22_inbox_duplicates, j22_all_inbox_duplicates, j23_conflicts, j24_changed_since)}
SQL = {
    "j5_pattern_hits": W.sql(_PAT + """
SELECT issue_key, severity, count(*) AS hits FROM pat JOIN s ON CASE WHEN pattern LIKE '%*' THEN starts_with(q, substr(pattern, 1, length(pattern) - 1)) WHEN pattern LIKE '*%' THEN suffix(q, substr(pattern, 2)) ELSE q = pattern OR suffix(q, '.' || pattern) OR suffix(q, '/' || pattern) END GROUP BY ALL"""),
    "j6_anchored_notes": W.sql("SELECT s.id, count(DISTINCT n.note_key) AS notes FROM sym s JOIN note n ON n.scope = 'symbol' AND (n.symbol = s.name OR n.symbol = s.qualified_name) GROUP BY s.id"),
    "j7_area_notes": W.sql(_AREAS + " SELECT file, count(*) AS notes FROM files JOIN areas ON starts_with(file, area || '/') GROUP BY file"),
    "j10_deepest_area": W.sql(_AREAS + " SELECT file, arg_max(area, length(area)) AS area FROM files JOIN areas ON starts_with(file, area || '/') GROUP BY file"),
    "j8_hunk_overlap": W.sql(_RANGES + " SELECT symbol_key, count(*) AS hunks FROM met GROUP BY symbol_key"),
    "j9_uncovered_hunks": W.sql(_RANGES + " SELECT file, count(*) AS gaps FROM h WHERE edge_key NOT IN (SELECT edge_key FROM met) GROUP BY file"),
    "j11_asof_note": W.sql("SELECT issue_key, arg_max(note_key, (recorded_at, note_key)) AS note_key FROM iss i JOIN note n ON n.symbol = i.symbol AND n.recorded_at <= i.raised_at GROUP BY issue_key"),
    "j12_feature_overlap": W.sql("SELECT a.id, a.label AS a, b.label AS b, round(a.weight * b.weight, 6) AS strength FROM weights a JOIN weights b ON a.id = b.id AND a.label < b.label WHERE a.weight >= 0.2::DOUBLE AND b.weight >= 0.2::DOUBLE"),
    "j13_feature_isolate": W.sql("SELECT label, id FROM weights w WHERE NOT EXISTS (SELECT 1 FROM weights o WHERE o.id = w.id AND o.label <> w.label AND o.weight >= 0.1::DOUBLE)"),
    "j14_feature_diff": W.sql(f"""
, o AS ({W.sql_ranked("touches WHERE ts <= TIMESTAMP '2026-04-01'")}), c AS ({W.sql_ranked("touches")})
SELECT * FROM (SELECT coalesce(o.label, c.label) AS label, coalesce(o.id, c.id) AS id, CASE WHEN o.weight IS NULL THEN 'entered' WHEN c.weight IS NULL THEN 'left' WHEN abs(c.weight - o.weight) > 0.05::DOUBLE THEN 'weight' END AS change, round(o.weight, 6) AS weight_then, round(c.weight, 6) AS weight_now FROM o FULL JOIN c ON o.label = c.label AND o.id = c.id) WHERE change IS NOT NULL"""),
    "j15_test_coverage": W.sql("""
, said AS (SELECT DISTINCT seq, exit, unnest(list_concat(coalesce(symbols, []), regexp_extract_all(coalesce(message, ''), '[A-Za-z_$][A-Za-z0-9_$]*'))) AS name FROM runs), r AS (SELECT s.id, count(DISTINCT seq) AS runs, count(DISTINCT CASE WHEN exit <> 0 THEN seq END) AS failing FROM sym s JOIN said USING (name) GROUP BY s.id),
st AS (SELECT DISTINCT file, regexp_replace(file, '\\.[jt]sx?$|\\.py$', '') AS stem FROM sym WHERE file IS NOT NULL),
b AS (SELECT file FROM st WHERE EXISTS (SELECT 1 FROM st o WHERE o.file IN (stem || '.test.ts', stem || '.test.tsx', stem || '.test.js', stem || '.spec.ts', stem || '.spec.js', stem || '_test.py', regexp_extract(st.file, '^(.*/)?[^/]*$', 1) || 'test_' || regexp_extract(stem, '([^/]*)$', 1) || '.py')))
SELECT s.id, coalesce(runs, 0) AS runs, coalesce(failing, 0) AS failing, s.file IS NOT NULL AND s.file IN (SELECT file FROM b) AS beside FROM sym s LEFT JOIN r ON r.id = s.id WHERE runs IS NOT NULL OR s.file IN (SELECT file FROM b)"""),
    "j16_test_gaps": W.sql("""
, tested AS (SELECT DISTINCT unnest(symbols) AS name FROM runs), via AS (SELECT DISTINCT e.dst AS id FROM edg e JOIN sym s ON s.id = e.src WHERE s.name IN (SELECT name FROM tested))
SELECT id, CASE WHEN id IN (SELECT id FROM via) THEN 'by caller only' ELSE 'no test' END AS reason FROM sym WHERE name NOT IN (SELECT name FROM tested WHERE name IS NOT NULL) AND id IN (SELECT dst FROM edg)"""),
    "j17_uncovered_issues": W.sql("SELECT issue_key FROM iss WHERE symbol IS NOT NULL AND symbol NOT IN (SELECT symbol FROM note WHERE symbol IS NOT NULL)"),
    "j18_waived_rules": W.sql("SELECT name, severity, item_key IS NOT NULL AS waived, item_key FROM rules LEFT JOIN waivers ON invariant = name"),
    "j19_missing_anchor": W.sql(_MISSING + " SELECT note_key, symbol FROM missing"),
    "j20_nearest_anchor": W.sql(_MISSING + """
, pairs AS (SELECT symbol, name, levenshtein(symbol, name) AS d, greatest(length(symbol), length(name)) AS m FROM (SELECT DISTINCT symbol FROM missing WHERE length(symbol) >= 4) JOIN (SELECT DISTINCT name FROM sym WHERE length(name) >= 4) ON abs(length(symbol) - length(name)) <= 0.4 * greatest(length(symbol), length(name)))
SELECT symbol, name, round(1 - d::DOUBLE / m, 6) AS similarity FROM pairs WHERE d <= floor(m * 0.4 + 1e-9) QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY round(1 - d::DOUBLE / m, 6) DESC, name) = 1"""),
    "j21_similar_notes": W.sql(f"""
, n AS (SELECT note_key, symbol, {X.sql_lexical('lesson')} AS t FROM note WHERE symbol IS NOT NULL)
SELECT q.note_key, count(*) - 1 AS similar FROM n q JOIN n USING (symbol) WHERE q.note_key % 20 = 0 AND {X.sql_jaccard('q.t', 'n.t')} >= 0.4::DOUBLE GROUP BY q.note_key"""),
    "j22_inbox_duplicates": W.sql(f"""
, i AS (SELECT item_key, kind, area, status, lower(trim(text)) AS plain, {X.sql_lexical('text')} AS t FROM inb),
m AS (SELECT q.item_key, o.item_key AS other, (q.plain = o.plain)::INT AS exact, round(CASE WHEN q.plain = o.plain THEN 1.0::DOUBLE ELSE {X.sql_jaccard('q.t', 'o.t')} END, 6) AS score FROM i q JOIN i o ON q.kind = o.kind AND q.area IS NOT DISTINCT FROM o.area WHERE q.status = 'pending' AND q.item_key % 20 = 0 AND o.status = 'approved')
SELECT item_key, other, score, CASE WHEN exact = 1 THEN 'exact' ELSE 'near' END AS match FROM m WHERE exact = 1 OR score >= 0.7 QUALIFY row_number() OVER (PARTITION BY item_key ORDER BY exact DESC, score DESC, other) = 1"""),
    "j23_conflicts": W.sql(f"""
, n AS (SELECT note_key, symbol, {X.sql_lexical('lesson', X.TOPIC_STOP, 3, False)} AS w, regexp_extract_all(lesson, '{_NUMBER}', 1) AS x FROM note WHERE severity = 'high' AND symbol IS NOT NULL AND lesson IS NOT NULL),
i AS (SELECT issue_key, symbol, {X.sql_lexical('summary', X.TOPIC_STOP, 3, False)} AS v, regexp_extract_all(summary, '{_NUMBER}', 1) AS y FROM iss WHERE symbol IS NOT NULL AND summary IS NOT NULL)
SELECT note_key, count(*) AS conflicts FROM n JOIN i USING (symbol) WHERE len(x) > 0 AND len(y) > 0 AND len(list_intersect(w, v)) >= 2 AND NOT list_has_any(x, y) GROUP BY note_key"""),
    "j24_changed_since": W.sql("""SELECT entry_key FROM stale_entries e WHERE EXISTS (SELECT 1 FROM (SELECT file, "at" FROM file_commits QUALIFY row_number() OVER (PARTITION BY file ORDER BY "at" DESC, commit) <= 10) c WHERE c.file = e.file AND c."at" > e.listed_at)"""),
}
