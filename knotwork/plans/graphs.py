"""Graph queries: resolution, callers, closures, degrees and risk."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import closure, degrees
from ..operators.ranking import severity_rank, top_by
from ..session import cut
from ..sources.tables import table
from . import warehouse as W


def j1_resolve(spark: SparkSession, sf: str) -> DataFrame:
    """Issue symbols resolved to symbol ids: by id, else qualified name, else name, else lower-cased name; the smallest key wins."""
    s = W.sym(spark, sf)
    keys = F.explode(F.array(*(F.struct(F.lit(i).alias("tier"), k.alias("key")) for i, k in enumerate((F.col("id"), F.col("qualified_name"), F.col("name"), F.lower("name")), 1))))
    ways = s.select("id", "symbol_key", keys.alias("k")).select("id", "symbol_key", "k.tier", "k.key").where("key IS NOT NULL").groupBy("tier", "key").agg(F.min_by("id", "symbol_key").alias("id"))
    asked = W.iss(spark, sf).where("symbol IS NOT NULL").select("issue_key", "symbol")
    probes = F.explode(F.array(*(F.struct(F.lit(i).alias("tier"), (F.lower("symbol") if i == 4 else F.col("symbol")).alias("key")) for i in (1, 2, 3, 4))))
    hits = asked.select("issue_key", probes.alias("p")).select("issue_key", "p.tier", "p.key").join(ways, ["tier", "key"])
    return hits.groupBy("issue_key").agg(F.min_by("id", "tier").alias("id"), F.min("tier").alias("tier"))


def j2_callers(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct callers of every symbol, with their names."""
    s = W.sym(spark, sf).select(F.col("id").alias("src"), F.col("name").alias("caller"), "file")
    return W.edg(spark, sf).join(s, "src").select(F.col("dst").alias("id"), F.col("src").alias("caller_id"), "caller", "file")


def j2_callees(spark: SparkSession, sf: str) -> DataFrame:
    """Number of distinct callees, and of those that are indexed, of every caller."""
    s = W.sym(spark, sf).select(F.col("id").alias("dst"), F.lit(1).alias("known"))
    return W.edg(spark, sf).join(s, "dst", "left").groupBy("src").agg(F.count(F.lit(1)).alias("callees"), F.count("known").alias("indexed"))


def j4_edge_targets(spark: SparkSession, sf: str) -> DataFrame:
    """Edges resolved anew by target name: qualified name, else the only symbol of that name in the file, else the only one at all."""
    s = W.sym(spark, sf).select("id", "name", "qualified_name", "file", "symbol_key")
    e = table(spark, sf, "edges", "edge_key", "to_name", "file").where("to_name IS NOT NULL")
    qualified = s.where("qualified_name IS NOT NULL").groupBy(F.col("qualified_name").alias("to_name")).agg(F.min_by("id", "symbol_key").alias("q"))
    local = s.where("file IS NOT NULL").groupBy(F.col("name").alias("to_name"), "file").agg(F.when(F.count(F.lit(1)) == 1, F.min("id")).alias("l"))
    unique = s.groupBy(F.col("name").alias("to_name")).agg(F.when(F.count(F.lit(1)) == 1, F.min("id")).alias("u"))
    met = e.join(qualified, "to_name", "left").join(local, ["to_name", "file"], "left").join(unique, "to_name", "left")
    how = F.when(F.col("q").isNotNull(), "qualified").when(F.col("l").isNotNull(), "same-file").when(F.col("u").isNotNull(), "unique")
    return met.select("edge_key", F.coalesce("q", "l", "u").alias("id"), how.alias("how")).where("id IS NOT NULL")


def _seeds(spark: SparkSession, sf: str) -> DataFrame:
    """Ids of symbols that a conflict issue names by id."""
    return W.iss(spark, sf).where("kind = 'conflict'").select(F.col("symbol").alias("id")).join(W.sym(spark, sf).select("id"), "id", "left_semi").distinct()


def g1_reverse_closure(spark: SparkSession, sf: str) -> DataFrame:
    """Who calls the symbols in conflict, over up to three hops."""
    return closure(W.edg(spark, sf), _seeds(spark, sf), 3)


def g2_impact(spark: SparkSession, sf: str) -> DataFrame:
    """Files that the closure of the symbols in conflict reaches, with symbols and least distance."""
    near = closure(W.edg(spark, sf), _seeds(spark, sf), 2)
    return near.join(W.sym(spark, sf).select("id", "file"), "id").where("file IS NOT NULL").groupBy("file").agg(F.count(F.lit(1)).alias("symbols"), F.min("depth").alias("depth"))


def g3_neighborhood(spark: SparkSession, sf: str) -> DataFrame:
    """Callees of the symbols in conflict over two hops, with up to three notes at the first and two at the second (also w4)."""
    near = closure(W.edg(spark, sf), _seeds(spark, sf), 2, reverse=False)
    n = W.note(spark, sf).where("scope = 'symbol' AND NOT coalesce(promoted, false)").select(F.col("symbol").alias("id"), "note_key", severity_rank("severity").alias("rank"), "recorded_at")
    ranked = top_by(near.join(n, "id"), ["id"], [F.col("rank").desc(), F.col("recorded_at").desc_nulls_last(), "note_key"], 3, "position")
    return ranked.where(F.col("position") <= 4 - F.col("depth")).select("id", "depth", "note_key", "position")


def g4_tiered_relation(spark: SparkSession, sf: str) -> DataFrame:
    """Notes on the symbols in conflict (direct), on their callers (transitive) and callees (dependency): each note once, by its nearest relation."""
    seeds, e = cut(_seeds(spark, sf)), cut(W.edg(spark, sf))  # read by both closures
    tiers = seeds.withColumn("tier", F.lit(1)).unionByName(closure(e, seeds, 2, once=False).select("id", F.lit(2).alias("tier"))).unionByName(closure(e, seeds, 1, reverse=False).select("id", F.lit(3).alias("tier")))
    n = W.note(spark, sf).where("scope = 'symbol'").select(F.col("symbol").alias("id"), "note_key")
    best = tiers.join(n, "id").groupBy("note_key").agg(F.min("tier").alias("tier"))
    return best.select("note_key", F.element_at(F.array(F.lit("direct"), F.lit("transitive"), F.lit("dependency")), F.col("tier")).alias("relation"))


def g5_expansion(spark: SparkSession, sf: str) -> DataFrame:
    """One hop around the symbols that high notes are anchored to: up to five callers and five callees each."""
    anchors = W.note(spark, sf).where("scope = 'symbol' AND severity = 'high'").select(F.col("symbol").alias("id")).distinct()
    e = W.edg(spark, sf)
    callers = top_by(e.join(anchors, F.col("dst") == F.col("id"), "left_semi").select(F.col("dst").alias("id"), F.lit("caller").alias("relation"), F.col("src").alias("related")), ["id"], ["related"], 5)
    callees = top_by(e.join(anchors, F.col("src") == F.col("id"), "left_semi").select(F.col("src").alias("id"), F.lit("callee").alias("relation"), F.col("dst").alias("related")), ["id"], ["related"], 5)
    return callers.unionByName(callees)


def g6_memory_graph(spark: SparkSession, sf: str) -> DataFrame:
    """Edges of the memory graph by kind. Members of one anchor are tied to its first member, not to each other: a star, not a clique."""
    n = W.note(spark, sf).where("symbol IS NOT NULL").select("note_key", "symbol", "scope")
    i = W.iss(spark, sf).where("symbol IS NOT NULL").select("issue_key", "symbol")
    first = n.groupBy("symbol").agg(F.min("note_key").alias("head"))
    star = n.join(first, "symbol").where("note_key <> head").select(F.lit("same_anchor").alias("kind"), F.col("head").cast("string").alias("a"), F.col("note_key").cast("string").alias("b"))
    parts = [
        n.select(F.lit("anchor").alias("kind"), F.col("note_key").cast("string").alias("a"), F.col("symbol").alias("b")),
        i.select(F.lit("issue").alias("kind"), F.col("issue_key").cast("string").alias("a"), F.col("symbol").alias("b")),
        W.edg(spark, sf).select(F.lit("calls").alias("kind"), F.col("src").alias("a"), F.col("dst").alias("b")),
        star,
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("kind").agg(F.count(F.lit(1)).alias("edges"), F.count_distinct("a").alias("sources"), F.count_distinct("b").alias("targets"))


def g7_graph_issues(spark: SparkSession, sf: str) -> DataFrame:
    """Issues of the graph in one list: those reported, and notes whose symbol is not indexed (orphan) or that have expired (stale)."""
    n = W.note(spark, sf).where("scope = 'symbol' AND symbol IS NOT NULL")
    s = W.sym(spark, sf)
    known = s.select(F.explode(F.array("id", "qualified_name", "name")).alias("symbol")).dropna().distinct()
    orphan = n.join(known, "symbol", "left_anti").select(F.lit("orphan").alias("kind"), "symbol", F.col("note_key").alias("ref"))
    gone = n.where(F.try_to_timestamp("expires_at") < F.lit("2026-07-01").cast("timestamp")).select(F.lit("expired").alias("kind"), "symbol", F.col("note_key").alias("ref"))
    told = W.iss(spark, sf).select("kind", "symbol", F.col("issue_key").alias("ref"))
    return told.unionByName(orphan).unionByName(gone).groupBy("kind").agg(F.count(F.lit(1)).alias("issues"), F.count_distinct("symbol").alias("symbols"))


def g8_resolution_signals(spark: SparkSession, sf: str) -> DataFrame:
    """For symbols nobody calls: up to five called symbols of the same name that may have been meant."""
    s = W.sym(spark, sf).select("id", "name", "symbol_key").join(degrees(W.edg(spark, sf)).select("id", "fan_in"), "id", "left").withColumn("fan_in", F.coalesce("fan_in", F.lit(0)))
    called = top_by(s.where("fan_in > 0"), ["name"], [F.col("fan_in").desc(), "symbol_key"], 5, "position").select("name", F.col("id").alias("meant"), "fan_in", "position")
    return s.where("fan_in = 0").select("id", "name").join(called, "name").select("id", "meant", F.col("fan_in").cast("bigint").alias("fan_in"), "position")


def g9_risk_class(spark: SparkSession, sf: str) -> DataFrame:
    """Risk class of each symbol by callers and high notes."""
    s = W.sym(spark, sf).select("id").join(degrees(W.edg(spark, sf)), "id", "left")
    high = W.note(spark, sf).where("severity = 'high' AND symbol IS NOT NULL").groupBy(F.col("symbol").alias("id")).agg(F.count(F.lit(1)).alias("high_notes"))
    s = s.join(high, "id", "left").select("id", F.coalesce("fan_in", F.lit(0)).cast("bigint").alias("callers"), F.coalesce("high_notes", F.lit(0)).alias("high_notes"))
    risk = F.when((F.col("callers") >= 10) | (F.col("high_notes") > 0), "high").when(F.col("callers") >= 3, "medium").otherwise("low")
    return s.withColumn("risk", risk)


def g10_central_symbols(spark: SparkSession, sf: str) -> DataFrame:
    """The eight central symbols: most issues, then notes, then degree (also t9, a15)."""
    s = W.sym(spark, sf).select("id", "name")
    notes = W.note(spark, sf).where("symbol IS NOT NULL").groupBy(F.col("symbol").alias("id")).agg(F.count(F.lit(1)).alias("memory"))
    issues = W.iss(spark, sf).where("symbol IS NOT NULL").groupBy(F.col("symbol").alias("id")).agg(F.count(F.lit(1)).alias("issues"))
    d = degrees(W.edg(spark, sf)).select("id", (F.col("fan_in") + F.col("fan_out")).alias("degree"))
    out = s.join(issues, "id", "left").join(notes, "id", "left").join(d, "id", "left").fillna(0, ["issues", "memory", "degree"])
    return out.select("id", "name", "issues", "memory", F.col("degree").cast("bigint").alias("degree")).orderBy(F.desc("issues"), F.desc("memory"), F.desc("degree"), "name", "id").limit(8)


def a5_blast_radius(spark: SparkSession, sf: str) -> DataFrame:
    """Direct callers and the distinct files they stand in, for every called symbol."""
    s = W.sym(spark, sf).select(F.col("id").alias("src"), "file")
    return W.edg(spark, sf).join(s, "src", "left").groupBy("dst").agg(F.count(F.lit(1)).alias("callers"), F.count_distinct("file").alias("files"))


def u1_closure_union(spark: SparkSession, sf: str) -> DataFrame:
    """Union of callers within two hops and callees within one of the symbols in conflict, without them."""
    seeds, e = cut(_seeds(spark, sf)), cut(W.edg(spark, sf))  # read by both closures
    both = closure(e, seeds, 2, once=False).select("id").unionByName(closure(e, seeds, 1, reverse=False).select("id")).distinct()
    return both.join(seeds, "id", "left_anti")


_SEED = ", seed AS (SELECT DISTINCT symbol AS id FROM iss WHERE kind = 'conflict' AND symbol IN (SELECT id FROM sym))"
_UP = ", up AS (SELECT id, 0 AS depth FROM seed UNION SELECT e.src, u.depth + 1 FROM up u JOIN edg e ON e.dst = u.id WHERE u.depth < 3), near AS (SELECT id, min(depth) AS depth FROM up GROUP BY id HAVING min(depth) > 0)"
_DOWN = ", down AS (SELECT id, 0 AS depth FROM seed UNION SELECT e.dst, u.depth + 1 FROM down u JOIN edg e ON e.src = u.id WHERE u.depth < 2), below AS (SELECT id, min(depth) AS depth FROM down GROUP BY id HAVING min(depth) > 0)"
_DEG = ", deg AS (SELECT id, sum(i)::BIGINT AS fan_in, sum(o)::BIGINT AS fan_out FROM (SELECT dst AS id, 1 AS i, 0 AS o FROM edg UNION ALL SELECT src, 0, 1 FROM edg) GROUP BY id)"
_SEV = "CASE severity WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END"

QUERIES = {f.__name__: f for f in (j1_resolve, j2_callers, j2_callees, j4_edge_targets, g1_reverse_closure, g2_impact, g3_neighborhood, g4_tiered_relation, g5_expansion, g6_memory_graph, g7_graph_issues, g8_resolution_signals, g9_risk_class, g10_central_symbols, a5_blast_radius, u1_closure_union)}
SQL = {
    "j1_resolve": W.sql("""
, ways AS (SELECT tier, key, arg_min(id, symbol_key) AS id FROM (SELECT 1 AS tier, id AS key, id, symbol_key FROM sym UNION ALL SELECT 2, qualified_name, id, symbol_key FROM sym UNION ALL SELECT 3, name, id, symbol_key FROM sym UNION ALL SELECT 4, lower(name), id, symbol_key FROM sym) WHERE key IS NOT NULL GROUP BY tier, key)
SELECT issue_key, arg_min(id, tier) AS id, min(tier) AS tier FROM iss JOIN ways ON ways.key = CASE WHEN ways.tier = 4 THEN lower(symbol) ELSE symbol END WHERE symbol IS NOT NULL GROUP BY issue_key"""),
    "j2_callers": W.sql("SELECT e.dst AS id, e.src AS caller_id, s.name AS caller, s.file FROM edg e JOIN sym s ON s.id = e.src"),
    "j2_callees": W.sql("SELECT e.src, count(*) AS callees, count(s.id) AS indexed FROM edg e LEFT JOIN sym s ON s.id = e.dst GROUP BY e.src"),
    "j4_edge_targets": W.sql("""
, q AS (SELECT qualified_name AS n, arg_min(id, symbol_key) AS id FROM sym WHERE qualified_name IS NOT NULL GROUP BY 1),
l AS (SELECT name AS n, file, min(id) AS id FROM sym WHERE file IS NOT NULL GROUP BY 1, 2 HAVING count(*) = 1), u AS (SELECT name AS n, min(id) AS id FROM sym GROUP BY 1 HAVING count(*) = 1)
SELECT * FROM (SELECT edge_key, coalesce(q.id, l.id, u.id) AS id, CASE WHEN q.id IS NOT NULL THEN 'qualified' WHEN l.id IS NOT NULL THEN 'same-file' WHEN u.id IS NOT NULL THEN 'unique' END AS how
FROM edges e LEFT JOIN q ON q.n = e.to_name LEFT JOIN l ON l.n = e.to_name AND l.file = e.file LEFT JOIN u ON u.n = e.to_name WHERE e.to_name IS NOT NULL) WHERE id IS NOT NULL"""),
    "g1_reverse_closure": W.sql(_SEED + _UP + " SELECT id, depth FROM near"),
    "g2_impact": W.sql(_SEED + _UP + " SELECT file, count(*) AS symbols, min(depth) AS depth FROM near JOIN sym USING (id) WHERE depth <= 2 AND file IS NOT NULL GROUP BY file"),
    "g3_neighborhood": W.sql(_SEED + _DOWN + f" SELECT id, depth, note_key, position FROM (SELECT b.id, b.depth, n.note_key, row_number() OVER (PARTITION BY b.id ORDER BY {_SEV} DESC, recorded_at DESC NULLS LAST, note_key) AS position FROM below b JOIN note n ON n.symbol = b.id WHERE n.scope = 'symbol' AND NOT coalesce(n.promoted, false)) WHERE position <= 4 - depth"),
    "g4_tiered_relation": W.sql(_SEED + _UP + _DOWN + " SELECT note_key, ['direct', 'transitive', 'dependency'][min(tier)] AS relation FROM (SELECT id, 1 AS tier FROM seed UNION ALL SELECT id, 2 FROM near WHERE depth <= 2 UNION ALL SELECT id, 3 FROM below WHERE depth = 1) t JOIN note n ON n.symbol = t.id WHERE n.scope = 'symbol' GROUP BY note_key"),
    "g5_expansion": W.sql("""
, anchors AS (SELECT DISTINCT symbol AS id FROM note WHERE scope = 'symbol' AND severity = 'high' AND symbol IS NOT NULL)
SELECT id, relation, related FROM (SELECT dst AS id, 'caller' AS relation, src AS related FROM edg WHERE dst IN (SELECT id FROM anchors) UNION ALL SELECT src, 'callee', dst FROM edg WHERE src IN (SELECT id FROM anchors)) QUALIFY row_number() OVER (PARTITION BY id, relation ORDER BY related) <= 5"""),
    "g6_memory_graph": W.sql("""
, head AS (SELECT symbol, min(note_key) AS head FROM note WHERE symbol IS NOT NULL GROUP BY symbol),
all_edges AS (SELECT 'anchor' AS kind, note_key::VARCHAR AS a, symbol AS b FROM note WHERE symbol IS NOT NULL UNION ALL SELECT 'issue', issue_key::VARCHAR, symbol FROM iss WHERE symbol IS NOT NULL UNION ALL SELECT 'calls', src, dst FROM edg
 UNION ALL SELECT 'same_anchor', head::VARCHAR, note_key::VARCHAR FROM note JOIN head USING (symbol) WHERE note_key <> head)
SELECT kind, count(*) AS edges, count(DISTINCT a) AS sources, count(DISTINCT b) AS targets FROM all_edges GROUP BY kind"""),
    "g7_graph_issues": W.sql("""
, n AS (SELECT * FROM note WHERE scope = 'symbol' AND symbol IS NOT NULL), known AS (SELECT id AS k FROM sym UNION SELECT qualified_name FROM sym WHERE qualified_name IS NOT NULL UNION SELECT name FROM sym WHERE name IS NOT NULL)
SELECT kind, count(*) AS issues, count(DISTINCT symbol) AS symbols FROM (SELECT kind, symbol FROM iss UNION ALL SELECT 'orphan', symbol FROM n WHERE symbol NOT IN (SELECT k FROM known) UNION ALL SELECT 'expired', symbol FROM n WHERE try_cast(expires_at AS TIMESTAMP) < TIMESTAMP '2026-07-01') GROUP BY kind"""),
    "g8_resolution_signals": W.sql(_DEG + """
, s AS (SELECT id, name, symbol_key, coalesce(fan_in, 0) AS fan_in FROM sym LEFT JOIN deg USING (id)), c AS (SELECT name, id AS meant, fan_in, row_number() OVER (PARTITION BY name ORDER BY fan_in DESC, symbol_key) AS position FROM s WHERE fan_in > 0)
SELECT s.id, c.meant, c.fan_in, c.position FROM s JOIN c USING (name) WHERE s.fan_in = 0 AND c.position <= 5"""),
    "g9_risk_class": W.sql(_DEG + """
, h AS (SELECT symbol AS id, count(*) AS high_notes FROM note WHERE severity = 'high' AND symbol IS NOT NULL GROUP BY 1), r AS (SELECT id, coalesce(fan_in, 0) AS callers, coalesce(high_notes, 0) AS high_notes FROM sym LEFT JOIN deg USING (id) LEFT JOIN h USING (id))
SELECT *, CASE WHEN callers >= 10 OR high_notes > 0 THEN 'high' WHEN callers >= 3 THEN 'medium' ELSE 'low' END AS risk FROM r"""),
    "g10_central_symbols": W.sql(_DEG + """
, n AS (SELECT symbol AS id, count(*) AS memory FROM note WHERE symbol IS NOT NULL GROUP BY 1), i AS (SELECT symbol AS id, count(*) AS issues FROM iss WHERE symbol IS NOT NULL GROUP BY 1)
SELECT id, name, coalesce(issues, 0) AS issues, coalesce(memory, 0) AS memory, coalesce(fan_in + fan_out, 0) AS degree FROM sym LEFT JOIN i USING (id) LEFT JOIN n USING (id) LEFT JOIN deg USING (id) ORDER BY issues DESC, memory DESC, degree DESC, name, id LIMIT 8"""),
    "a5_blast_radius": W.sql("SELECT e.dst, count(*) AS callers, count(DISTINCT s.file) AS files FROM edg e LEFT JOIN sym s ON s.id = e.src GROUP BY e.dst"),
    "u1_closure_union": W.sql(_SEED + _UP + _DOWN + " SELECT id FROM near WHERE depth <= 2 UNION SELECT id FROM below WHERE depth = 1"),
}
