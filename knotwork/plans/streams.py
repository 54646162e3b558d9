"""Stream queries: run over the files there now and read back, with SQL for the same events at rest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.patterns import pattern_matches
from ..sources.tables import table
from ..streaming import ops as S
from . import warehouse as W


def _events(spark: SparkSession, sf: str) -> DataFrame:
    return S.file_stream(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def _ntz(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in columns})


def r1_bursts(spark: SparkSession, sf: str) -> DataFrame:
    """Bursts of a user's events with no pause of an hour, each evaluated once when it has ended."""
    return _ntz(S.drain(S.bursts(_events(spark, sf), "user_id", "1 hour")), "start", "stop")


def r2_tail(spark: SparkSession, sf: str) -> DataFrame:
    """The last hundred runs after a cursor."""
    return W.runs(spark, sf).where("seq > 100").orderBy(F.desc("seq")).limit(100).select("seq", "source")


def r3_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Events per type and hour, for the hours that are over."""
    return _ntz(S.drain(S.counts(_events(spark, sf), ["event_type"])), "start", "last_ts")


def r4_failure_buffer(spark: SparkSession, sf: str) -> DataFrame:
    """How many of the last fifty errors of each user are held, and the last one."""
    failures = _events(spark, sf).where("event_type = 'error'").select("user_id", "ts", F.col("event_id").alias("seq"))
    out = S.drain(S.failure_buffer(failures, "user_id"), "update")
    return out.groupBy("user_id").agg(F.max("held").alias("held"), F.max_by("last_seq", "last_seq").alias("last_seq"))


def r5_weights(spark: SparkSession, sf: str) -> DataFrame:
    """Weights per event type and user folded over purchases (1) and other events (0.3)."""
    t = _events(spark, sf).where("event_type IN ('click', 'purchase')")
    t = t.select(F.lit("shop").alias("label"), F.col("user_id").cast("string").alias("id"), "ts", F.col("event_id").alias("seq"), F.when(F.col("event_type") == "purchase", 1.0).otherwise(0.3).alias("signal"))
    out = S.drain(S.folded_weights(t), "update")
    return out.groupBy("label", "id").agg(F.round(F.max_by("weight", "touches"), 6).alias("weight"), F.max("touches").alias("touches"))


def r7_first_seen(spark: SparkSession, sf: str) -> DataFrame:
    """Users seen, each once, by way of the stream's own state."""
    return S.drain(S.first_seen(_events(spark, sf).select("user_id", "event_type", "ts"), ["user_id", "event_type"])).select("user_id", "event_type")


def r8_hard_searches(spark: SparkSession, sf: str) -> DataFrame:
    """Months in which a user viewed eight times or more, with the last view and whether a purchase came."""
    e = table(spark, sf, "events", "user_id", "event_type", "ts", "event_id").withColumn("month", F.to_date(F.date_trunc("month", "ts")))
    view = F.col("event_type") == "view"
    g = e.groupBy("user_id", "month").agg(F.sum(view.cast("bigint")).alias("views"), F.max_by("event_id", F.when(view, F.col("ts"))).alias("last_view"), F.max((F.col("event_type") == "purchase").cast("int")).alias("bought"))
    return g.where("views >= 8")


def r9_session_audit(spark: SparkSession, sf: str) -> DataFrame:
    """Four checks over each session (source and day of test runs): symbols edited (failing runs) were prepared (a passing run) before, tests ran,
    no edited symbol breaks a blocking rule that is not waived, and something was learned of an edited symbol; without edits the first, third and last hold."""
    r = W.runs(spark, sf).select("source", F.to_date("at").alias("day"), "at", "exit", "command", "symbols")
    tested = r.groupBy("source", "day").agg(F.max(F.col("command").rlike("(?:vitest|pytest|jest|mocha|ci-relay|nightly|gate-hook) run")).alias("tested"), F.count(F.lit(1)).alias("runs"))
    each = r.select("source", "day", "at", "exit", F.explode("symbols").alias("symbol")).groupBy("source", "day", "symbol").agg(F.min(F.when(F.col("exit") != 0, F.col("at"))).alias("e"), F.min(F.when(F.col("exit") == 0, F.col("at"))).alias("p")).where("e IS NOT NULL")
    waived = W.waivers(spark, sf).select(F.col("invariant").alias("name"))
    blocking = W.rules(spark, sf).where("severity = 'block'").join(waived, "name", "left_anti").select(F.explode("applies_to").alias("pattern"))
    broken = pattern_matches(each.select(F.col("symbol").alias("name")), blocking).select(F.col("name").alias("symbol")).distinct().withColumn("breaks", F.lit(True))
    noted = W.note(spark, sf).select("symbol").dropna().distinct().withColumn("noted", F.lit(True))
    s = each.join(broken, "symbol", "left").join(noted, "symbol", "left").groupBy("source", "day").agg(F.min(F.coalesce(F.col("p") <= F.col("e"), F.lit(False))).alias("prepared"), F.max(F.coalesce("breaks", F.lit(False))).alias("breaks"), F.max(F.coalesce("noted", F.lit(False))).alias("learned"))
    a, b = tested.alias("a"), s.alias("b")
    m = a.join(b, F.col("a.source").eqNullSafe(F.col("b.source")) & F.col("a.day").eqNullSafe(F.col("b.day")), "left")
    out = m.select("a.source", "a.day", "runs", F.coalesce("prepared", F.lit(True)).alias("prepared"), F.coalesce("tested", F.lit(False)).alias("tested"), (~F.coalesce("breaks", F.lit(False))).alias("clean"), F.coalesce("learned", F.lit(True)).alias("learned"))
    return out.withColumn("passed", F.col("prepared") & F.col("tested") & F.col("clean") & F.col("learned"))


def r10_replay(spark: SparkSession, sf: str) -> DataFrame:
    """The first two hundred events in order."""
    return table(spark, sf, "events", "event_id", "ts", "event_type").orderBy("ts", "event_id").limit(200)


def r12_last_surfaced(spark: SparkSession, sf: str) -> DataFrame:
    """When each note was last surfaced, from all its deliveries."""
    return table(spark, sf, "notes", "id", "last_surfaced_at").where("last_surfaced_at IS NOT NULL").groupBy("id").agg(F.max("last_surfaced_at").alias("last_surfaced_at"))


def r13_index_staleness(spark: SparkSession, sf: str) -> DataFrame:
    """Files with a call built after their symbols were indexed, and files without symbols."""
    s = table(spark, sf, "symbols", "file", "indexed_at").where("file IS NOT NULL").groupBy("file").agg(F.max("indexed_at").alias("indexed"))
    e = table(spark, sf, "edges", "file", "built_at").where("file IS NOT NULL").groupBy("file").agg(F.max("built_at").alias("built"))
    state = F.when(F.col("indexed").isNull(), "missing").when(F.col("built") > F.col("indexed"), "stale")
    return e.join(s, "file", "left").select("file", state.alias("state")).where("state IS NOT NULL")


_FUNCS = (r1_bursts, r2_tail, r3_counts, r4_failure_buffer, r5_weights, r7_first_seen, r8_hard_searches, r9_session_audit, r10_replay, r12_last_surfaced, r13_index_staleness)
QUERIES = {f.__name__: f for f in _FUNCS}
SQL = {
    "r1_bursts": """
WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 1 HOUR THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS b FROM g)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 1 HOUR AS stop, count(*) AS n FROM s GROUP BY user_id, b HAVING max(ts) + INTERVAL 1 HOUR < (SELECT date_trunc('milliseconds', max(ts)) FROM events) - INTERVAL 10 MINUTE""",
    "r2_tail": W.sql("SELECT seq, source FROM runs WHERE seq > 100 ORDER BY seq DESC LIMIT 100"),
    "r3_counts": "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, max(ts) AS last_ts FROM events GROUP BY 1, 2 HAVING date_trunc('hour', min(ts)) + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE",
    "r4_failure_buffer": "SELECT user_id, least(count(*), 50)::INT AS held, arg_max(event_id, (ts, event_id)) AS last_seq FROM events WHERE event_type = 'error' GROUP BY user_id",
    "r5_weights": """
SELECT 'shop' AS label, user_id::VARCHAR AS id, round(sum(0.3::DOUBLE * s * pow(0.7::DOUBLE, after)), 6) AS weight, count(*) AS touches
FROM (SELECT user_id, CASE event_type WHEN 'purchase' THEN 1.0::DOUBLE ELSE 0.3 END AS s, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) - 1 AS after FROM events WHERE event_type IN ('click', 'purchase')) GROUP BY user_id""",
    "r7_first_seen": "SELECT DISTINCT user_id, event_type FROM events",
    "r8_hard_searches": "SELECT user_id, date_trunc('month', ts)::DATE AS month, count(*) FILTER (WHERE event_type = 'view') AS views, arg_max(event_id, ts) FILTER (WHERE event_type = 'view') AS last_view, max((event_type = 'purchase')::INT) AS bought FROM events GROUP BY 1, 2 HAVING count(*) FILTER (WHERE event_type = 'view') >= 8",
    "r9_session_audit": W.sql("""
, s AS (SELECT source, "at"::DATE AS day, bool_or(regexp_matches(command, '(?:vitest|pytest|jest|mocha|ci-relay|nightly|gate-hook) run')) AS tested, count(*) AS runs FROM runs GROUP BY 1, 2),
e AS (SELECT source, day, symbol, min("at") FILTER (WHERE exit <> 0) AS e, min("at") FILTER (WHERE exit = 0) AS p FROM (SELECT source, "at"::DATE AS day, "at", exit, unnest(symbols) AS symbol FROM runs) GROUP BY 1, 2, 3 HAVING min("at") FILTER (WHERE exit <> 0) IS NOT NULL),
b AS (SELECT unnest(applies_to) AS p FROM rules WHERE severity = 'block' AND name NOT IN (SELECT invariant FROM waivers)),
g AS (SELECT source, day, bool_and(coalesce(e.p <= e.e, false)) AS prepared, bool_or(EXISTS (SELECT 1 FROM b WHERE CASE WHEN b.p LIKE '%*' THEN starts_with(symbol, substr(b.p, 1, length(b.p) - 1)) WHEN b.p LIKE '*%' THEN suffix(symbol, substr(b.p, 2)) ELSE symbol = b.p OR suffix(symbol, '.' || b.p) OR suffix(symbol, '/' || b.p) END)) AS breaks, bool_or(symbol IN (SELECT symbol FROM note WHERE symbol IS NOT NULL)) AS learned FROM e GROUP BY 1, 2)
SELECT s.source, s.day, runs, coalesce(prepared, true) AS prepared, coalesce(tested, false) AS tested, NOT coalesce(breaks, false) AS clean, coalesce(learned, true) AS learned, coalesce(prepared, true) AND coalesce(tested, false) AND NOT coalesce(breaks, false) AND coalesce(learned, true) AS passed FROM s LEFT JOIN g ON g.source IS NOT DISTINCT FROM s.source AND g.day IS NOT DISTINCT FROM s.day"""),
    "r10_replay": "SELECT event_id, ts, event_type FROM events ORDER BY ts, event_id LIMIT 200",
    "r12_last_surfaced": "SELECT id, max(last_surfaced_at) AS last_surfaced_at FROM notes WHERE last_surfaced_at IS NOT NULL GROUP BY id",
    "r13_index_staleness": "SELECT file, CASE WHEN indexed IS NULL THEN 'missing' ELSE 'stale' END AS state FROM (SELECT file, max(built_at) AS built FROM edges WHERE file IS NOT NULL GROUP BY file) LEFT JOIN (SELECT file, max(indexed_at) AS indexed FROM symbols WHERE file IS NOT NULL GROUP BY file) USING (file) WHERE indexed IS NULL OR built > indexed",
}
