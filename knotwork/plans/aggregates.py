"""Aggregation queries: counts, shares, scores, percentiles and rollups."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.stats import sql_wilson, wilson
from ..operators.graph import degrees
from ..operators.sequences import picked
from ..sources.tables import table
from . import warehouse as W


def a1_observation_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Events per user: number, last time, and number by type in order of type."""
    e = table(spark, sf, "events", "user_id", "event_type", "ts")
    by_type = e.groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"), F.max("ts").alias("last"))
    tools = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_type", "n"))), lambda x: F.concat_ws("=", x["event_type"], x["n"].cast("string"))), ",")
    return by_type.groupBy("user_id").agg(F.sum("n").alias("observations"), F.max("last").alias("last_ts"), tools.alias("tools"))


def a2_churn(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct commits per file, from notes anchored to files."""
    n = W.note(spark, sf).where("scope = 'file' AND symbol IS NOT NULL AND source_commit IS NOT NULL")
    return n.groupBy(F.col("symbol").alias("file")).agg(F.count_distinct("source_commit").alias("commits"))


def a3_contributors(spark: SparkSession, sf: str) -> DataFrame:
    """Authors by 0.7 of their share of commits and 0.3 of their share of decisions (promoted notes)."""
    n = W.note(spark, sf).where("author IS NOT NULL")
    c = n.where("source_commit IS NOT NULL").groupBy("author").agg(F.count_distinct("source_commit").alias("commits"))
    d = n.where("promoted").groupBy("author").agg(F.count(F.lit(1)).alias("decisions"))
    both = c.join(d, "author", "full_outer").fillna(0, ["commits", "decisions"])
    total = both.agg(F.sum("commits").alias("c"), F.sum("decisions").alias("d"))
    share = 0.7 * F.col("commits") / F.greatest(F.col("c"), F.lit(1)) + 0.3 * F.col("decisions") / F.greatest(F.col("d"), F.lit(1))
    return both.join(F.broadcast(total)).select("author", "commits", "decisions", F.round(share, 6).alias("share"))  # one row


def a4_document_frequency(spark: SparkSession, sf: str) -> DataFrame:
    """Symbols per token."""
    return W.sym(spark, sf).select(F.explode(F.array_distinct("tokens")).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("df"))


def a6_learned_commands(spark: SparkSession, sf: str) -> DataFrame:
    """The three commands that passed most often for each symbol."""
    r = W.runs(spark, sf).where("exit = 0").select(F.explode(F.array_distinct("symbols")).alias("symbol"), "command", "at")
    g = r.groupBy("symbol", "command").agg(F.count(F.lit(1)).alias("passes"), F.max("at").alias("last_passed"))
    w = Window.partitionBy("symbol").orderBy(F.desc("passes"), F.desc("last_passed"), "command")
    return g.withColumn("rank", F.row_number().over(w)).where("rank <= 3").select("symbol", "command", "passes", "rank")


def a7_repeated_mistakes(spark: SparkSession, sf: str) -> DataFrame:
    """Mistakes of a symbol that came twice or more: the kind (the source of the run) and its message, cut to 120 characters; without a message the kind's failure."""
    r = W.runs(spark, sf).where("exit <> 0").select(F.explode(F.array_distinct("symbols")).alias("symbol"), "at", F.when(F.coalesce("message", F.lit("")) != "", F.concat("source", F.lit(": "), F.substring("message", 1, 120))).otherwise(F.concat("source", F.lit(" failure"))).alias("message"))
    return r.groupBy("symbol", "message").agg(F.count(F.lit(1)).alias("times"), F.max("at").alias("last_at")).where("times >= 2")


def a8_common_tests(spark: SparkSession, sf: str) -> DataFrame:
    """Failed tests per feature: runs that list them and runs that failed."""
    r = W.runs(spark, sf).where("feature IS NOT NULL").select("feature", "exit", F.explode(F.array_distinct("failed_tests")).alias("test"))
    return r.groupBy("feature", "test").agg(F.count(F.lit(1)).alias("runs"), F.sum((F.col("exit") != 0).cast("bigint")).alias("failures"))


def a10_feature_merge(spark: SparkSession, sf: str) -> DataFrame:
    """The features checkout and payouts merged: highest weight, summed touches, last touch, and the labels that now stand for it."""
    w = W.weights(spark, sf).where("label IN ('checkout', 'payouts')")
    return w.groupBy("id").agg(F.round(F.max("weight"), 6).alias("weight"), F.sum("edits").alias("edits"), F.sum("reads").alias("reads"), F.max("last_touched").alias("last_touched"), F.array_join(F.array_sort(F.collect_set("label")), ",").alias("aliases"))


def a12_memory_health(spark: SparkSession, sf: str) -> DataFrame:
    """Health of the whole memory: penalties by counts, each with a cap, and a bonus for coverage."""
    n = W.note(spark, sf).agg(F.sum((F.col("scope") == "symbol").cast("bigint")).alias("symbol_notes"), F.sum((F.col("scope") != "symbol").cast("bigint")).alias("scoped_notes"), F.sum((F.try_to_timestamp("expires_at") < F.lit("2026-07-01").cast("timestamp")).cast("bigint")).alias("prunable"))
    i = W.inb(spark, sf).agg(F.sum((F.col("status") == "pending").cast("bigint")).alias("inbox_pending"))
    v = W.iss(spark, sf).agg(F.count(F.lit(1)).alias("issues"))
    s = W.stale(spark, sf).agg(F.sum((F.col("age_days") >= 180).cast("bigint")).alias("review_items"))
    row = n.join(i).join(v).join(s)  # one row each
    less = lambda c, rate, cap: F.least(F.lit(cap), F.col(c) * rate)
    score = 1 - less("review_items", 0.025, 0.25) - less("issues", 0.03, 0.25) - less("inbox_pending", 0.02, 0.15) - less("prunable", 0.02, 0.15) + F.least(F.lit(0.1), (F.col("symbol_notes") + F.col("scoped_notes")) * 0.002)
    row = row.withColumn("score", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)), 3))
    return row.withColumn("status", F.when(F.col("score") >= 0.95, "healthy").when(F.col("score") >= 0.65, "watch").otherwise("needs_attention"))


def a13_pulse(spark: SparkSession, sf: str) -> DataFrame:
    """Risk of each symbol with issues: the highest severity's weight and 0.05 of the others, capped at 1, with its band (also k2)."""
    weight = F.when(F.col("severity") == "block", 1.0).when(F.col("severity") == "warn", 0.5).when(F.col("severity") == "info", 0.1).otherwise(0.0)
    g = W.iss(spark, sf).where("symbol IS NOT NULL").select("symbol", weight.alias("w")).groupBy("symbol").agg(F.max("w").alias("m"), F.sum("w").alias("s"))
    g = g.select("symbol", F.round(F.least(F.lit(1.0), F.col("m") + 0.05 * (F.col("s") - F.col("m"))), 6).alias("risk"))
    return g.withColumn("band", F.when(F.col("risk") >= 0.75, "block").when(F.col("risk") >= 0.5, "high").when(F.col("risk") >= 0.2, "medium").otherwise("low"))


def a14_document_stats(spark: SparkSession, sf: str) -> DataFrame:
    """Documents, characters and lines per source and language, spellings brought together."""
    norm = lambda c: F.lower(F.trim(F.col(c)))
    d = W.docs(spark, sf).select(norm("source").alias("source"), F.substring(norm("lang"), 1, 2).alias("lang"), F.length("text").alias("chars"), (F.length("text") - F.length(F.replace(F.col("text"), F.lit("\n"), F.lit(""))) + 1).alias("lines"))
    return d.groupBy("source", "lang").agg(F.count(F.lit(1)).alias("documents"), F.sum("chars").cast("bigint").alias("chars"), F.sum("lines").cast("bigint").alias("lines"))


def a15_degrees(spark: SparkSession, sf: str) -> DataFrame:
    """Nodes of the graph by degree."""
    d = degrees(W.edg(spark, sf)).select((F.col("fan_in") + F.col("fan_out")).alias("degree"))
    return d.groupBy("degree").agg(F.count(F.lit(1)).alias("nodes")).select(F.col("degree").cast("bigint").alias("degree"), "nodes")


def a16_edge_precision(spark: SparkSession, sf: str) -> DataFrame:
    """Edges checked against the symbol table by resolution status: confirmed where the target's name is the one called (also k26)."""
    s = W.sym(spark, sf).select(F.col("id").alias("to_id"), "name", "qualified_name")
    e = table(spark, sf, "edges", "edge_key", "to_id", "to_name", "resolution_status").withColumn("to_id", F.btrim("to_id"))
    m = e.join(s, "to_id", "left").withColumn("ok", F.coalesce((F.col("to_name") == F.col("name")) | (F.col("to_name") == F.col("qualified_name")), F.lit(False)))
    g = m.groupBy("resolution_status").agg(F.count(F.lit(1)).alias("edges"), F.count("name").alias("found"), F.sum(F.col("ok").cast("bigint")).alias("confirmed"))
    return g.withColumns({"precision": F.round(F.col("confirmed") / F.greatest(F.col("found"), F.lit(1)), 6), "coverage": F.round(F.col("found") / F.col("edges"), 6)})


def a17_wilson(spark: SparkSession, sf: str) -> DataFrame:
    """Share of bench runs per task that did not time out, with its Wilson interval."""
    g = table(spark, sf, "bench_runs", "task_id", "timed_out").groupBy("task_id").agg(F.count(F.lit(1)).alias("n"), F.sum((~F.coalesce("timed_out", F.lit(False))).cast("bigint")).alias("hits"))
    low, high = wilson(F.col("hits").cast("double"), F.col("n").cast("double"))
    return g.select("task_id", "n", "hits", F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


def a18_percentiles(spark: SparkSession, sf: str) -> DataFrame:
    """The 50th and 95th percentile of bench durations per arm, as the value at rank floor(p * n) from 0, last at most."""
    p = picked(table(spark, sf, "bench_runs", "run_key", "arm", "duration_sec"), ["arm"], "duration_sec", "run_key", [50, 95])
    at = lambda n: F.round(F.max(F.when(F.col("percent") == n, F.col("duration_sec"))), 6).alias(f"p{n}")
    return p.groupBy("arm").agg(at(50), at(95))


def a19_bench_rollup(spark: SparkSession, sf: str) -> DataFrame:
    """Runs, completion rate and mean duration by agent and arm, with subtotals and the total."""
    b = table(spark, sf, "bench_runs", "agent_label", "arm", "timed_out", "duration_sec")
    g = b.rollup("agent_label", "arm").agg(F.count(F.lit(1)).alias("runs"), F.round(F.avg((~F.coalesce("timed_out", F.lit(False))).cast("double")), 6).alias("completed"), F.round(F.avg("duration_sec"), 4).alias("mean_duration"), F.grouping_id().cast("int").alias("level"))
    return g


def a19_paired_delta(spark: SparkSession, sf: str) -> DataFrame:
    """Completion rate per task in the arm under test less that in the baseline, for tasks that ran in both."""
    b = table(spark, sf, "bench_runs", "task_id", "arm", "timed_out").where("arm IS NOT NULL").withColumn("side", F.when(F.col("arm") == "baseline", "base").otherwise("test"))
    p = b.groupBy("task_id").pivot("side", ["base", "test"]).agg(F.avg((~F.coalesce("timed_out", F.lit(False))).cast("double")))
    return p.where("base IS NOT NULL AND test IS NOT NULL").select("task_id", F.round(F.col("test") - F.col("base"), 6).alias("delta"))


def a20_kappa(spark: SparkSession, sf: str) -> DataFrame:
    """Agreement beyond chance between a run's time-out flag and an output under 40 characters."""
    b = table(spark, sf, "bench_runs", "timed_out", "output").select(F.coalesce("timed_out", F.lit(False)).alias("a"), (F.coalesce(F.length("output"), F.lit(0)) < 40).alias("b"))
    g = b.agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("a") == F.col("b")).cast("double")).alias("agree"), F.avg(F.col("a").cast("double")).alias("pa"), F.avg(F.col("b").cast("double")).alias("pb"))
    chance = F.col("pa") * F.col("pb") + (1 - F.col("pa")) * (1 - F.col("pb"))
    return g.select("n", F.round(F.when(chance == 1, 1.0).otherwise((F.col("agree") - chance) / (1 - chance)), 6).alias("kappa"))


def a20_bootstrap(spark: SparkSession, sf: str, resamples: int = 2000) -> DataFrame:
    """Interval of the mean duration per arm by `resamples` Poisson resamples whose weights are hashes of (resample, run), so that any engine or split gives the same."""
    d = table(spark, sf, "bench_runs", "run_key", "arm", "duration_sec").where("duration_sec IS NOT NULL AND arm IS NOT NULL")

    def run(batches):
        import numpy as np

        sums: dict[str, object] = {}
        for batch in batches:
            for arm, part in ((arm, own[i : i + 500]) for arm, own in batch.groupby("arm") for i in range(0, len(own), 500)):  # some MB at once
                key = part["run_key"].to_numpy().astype(np.uint64)
                with np.errstate(over="ignore"):
                    h = (key[:, None] + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) + np.arange(resamples, dtype=np.uint64)[None, :] * np.uint64(0xD1B54A32D192ED03)
                    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
                    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
                    h ^= h >> np.uint64(31)
                u = (h >> np.uint64(11)).astype(float) / float(1 << 53)
                w = np.searchsorted(np.array([0.36787944, 0.73575888, 0.9196986, 0.98101184, 0.99634015, 0.99940582]), u)
                s, n = sums.setdefault(arm, (np.zeros(resamples), np.zeros(resamples)))
                s += w.T @ part["duration_sec"].to_numpy()
                n += w.sum(axis=0)
        yield pd.DataFrame([(arm, i, float(s[i]), float(n[i])) for arm, (s, n) in sums.items() for i in range(resamples)], columns=["arm", "i", "s", "n"])

    sums = d.mapInPandas(run, "arm string, i int, s double, n double").groupBy("arm", "i").agg((F.sum("s") / F.sum("n")).alias("mean"))
    return sums.groupBy("arm").agg(F.round(F.percentile("mean", 0.025), 6).alias("low"), F.round(F.percentile("mean", 0.975), 6).alias("high"))


def a21_proportions(spark: SparkSession, sf: str) -> DataFrame:
    """Shares of notes per source that are promoted, verified by a classifier, surfaced and expiring."""
    n = W.note(spark, sf)
    share = lambda cond: F.round(F.avg(cond.cast("double")), 6)
    return n.groupBy("source").agg(F.count(F.lit(1)).alias("notes"), share(F.coalesce("promoted", F.lit(False))).alias("promoted"), share(F.col("classifier").isNotNull()).alias("classified"), share(F.col("last_surfaced_at").isNotNull()).alias("surfaced"), share(F.col("expires_at").isNotNull()).alias("expiring"))


def a22_distinct(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct values of the key columns."""
    e = table(spark, sf, "edges", "from_id", "to_id", "file")
    return e.agg(F.count_distinct("from_id").alias("callers"), F.count_distinct("to_id").alias("callees"), F.count_distinct("file").alias("files"))


QUERIES = {f.__name__: f for f in (a1_observation_counts, a2_churn, a3_contributors, a4_document_frequency, a6_learned_commands, a7_repeated_mistakes, a8_common_tests, a10_feature_merge, a12_memory_health, a13_pulse, a14_document_stats, a15_degrees, a16_edge_precision, a17_wilson, a18_percentiles, a19_bench_rollup, a19_paired_delta, a20_kappa, a20_bootstrap, a21_proportions, a22_distinct)}
_OK = "avg(CASE WHEN coalesce(timed_out, false) THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END)"
SQL = {
    "a1_observation_counts": """
SELECT user_id, sum(n)::BIGINT AS observations, max(last) AS last_ts, string_agg(event_type || '=' || n, ',' ORDER BY event_type) AS tools FROM (SELECT user_id, event_type, count(*) AS n, max(ts) AS last FROM events GROUP BY 1, 2) GROUP BY user_id""",
    "a2_churn": W.sql("SELECT symbol AS file, count(DISTINCT source_commit) AS commits FROM note WHERE scope = 'file' AND symbol IS NOT NULL AND source_commit IS NOT NULL GROUP BY 1"),
    "a3_contributors": W.sql("""
, g AS (SELECT author, count(DISTINCT source_commit) AS commits, count(*) FILTER (WHERE promoted) AS decisions FROM note WHERE author IS NOT NULL GROUP BY 1)
SELECT author, commits, decisions, round(0.7::DOUBLE * commits / greatest((SELECT sum(commits) FROM g), 1) + 0.3::DOUBLE * decisions / greatest((SELECT sum(decisions) FROM g), 1), 6) AS share FROM g WHERE commits > 0 OR decisions > 0"""),
    "a4_document_frequency": W.sql("SELECT token, count(*) AS df FROM (SELECT id, unnest(list_distinct(tokens)) AS token FROM sym) GROUP BY token"),
    "a6_learned_commands": W.sql("""
SELECT symbol, command, passes, rank FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY passes DESC, last_passed DESC, command) AS rank FROM (SELECT symbol, command, count(*) AS passes, max("at") AS last_passed FROM (SELECT unnest(list_distinct(symbols)) AS symbol, command, "at" FROM runs WHERE exit = 0) GROUP BY 1, 2)) WHERE rank <= 3"""),
    "a7_repeated_mistakes": W.sql("""SELECT symbol, message, count(*) AS times, max("at") AS last_at FROM (SELECT unnest(list_distinct(symbols)) AS symbol, "at", CASE WHEN coalesce(message, '') <> '' THEN source || ': ' || substr(message, 1, 120) ELSE source || ' failure' END AS message FROM runs WHERE exit <> 0) GROUP BY 1, 2 HAVING count(*) >= 2"""),
    "a8_common_tests": W.sql("SELECT feature, test, count(*) AS runs, count(*) FILTER (WHERE exit <> 0) AS failures FROM (SELECT feature, exit, unnest(list_distinct(failed_tests)) AS test FROM runs WHERE feature IS NOT NULL) GROUP BY 1, 2"),
    "a10_feature_merge": W.sql("SELECT id, round(max(weight), 6) AS weight, sum(edits)::BIGINT AS edits, sum(reads)::BIGINT AS reads, max(last_touched) AS last_touched, string_agg(DISTINCT label, ',' ORDER BY label) AS aliases FROM weights WHERE label IN ('checkout', 'payouts') GROUP BY id"),
    "a12_memory_health": W.sql("""
, c AS (SELECT (SELECT count(*) FROM note WHERE scope = 'symbol') AS symbol_notes, (SELECT count(*) FROM note WHERE scope <> 'symbol') AS scoped_notes, (SELECT count(*) FROM note WHERE try_cast(expires_at AS TIMESTAMP) < TIMESTAMP '2026-07-01') AS prunable, (SELECT count(*) FROM inb WHERE status = 'pending') AS inbox_pending, (SELECT count(*) FROM iss) AS issues, (SELECT count(*) FROM stale_entries WHERE age_days >= 180) AS review_items),
s AS (SELECT *, round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, 1 - least(0.25::DOUBLE, review_items * 0.025::DOUBLE) - least(0.25::DOUBLE, issues * 0.03::DOUBLE) - least(0.15::DOUBLE, inbox_pending * 0.02::DOUBLE) - least(0.15::DOUBLE, prunable * 0.02::DOUBLE) + least(0.1::DOUBLE, (symbol_notes + scoped_notes) * 0.002::DOUBLE))), 3) AS score FROM c)
SELECT *, CASE WHEN score >= 0.95 THEN 'healthy' WHEN score >= 0.65 THEN 'watch' ELSE 'needs_attention' END AS status FROM s"""),
    "a13_pulse": W.sql("""
, g AS (SELECT symbol, round(least(1.0::DOUBLE, max(w) + 0.05::DOUBLE * (sum(w) - max(w))), 6) AS risk FROM (SELECT symbol, CASE severity WHEN 'block' THEN 1.0::DOUBLE WHEN 'warn' THEN 0.5 WHEN 'info' THEN 0.1 ELSE 0 END AS w FROM iss WHERE symbol IS NOT NULL) GROUP BY symbol)
SELECT *, CASE WHEN risk >= 0.75 THEN 'block' WHEN risk >= 0.5 THEN 'high' WHEN risk >= 0.2 THEN 'medium' ELSE 'low' END AS band FROM g"""),
    "a14_document_stats": "SELECT lower(trim(source)) AS source, substr(lower(trim(lang)), 1, 2) AS lang, count(*) AS documents, sum(length(text))::BIGINT AS chars, sum(length(text) - length(replace(text, chr(10), '')) + 1)::BIGINT AS lines FROM documents GROUP BY 1, 2",
    "a15_degrees": W.sql("SELECT degree, count(*) AS nodes FROM (SELECT id, count(*) AS degree FROM (SELECT dst AS id FROM edg UNION ALL SELECT src FROM edg) GROUP BY id) GROUP BY degree"),
    "a16_edge_precision": W.sql("""
, g AS (SELECT resolution_status, count(*) AS edges, count(s.name) AS found, count(*) FILTER (WHERE e.to_name = s.name OR e.to_name = s.qualified_name) AS confirmed FROM edges e LEFT JOIN sym s ON s.id = trim(e.to_id) GROUP BY 1)
SELECT *, round(confirmed::DOUBLE / greatest(found, 1), 6) AS precision, round(found::DOUBLE / edges, 6) AS coverage FROM g"""),
    "a17_wilson": f"SELECT task_id, n, hits, round(greatest(0.0::DOUBLE, {sql_wilson('hits', 'n', '-')}), 6) AS low, round(least(1.0::DOUBLE, {sql_wilson('hits', 'n', '+')}), 6) AS high FROM (SELECT task_id, count(*) AS n, count(*) FILTER (WHERE NOT coalesce(timed_out, false)) AS hits FROM bench_runs GROUP BY task_id)",
    "a18_percentiles": """
SELECT arm, round(max(duration_sec) FILTER (WHERE i = least(n - 1, floor(50.0 * n / 100))), 6) AS p50, round(max(duration_sec) FILTER (WHERE i = least(n - 1, floor(95.0 * n / 100))), 6) AS p95
FROM (SELECT arm, duration_sec, row_number() OVER (PARTITION BY arm ORDER BY duration_sec, run_key) - 1 AS i, count(*) OVER (PARTITION BY arm) AS n FROM bench_runs WHERE duration_sec IS NOT NULL) GROUP BY arm""",
    "a19_bench_rollup": f"SELECT agent_label, arm, count(*) AS runs, round({_OK}, 6) AS completed, round(avg(duration_sec), 4) AS mean_duration, grouping(agent_label, arm)::INT AS level FROM bench_runs GROUP BY ROLLUP (agent_label, arm)",
    "a19_paired_delta": f"SELECT task_id, round(g - b, 6) AS delta FROM (SELECT task_id, {_OK} FILTER (WHERE arm <> 'baseline') AS g, {_OK} FILTER (WHERE arm = 'baseline') AS b FROM bench_runs GROUP BY task_id) WHERE g IS NOT NULL AND b IS NOT NULL",
    "a20_kappa": """
SELECT n, round(CASE WHEN pa * pb + (1 - pa) * (1 - pb) = 1 THEN 1.0::DOUBLE ELSE (agree - (pa * pb + (1 - pa) * (1 - pb))) / (1 - (pa * pb + (1 - pa) * (1 - pb))) END, 6) AS kappa
FROM (SELECT count(*) AS n, avg((a = b)::INT) AS agree, avg(a::INT) AS pa, avg(b::INT) AS pb FROM (SELECT coalesce(timed_out, false) AS a, coalesce(length(output), 0) < 40 AS b FROM bench_runs))""",
    "a21_proportions": W.sql("SELECT source, count(*) AS notes, round(avg(coalesce(promoted, false)::INT), 6) AS promoted, round(avg((classifier IS NOT NULL)::INT), 6) AS classified, round(avg((last_surfaced_at IS NOT NULL)::INT), 6) AS surfaced, round(avg((expires_at IS NOT NULL)::INT), 6) AS expiring FROM note GROUP BY source"),
    "a22_distinct": "SELECT count(DISTINCT from_id) AS callers, count(DISTINCT to_id) AS callees, count(DISTINCT file) AS files FROM edges",
}
