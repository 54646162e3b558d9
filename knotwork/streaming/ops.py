"""Streaming operators. Each takes a streaming or a batch DataFrame and gives the same rows for the same events, up to what the watermark holds back."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..session import ensure_checkpoint_dir

# How late an event may be. Later ones are dropped; Spark counts them as numRowsDroppedByWatermark.
LATENESS = "10 minutes"


def file_stream(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """Table `name` of `folder` as a stream of files."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(folder)


def drain(stream: DataFrame, mode: str = "append") -> DataFrame:
    """All rows that `stream` gives for what is there now, by way of a table in the shared folder.

    Offsets, state and output live in that folder, so a run that is broken off goes on from its last finished batch; in append mode each batch writes
    its own part once (the file sink's commit log), in update mode a batch that runs again overwrites its own folder.
    """
    spark = stream.sparkSession
    base = f"{ensure_checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"
    writer = stream.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{base}/state").outputMode(mode)
    if mode == "append":
        query = writer.format("parquet").option("path", f"{base}/out").start()
    else:
        query = writer.foreachBatch(lambda df, i: df.write.mode("overwrite").parquet(f"{base}/out/batch={i}")).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


def counts(events: DataFrame, keys: list[str], width: str = "1 hour") -> DataFrame:
    """Events per key and tumbling window, last time; a window comes out when the watermark passes its end."""
    g = events.withWatermark("ts", LATENESS).groupBy(F.window("ts", width).alias("w"), *keys)
    return g.agg(F.count(F.lit(1)).alias("n"), F.max("ts").alias("last_ts")).select(F.col("w.start").alias("start"), *keys, "n", "last_ts")


def bursts(events: DataFrame, key: str, gap: str) -> DataFrame:
    """Bursts of events of a key without a pause of `gap`, evaluated once at their end: start, end, events."""
    g = events.withWatermark("ts", LATENESS).groupBy(F.session_window("ts", gap).alias("w"), key)
    return g.agg(F.count(F.lit(1)).alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("stop"), "n")


def first_seen(events: DataFrame, keys: list[str], forever: bool = True) -> DataFrame:
    """The first event of each key; repeats of a capture are dropped. With `forever` every key is kept as state, so that no repeat comes through
    however late; else only within the watermark, and state is cleared behind it."""
    return events.withWatermark("ts", LATENESS).dropDuplicatesWithinWatermark(keys) if events.isStreaming and not forever else events.dropDuplicates(keys)


# Touches of a key that are kept in order; what is older weighs less than a rounding error (0.7 ** 120).
KEPT = 120


def folded_weights(touches: DataFrame) -> DataFrame:
    """Weight per (label, id) folded over touches in order of (ts, seq): w = 0.3 * signal + 0.7 * w, in whatever order and batches they come.

    The fold is a sum in which each touch weighs 0.7 to the number of touches after it, so the state is the last KEPT touches in order and
    the number of all; a late touch takes its place among them. A key's batch is read part by part, never as a whole.
    """

    def fold(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        ts, seq, signal, n = state.get if state.exists else ([], [], [], 0)
        had = list(zip(ts, seq, signal))
        for rows in parts:
            had = sorted(had + list(zip((t.value // 1000 for t in rows["ts"]), map(int, rows["seq"]), map(float, rows["signal"]))))[-KEPT:]
            n += len(rows)
        state.update(([t for t, _, _ in had], [s for _, s, _ in had], [v for _, _, v in had], n))
        weight = 0.0
        for _, _, v in had:
            weight = 0.3 * v + 0.7 * weight
        yield pd.DataFrame([(*key, weight, n)], columns=["label", "id", "weight", "touches"])

    g = touches.select("label", "id", "ts", "seq", "signal").groupBy("label", "id")
    return g.applyInPandasWithState(fold, "label string, id string, weight double, touches bigint", "ts array<bigint>, seq array<bigint>, signal array<double>, touches bigint", "update", GroupStateTimeout.NoTimeout)


def failure_buffer(failures: DataFrame, key: str, keep: int = 50) -> DataFrame:
    """The last `keep` failures (ts, seq) of each key, held as state; a batch gives the whole buffer of each key it touches."""

    def hold(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        had = list(zip(*state.get)) if state.exists else []
        for rows in parts:
            had = sorted(had + list(zip((t.value // 1000 for t in rows["ts"]), rows["seq"])))[-keep:]
        state.update(([int(t) for t, _ in had], [int(s) for _, s in had]))
        yield pd.DataFrame([(k[0], len(had), int(had[-1][1]))], columns=[key, "held", "last_seq"])

    return failures.select(key, "ts", "seq").groupBy(key).applyInPandasWithState(hold, f"{key} {dict(failures.dtypes)[key]}, held int, last_seq bigint", "ts array<bigint>, seq array<bigint>", "update", GroupStateTimeout.NoTimeout)
