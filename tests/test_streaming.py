import datetime as dt
import random
import uuid

import pytest
from pyspark.sql import functions as F

from knotwork.session import ensure_checkpoint_dir
from knotwork.streaming import ops as S

T0 = dt.datetime(2026, 1, 1)


@pytest.fixture
def events(spark, tmp_path):
    r = random.Random(7)
    data = [(i, T0 + dt.timedelta(minutes=r.randrange(0, 600)), r.randrange(4), r.choice(["click", "error"])) for i in range(300)]
    df = spark.createDataFrame(data, "event_id bigint, ts timestamp, user_id bigint, event_type string")
    df.coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "events.parquet"))
    return df, stream


def test_counts_equal_the_batch(spark, rows, events):
    df, stream = events
    limit = df.agg(F.max("ts")).first()[0] - dt.timedelta(minutes=10)
    got = rows(S.drain(S.counts(stream, ["event_type"])), "start", "event_type", "n")
    want = rows(S.counts(df, ["event_type"]).where(F.col("start") + F.expr("INTERVAL 1 HOUR") <= F.lit(limit)), "start", "event_type", "n")
    assert got == want and got


def test_bursts_equal_the_batch(rows, events):
    df, stream = events
    limit = df.agg(F.max("ts")).first()[0] - dt.timedelta(minutes=10)
    # filtered here: Spark would push the filter below the merging of sessions
    want = [r for r in rows(S.bursts(df, "user_id", "5 minutes")) if r[2] < limit]
    assert rows(S.drain(S.bursts(stream, "user_id", "5 minutes"))) == want


def test_folded_weights(rows, events):
    df, stream = events
    shape = lambda d: d.select(F.lit("l").alias("label"), F.col("user_id").cast("string").alias("id"), "ts", F.col("event_id").alias("seq"), F.when(F.col("event_type") == "click", 1.0).otherwise(0.3).alias("signal"))
    want: dict[str, float] = {}
    for r in sorted(shape(df).collect(), key=lambda r: (r.ts, r.seq)):
        want[r.id] = 0.3 * r.signal + 0.7 * want.get(r.id, 0.0)
    got = {r.id: r.weight for r in S.drain(S.folded_weights(shape(stream)), "update").collect()}
    assert got == pytest.approx(want)


def test_failure_buffer_keeps_the_last(rows, events):
    df, stream = events
    f = lambda d: d.where("event_type = 'error'").select("user_id", "ts", F.col("event_id").alias("seq"))
    want = {}
    for r in sorted(f(df).collect(), key=lambda r: (r.ts, r.seq)):
        want.setdefault(r.user_id, []).append(r.seq)
    got = {r.user_id: (r.held, r.last_seq) for r in S.drain(S.failure_buffer(f(stream), "user_id", 5), "update").collect()}
    assert got == {k: (min(5, len(v)), v[-1]) for k, v in want.items()}


def test_late_events_are_dropped_and_restart_goes_on(spark, tmp_path):
    src, base = str(tmp_path / "in"), f"{ensure_checkpoint_dir(spark)}/late-{uuid.uuid4().hex}"
    schema = "ts timestamp, k string"

    def run():
        c = S.counts(spark.readStream.schema(schema).parquet(src), ["k"])
        q = c.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{base}/state").format("parquet").option("path", f"{base}/out").start()
        q.awaitTermination()
        return {(r.start.hour, r.n) for r in spark.read.parquet(f"{base}/out").collect()}

    put = lambda hours: spark.createDataFrame([(T0 + dt.timedelta(hours=h), "a") for h in hours], schema).coalesce(1).write.mode("append").parquet(src)
    put([1.2, 1.5, 3.9])
    assert run() == {(1, 2)}
    put([1.6, 3.95, 6.0])  # the first is beyond the watermark
    assert run() == {(1, 2), (3, 2)}


def test_first_seen(rows, events):
    df, stream = events
    got = rows(S.drain(S.first_seen(stream.select("user_id", "event_type", "ts"), ["user_id", "event_type"])).select("user_id", "event_type"))
    assert got == rows(df.select("user_id", "event_type").distinct())
