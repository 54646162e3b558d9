"""Orphan references: rows that name a key of another table which is not there, or not there at that time."""

from __future__ import annotations

from functools import reduce
from itertools import product

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import fingerprint
from ..session import cut


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def orphans_by_mask(child: DataFrame, parent: DataFrame, on: list[tuple[str, str]], match: str = "simple", during: tuple[str, str, str] | None = None) -> DataFrame:
    """Rows of `child` whose composite key has no partner in `parent`, with `null_mask`, one 0/1 per key column (1: null), and with `during` a `status`.

    `on` pairs child and parent columns. The references are grouped by which of their key columns are null; each group is
    anti-joined on the columns that are not. `match` is the declared meaning of a null in a key:
    simple: a key with any null refers to nothing and is never an orphan; partial: the columns that are not null must
    occur together in one parent row, an all-null key refers to nothing; full: a key is all null (no reference) or
    has no null, and one that is null in part is always an orphan.
    `during` (time of the child, start and stop of the parent) makes time the last column of the key and of the mask: a parent matches that is there
    at that time, start <= time and (stop null or stop > time). Where the time is null the key is anti-joined without it. status: missing: no
    parent has the key; late: those with it start after the time, or have no start; deleted: none is there at the time and one started before.
    Parent rows with a null in a column of the group never match. An empty child gives no rows, an empty parent makes
    every reference an orphan; repeated child rows each come out, repeated parents change nothing. Other columns of `child` pass through; clashing
    names in `parent` do no harm, as only its key columns are read.

    All groups go through one anti-join: a parent row offers a key for each mask, as a 128-bit fingerprint of the mask and the columns that it leaves,
    and a child row asks with that of its own. Only fingerprints are shuffled; the parent's keys are reduced to distinct ones before the join, and AQE splits a hot child key.
    """
    if match not in ("simple", "partial", "full"):
        raise ValueError(match)
    none, every = "0" * len(on), "1" * len(on)
    masks = ["".join(m) for m in product("01", repeat=len(on)) if "0" in m] if match == "partial" else [none]
    own = F.concat(*(F.when(F.col(c).isNull(), "1").otherwise("0") for c, _ in on))
    names = [f"k{i}" for i in range(len(on))]
    k1, k2 = fingerprint("mask", *names)
    at = F.col(during[0]) if during else F.lit(None)
    asked = child.select(F.struct("*").alias("row"), own.alias("mask"), at.alias("at"), *(F.col(c).alias(k) for (c, _), k in zip(on, names))).select("row", "mask", "at", k1.alias("k1"), k2.alias("k2"))
    offers = []
    for m in masks:
        used = reduce(lambda x, y: x & y, (F.col(p).isNotNull() for (_, p), bit in zip(on, m) if bit == "0"))
        left = (F.col(p) if bit == "0" else F.lit(None).cast(parent.schema[p].dataType) for (_, p), bit in zip(on, m))
        offers.append(F.when(used, F.struct(F.lit(m).alias("mask"), *(c.alias(k) for c, k in zip(left, names)))))
    times = [F.col(c).alias(k) for c, k in zip(during[1:], ("start", "stop"))] if during else []
    there = parent.select(F.explode(F.array_compact(F.array(*offers))).alias("o"), *times).select("o.*", *(k for k in ("start", "stop") if during)).select(k1.alias("k1"), k2.alias("k2"), *(k for k in ("start", "stop") if during))
    key = ["k1", "k2"]
    wanted = asked.where(F.col("mask").isin(masks))
    if not during:
        out = wanted.join(there.distinct(), key, "left_anti")
        if match == "full":
            out = out.select("row", "mask").unionByName(asked.where(~F.col("mask").isin(none, every)).select("row", "mask"))
        return out.select("row.*", F.col("mask").alias("null_mask"))
    timed = F.concat("mask", F.when(F.col("at").isNull(), "1").otherwise("0")).alias("null_mask")
    state = there.groupBy(*key).agg(F.min("start").alias("first"), F.min(F.when(F.col("stop").isNull(), F.col("start"))).alias("stays"))
    missing = wanted.join(state, key, "left_anti").select("row", timed, F.lit("missing").alias("status"))
    if match == "full":
        missing = missing.unionByName(asked.where(~F.col("mask").isin(none, every)).select("row", timed, F.lit("missing").alias("status")))
    gone = _not_there(wanted.where("at IS NOT NULL"), there, state)
    return missing.unionByName(gone.select("row", timed, "status")).select("row.*", "null_mask", "status")


def _not_there(asked: DataFrame, there: DataFrame, state: DataFrame) -> DataFrame:
    """Rows of `asked` (row, mask, at, k1, k2) whose key is in `there` (k1, k2, start, stop), but not at that time: late or deleted.

    Each key's stays shrink to two times (first start, first start of those never stopped; `state`), which settles nearly all references in one join.
    What is left, references between the stays of a key, is settled once for each distinct (key, time), by counting starts and stops up to it
    within one (key, hour), on top of a sum over the key's earlier hours: references of one key at one time are one row, those of a hot key are spread by hour.
    """
    key = ["k1", "k2"]
    met = asked.join(state, key)
    status = F.when(F.col("first").isNull() | (F.col("first") > F.col("at")), "late").when(F.col("stays") <= F.col("at"), None).otherwise("between")
    open_cases = cut(met.select("row", "mask", "at", *key, status.alias("status")).where(F.col("status").isNotNull()))
    late = open_cases.where("status = 'late'")
    between = open_cases.where("status = 'between'").drop("status")
    points = between.select(*key, F.col("at").alias("t")).distinct()
    stays = there.where(F.col("stop").isNotNull() & (F.col("stop") > F.col("start"))).distinct().join(points.select(*key).distinct(), key, "left_semi")
    ends = F.explode(F.array(F.struct(F.col("start").alias("t"), F.lit(1).alias("step")), F.struct(F.col("stop").alias("t"), F.lit(-1).alias("step"))))
    steps = stays.select(*key, ends.alias("e")).select(*key, "e.t", F.col("e.step").cast("bigint").alias("step"), F.lit(1).alias("order"))
    points = points.withColumns({"step": F.lit(0).cast("bigint"), "order": F.lit(2)})
    hour = F.date_trunc("HOUR", F.col("t")).cast(asked.schema["at"].dataType)
    hourly = steps.unionByName(points).groupBy(*key, hour.alias("hour")).agg(F.sum("step").alias("step"))
    before = Window.partitionBy(*key).orderBy("hour").rowsBetween(Window.unboundedPreceding, -1)
    carry = hourly.select(*key, "hour", F.coalesce(F.sum("step").over(before), F.lit(0)).alias("step")).where("step <> 0")
    rows = _union([points.withColumn("hour", hour), steps.withColumn("hour", hour), carry.select(*key, F.col("hour").alias("t"), "step", F.lit(0).alias("order"), "hour")])
    so_far = Window.partitionBy(*key, "hour").orderBy("t", "order").rowsBetween(Window.unboundedPreceding, 0)
    empty = rows.withColumn("there", F.sum("step").over(so_far)).where("order = 2 AND there = 0").select(*key, F.col("t").alias("at"))
    deleted = between.join(empty, [*key, "at"], "left_semi").withColumn("status", F.lit("deleted"))
    return late.unionByName(deleted)


def orphans_at(refs: DataFrame, targets: DataFrame) -> DataFrame:
    """Rows of `refs` that meet no row of `targets` at their time, with `status` missing, late or deleted.

    refs has `space`, `ref` and `at` besides what it carries along, at least one column, under any name but status; targets has `space`, `ref`, `start`, `stop` (null stop: still there).
    It is `orphans_by_mask` over the composite key (space, ref, at) with simple match: without `ref` it is no reference, without `at` only `missing` can be told.
    """
    carried = [c for c in refs.columns if c not in ("space", "ref", "at", "status")]
    named = refs.select(F.struct(*carried).alias("carried"), "space", "ref", "at")
    found = orphans_by_mask(named, targets, [("space", "space"), ("ref", "ref")], "simple", ("at", "start", "stop"))
    return found.select("carried.*", "status")


def orphan_counts(orphans: DataFrame, period: str = "month", by: tuple[str, ...] = ("tbl", "field", "status"), at: str = "at") -> DataFrame:
    """Orphans per table, field, status and calendar `period` of `at`; null `at` has its own, null, period."""
    return orphans.groupBy(*by, F.date_trunc(period, F.col(at)).alias("period")).agg(F.count(F.lit(1)).alias("orphans"))
