"""Numbers and carried values along an order, in parts: a hot key is spread over the ranges of its order, and only one row a range is looked at as a whole."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _parts(df: DataFrame, keys: list[str], part: Column) -> DataFrame:
    return df.withColumns({"_k": F.to_json(F.struct(*keys)), "_p": F.coalesce(part.cast("bigint"), F.lit(-(2**62)).cast("bigint"))})


def numbered(df: DataFrame, keys: list[str], part: Column, order: list, name: str) -> DataFrame:
    """`df` with the row number, from 1, within each of `keys` in `order`. `part` is a whole number that rises with the order; null comes first.

    Rows are numbered within (keys, part) and offset by the rows of the parts before, whose counts combine on the map side. Null keys are a group.
    """
    df = _parts(df, keys, part)
    counts = df.groupBy("_k", "_p").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("_k").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("_k", "_p", F.coalesce(before, F.lit(0)).alias("_o"))
    own = F.row_number().over(Window.partitionBy("_k", "_p").orderBy(*order))
    return df.withColumn("_i", own).join(offsets, ["_k", "_p"]).withColumn(name, (F.col("_i") + F.col("_o")).cast("int")).drop("_k", "_p", "_i", "_o")


def carried(df: DataFrame, keys: list[str], part: Column, order: list[str], value: str, name: str, own: bool = True) -> DataFrame:
    """`df` with the last value of `value` that is not null among the rows before each (with `own`, and itself) within `keys`, by the columns `order`. `part` as in `numbered`.

    Within (keys, part) by a window; for the parts before, only the last value of each part is carried on.
    """
    df = _parts(df, keys, part)
    within = F.last(value, ignorenulls=True).over(Window.partitionBy("_k", "_p").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if own else -1))
    lasts = df.groupBy("_k", "_p").agg(F.max_by(value, F.when(F.col(value).isNotNull(), F.struct(*order))).alias("_v"))
    before = F.last("_v", ignorenulls=True).over(Window.partitionBy("_k").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1))
    return df.withColumn("_w", within).join(lasts.select("_k", "_p", before.alias("_c")), ["_k", "_p"]).withColumn(name, F.coalesce("_w", "_c")).drop("_k", "_p", "_w", "_c")


def picked(df: DataFrame, keys: list[str], value: str, tie: str, percents: list[int], width: float = 1.0) -> DataFrame:
    """(keys, percent, value): the value at rank floor(percent * n / 100) from 0, the last at most, of each of `keys` in the order of (value, tie).

    Counts by ranges of `width` find the range in which each rank lies; only the rows of those ranges are ordered.
    """
    df = _parts(df.where(F.col(value).isNotNull()), keys, F.floor(F.col(value) / width))
    counts = df.groupBy("_k", "_p").agg(F.count(F.lit(1)).alias("_n"))
    own = Window.partitionBy("_k")
    counts = counts.withColumns({"_all": F.sum("_n").over(own), "_before": F.coalesce(F.sum("_n").over(own.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))})
    rank = F.least(F.col("_all") - 1, F.floor(F.col("percent") * F.col("_all") / 100))
    wanted = counts.withColumn("percent", F.explode(F.array(*map(F.lit, percents)))).withColumn("_r", rank - F.col("_before")).where("_r >= 0 AND _r < _n").select("_k", "_p", "percent", "_r")
    near = df.select(*keys, value, tie, "_k", "_p").join(wanted, ["_k", "_p"])
    i = F.row_number().over(Window.partitionBy("_k", "percent").orderBy(value, tie)) - 1
    return near.withColumn("_i", i).where("_i = _r").select(*keys, "percent", value)
