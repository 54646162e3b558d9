"""Joins of line ranges within a file, and of paths with the folders above them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def overlaps(left: DataFrame, right: DataFrame, width: int = 128) -> DataFrame:
    """Pairs of rows whose closed ranges [lo, hi] in the same `file` overlap. left: file, lo, hi, l; right: file, lo, hi, r. Gives (l, r).

    Ranges are cut into bins of `width` lines and joined on (file, bin), so that a file with very many ranges is spread over its bins and only
    neighbours are compared; a pair is kept in the bin where the later one begins, hence once. Rows with a null file or bound meet nothing.
    """
    bins = lambda lo, hi: F.explode(F.sequence(F.floor(F.col(lo) / width), F.floor(F.col(hi) / width)))
    a = left.where("file IS NOT NULL AND lo <= hi").select("file", F.col("lo").alias("lo1"), F.col("hi").alias("hi1"), "l", bins("lo", "hi").alias("bin"))
    b = right.where("file IS NOT NULL AND lo <= hi").select("file", F.col("lo").alias("lo2"), F.col("hi").alias("hi2"), "r", bins("lo", "hi").alias("bin"))
    met = a.join(b, ["file", "bin"]).where("lo1 <= hi2 AND lo2 <= hi1")
    return met.where(F.col("bin") == F.floor(F.greatest("lo1", "lo2") / width)).select("l", "r")


def folders_above(path: Column) -> Column:
    """All folders above `path`, the nearest last; none for a file at the root."""
    parts = F.split(path, "/")
    return F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))).otherwise(F.array().cast("array<string>"))


def folder_of(path: Column) -> Column:
    """The folder of `path`, '' at the root."""
    return F.regexp_replace(path, r"/?[^/]*$", "")
