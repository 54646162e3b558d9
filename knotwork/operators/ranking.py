"""Ranking operators: first rows, top rows, caps and severity order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Severities in rising order.
NOTE_SEVERITY = {"low": 1, "medium": 2, "high": 3}
ISSUE_SEVERITY = {"info": 1, "warn": 2, "block": 3}


def severity_rank(c: Column | str, ranks: dict[str, int] = NOTE_SEVERITY) -> Column:
    """Rank of a severity, 0 where it is null or unknown."""
    c = F.col(c) if isinstance(c, str) else c
    out = F.lit(0)
    for name, rank in ranks.items():
        out = F.when(c == name, F.lit(rank)).otherwise(out)
    return out


def top_by(df: DataFrame, keys: list[str], order: list, n: int, rank: str | None = None) -> DataFrame:
    """The first `n` rows of each group of `keys` in `order`; `rank` names a column for the position. Group limits are pushed below the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    name = rank or "_rank"
    out = df.withColumn(name, F.row_number().over(w)).where(F.col(name) <= n)
    return out if rank else out.drop(name)


def first_by(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each group in `order`, so that the order, not chance, decides between repeated rows."""
    return top_by(df, keys, order, 1)


def smallest(df: DataFrame, keys: list[str], by: str, *columns: str) -> DataFrame:
    """For each group the values of `columns` in the row with the smallest `by`, as an aggregate that combines before the shuffle."""
    return df.groupBy(*keys).agg(*(F.min_by(c, by).alias(c) for c in columns))
