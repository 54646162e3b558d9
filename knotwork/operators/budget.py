"""Packing of sections into a token budget."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def tokens(text: str) -> int:
    return math.ceil(len(text.encode("utf-16-le")) // 2 / 4)


def pack(sections: list[tuple[str, list[str]]], budget: int) -> list[tuple[str, int, int]]:
    """(heading, kept, dropped) for each of `sections` (heading, items) in their order, within `budget` tokens; 0 is no limit.

    A token is four UTF-16 units. A section costs its heading and one token, then items in order, each with one token more, until one does not
    fit. A section whose heading and first item do not fit is dropped whole, and later ones still get their chance.
    """
    out, used = [], 0
    for heading, items in sections:
        if not budget or budget < 0:
            out.append((heading, len(items), 0))
            continue
        cost, kept = tokens(heading) + 1, 0
        if items and used + cost <= budget:
            for item in items:
                more = tokens(item) + 1
                if used + cost + more > budget:
                    break
                cost, kept = cost + more, kept + 1
        if kept:
            used += cost
        out.append((heading, kept, len(items) - kept))
    return out


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("section", T.StringType()), T.StructField("kept", T.IntegerType()), T.StructField("dropped", T.IntegerType())])))
def _packed(items: pd.Series, budget: pd.Series) -> pd.Series:
    def one(rows, limit) -> list[tuple[str, int, int]]:
        sections: dict[tuple[int, str], list[str]] = {}
        for r in sorted(rows, key=lambda r: (r["section_order"], r["position"])):
            sections.setdefault((r["section_order"], r["section"]), []).append(r["item"])
        return pack([(name, list_) for (_, name), list_ in sections.items()], int(limit))

    return pd.Series([one(r, b) for r, b in zip(items, budget)])


def pack_groups(df: DataFrame, key: str, budget: int) -> DataFrame:
    """(key, section, kept, dropped) of `pack` for each packet: rows (key, section, section_order, position, item).

    What is kept depends on all that came before, across sections, so a packet is worked out in Python, many packets a batch. The rows of
    one packet are gathered: give at most a fixed number of rows for each section, as the top of a ranking.
    """
    packets = df.groupBy(key).agg(F.collect_list(F.struct("section_order", "position", "section", "item")).alias("rows"))
    return packets.select(key, F.explode(_packed("rows", F.lit(budget))).alias("p")).select(key, "p.section", "p.kept", "p.dropped")
