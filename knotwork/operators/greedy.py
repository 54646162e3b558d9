"""Operators whose result depends on the order of rows: star clusters and folding of repeats."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame


def _jaccard(a: frozenset, b: frozenset) -> float:
    return len(a & b) / len(a | b) if a and b else 0.0


def star_clusters(df: DataFrame, group: str, threshold: float = 0.4, least: int = 3) -> DataFrame:
    """(group, head, members) of the star clusters of each group: rows (group, ord, key, tokens, n), n equal texts counted as one row.

    In order, each row not yet clustered is a head and takes the later free rows of Jaccard `threshold` or more to it, not to each other; the cluster
    stands if it has `least` members, and its rows are then taken. The outcome depends on that order, so a group is one Python call, over
    distinct token sets only. An index from token to rows finds the rows that share any token with a head.
    """

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("ord")
        sets, counts, keys = [frozenset(t) for t in g["tokens"]], list(g["n"]), list(g["key"])
        rows_with: dict[str, list[int]] = {}
        for i, s in enumerate(sets):
            for t in s:
                rows_with.setdefault(t, []).append(i)
        taken, out = set(), []
        for i, s in enumerate(sets):
            if i in taken:
                continue
            shared: dict[int, int] = {}
            for t in s:
                for j in rows_with[t]:
                    if j > i and j not in taken:
                        shared[j] = shared.get(j, 0) + 1
            cluster = [i, *(j for j, c in sorted(shared.items()) if c / (len(s) + len(sets[j]) - c) >= threshold)]
            size = sum(counts[j] for j in cluster) if s else 1
            if size >= least:
                taken.update(cluster)
                out.append((g[group].iloc[0], keys[i], size))
        return pd.DataFrame(out, columns=[group, "head", "members"])

    return df.groupBy(group).applyInPandas(run, f"{group} string, head bigint, members bigint")


def fold_repeats(df: DataFrame, group: str, gate: float = 0.5) -> DataFrame:
    """(group, head, count, confidence): each row in order joins the kept lesson of highest Jaccard, `gate` or more, the last one of equals, or is kept itself.

    Rows (group, ord, key, tokens, confidence). The count and the highest confidence are kept; what a row joins depends on all before it.
    """

    def run(g: pd.DataFrame) -> pd.DataFrame:
        kept: list[list] = []
        with_token: dict[str, set[int]] = {}
        for r in g.sort_values("ord").itertuples():
            s = frozenset(r.tokens)
            best, at = gate, None
            for i in sorted({i for t in s for i in with_token.get(t, ())}):
                score = _jaccard(s, kept[i][1])
                if score >= best:
                    best, at = score, i
            confidence = 0.0 if pd.isna(r.confidence) else float(r.confidence)
            if at is None:
                kept.append([r.key, s, 1, confidence])
                for t in s:
                    with_token.setdefault(t, set()).add(len(kept) - 1)
            else:
                kept[at][2] += 1
                kept[at][3] = max(kept[at][3], confidence)
        return pd.DataFrame([(g[group].iloc[0], k, n, c) for k, _, n, c in kept], columns=[group, "head", "count", "confidence"])

    return df.groupBy(group).applyInPandas(run, f"{group} string, head bigint, count bigint, confidence double")
