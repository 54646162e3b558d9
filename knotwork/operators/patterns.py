"""Joins of names with patterns, without a nested loop: names offer keys, patterns are looked up among them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _kind(p: Column, files: bool) -> tuple[Column, Column]:
    """(kind, key) of a pattern: for symbols prefix* and *suffix, for files folder/* and beginning**, else exact."""
    if files:
        return F.when(p.endswith("/*") | p.endswith("**"), "prefix").otherwise("exact"), F.when(p.endswith("/*"), F.regexp_replace(p, r"\*$", "")).when(p.endswith("**"), F.regexp_replace(p, r"\*\*$", "")).otherwise(p)
    return F.when(p.endswith("*"), "prefix").when(p.startswith("*"), "suffix").otherwise("exact"), F.when(p.endswith("*"), F.regexp_replace(p, r"\*$", "")).otherwise(F.regexp_replace(p, r"^\*", ""))


def pattern_matches(names: DataFrame, patterns: DataFrame, files: bool = False) -> DataFrame:
    """(name, pattern) for every name that a pattern fits. Symbols: equal, prefix*, *suffix, or the part after a '.' or '/'; files: equal, folder/*, beginning**.

    A name offers its prefixes and suffixes only in the lengths that patterns have (one row of distinct lengths, at most as many as the longest
    pattern has characters), so that a name costs as many keys as there are lengths, not as it has characters. Nulls fit nothing; repeated rows come once.
    """
    kind, key = _kind(F.col("pattern"), files)
    wanted = patterns.select("pattern").dropna().distinct().select("pattern", kind.alias("kind"), key.alias("key"))
    n = F.length("key")
    lengths = wanted.agg(*(F.collect_set(F.when(F.col("kind") == k, n)).alias(k) for k in ("prefix", "suffix")))
    q, size = F.col("name"), F.length("name")
    offer = lambda k, v: F.struct(F.lit(k).alias("kind"), v.alias("key"))
    some = lambda k: F.filter(k, lambda i: i <= size)
    keys = [F.array(offer("exact", q)), F.transform(some("prefix"), lambda i: offer("prefix", F.substr(q, F.lit(1), i)))]
    if not files:
        keys.append(F.transform(some("suffix"), lambda i: offer("suffix", F.right(q, i))))
        tails = F.filter(F.sequence(F.lit(1), size), lambda i: F.substr(q, i, F.lit(1)).isin(".", "/"))
        keys.append(F.transform(tails, lambda i: offer("exact", F.substr(q, i + 1))))
    offers = names.select("name").where("name <> ''").distinct().join(F.broadcast(lengths)).select("name", F.explode(F.array_distinct(F.concat(*keys))).alias("o"))
    return offers.select("name", "o.kind", "o.key").join(wanted, ["kind", "key"]).select("name", "pattern").distinct()
