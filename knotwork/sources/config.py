"""Settings of a repository."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# What holds where a configuration says nothing. Folders given are added to those that are always passed over.
DEFAULTS = {
    "languages": "typescript,python,go,rust,java,ruby,csharp",
    "exclude": "node_modules,dist,build,.git,.venv,__pycache__,vendor",
    "depth": "3",
    "strands": "structural,tests,provenance,invariants",
    "capture": "auto",
    "promote": "safe",
}


def settings(configs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, option, value) of every option of each configuration: `option: value` lines, lists as [a, b] or as `- a` lines below; comments and unknown options are passed over.

    Lists are joined by commas. A null or empty text has the defaults only; of an option given twice the last counts.
    """
    lines = F.filter(F.transform(F.split(F.coalesce(F.col(text), F.lit("")), "\n"), lambda x: F.rtrim(F.regexp_replace(x, "(?:^|\\s)#.*$", ""))), lambda x: F.trim(x) != "")
    joined = F.regexp_replace(F.array_join(lines, "\n"), r"\n\s*-\s+", ",")  # the items of a list follow their option
    rows = configs.select(key, F.posexplode_outer(F.split(joined, "\n")).alias("_i", "_l"))
    option = F.trim(F.regexp_extract("_l", r"^([a-z_]+)\s*:", 1))
    value = F.regexp_replace(F.regexp_replace(F.regexp_replace("_l", r"^[a-z_]+\s*:\s*", ""), r"[\[\]\"']|^,", ""), r"\s*,\s*", ",")
    given = rows.select(key, option.alias("option"), F.trim(value).alias("value"), "_i").where(F.col("option").isin(list(DEFAULTS))).groupBy(key, "option").agg(F.max_by("value", "_i").alias("given"))
    every = configs.select(key, F.explode(F.map_from_arrays(F.array(*map(F.lit, DEFAULTS)), F.array(*map(F.lit, DEFAULTS.values())))).alias("option", "usual"))
    both = F.when(F.col("given").isNull(), F.col("usual")).when(F.col("option") == "exclude", F.concat("usual", F.lit(","), "given")).otherwise(F.col("given"))
    return every.join(given, [key, "option"], "left").select(key, "option", both.alias("value"))
