"""Unified diffs as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_HUNK = r"^@@ -\d+(?:,\d+)? \+(\d+)(?:,(\d+))? @@"


def diff_lines(diffs: DataFrame, key: str, text: str = "diff") -> DataFrame:
    """One row a line of each diff: file, segment, hunk, tag (add, del, ctx) and the line's number on the new side, null for deletions.

    The file is the last '+++' name above, b/ taken off, none for /dev/null. Lines before the first hunk header of a segment are headers and left
    out; a diff without any header is one hunk from line 1.
    """
    rows = diffs.where(F.col(text).isNotNull()).select(key, F.posexplode(F.split(F.col(text), "\n")).alias("pos", "line"))
    w = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    c = F.col("line")
    is_file, is_hunk = c.startswith("+++ "), c.rlike(_HUNK)
    name = F.regexp_replace(F.expr("substring(line, 5)"), "^b/", "")
    head = is_file | c.startswith("--- ") | c.startswith("diff --git") | is_hunk
    rows = rows.withColumns(
        {
            "file": F.nullif(F.last(F.when(is_file, name), ignorenulls=True).over(w), F.lit("/dev/null")),
            "segment": F.sum(is_file.cast("int")).over(w),
            "hunk": F.sum(is_hunk.cast("int")).over(w),
            "start": F.last(F.when(is_hunk, F.regexp_extract("line", _HUNK, 1).cast("int")), ignorenulls=True).over(w),
            "head": head,
            "in_hunk": F.last(F.when(head, is_hunk), ignorenulls=True).over(w),
        }
    )
    body = rows.where(~F.col("head") & F.coalesce("in_hunk", F.lit(True)) & (F.col("line") != ""))
    tag = F.when(F.col("line").startswith("+"), "add").when(F.col("line").startswith("-"), "del").otherwise("ctx")
    body = body.withColumn("tag", tag)
    within = Window.partitionBy(key, "segment", "hunk").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    new = F.sum((F.col("tag") != "del").cast("int")).over(within) - 1 + F.coalesce("start", F.lit(1))
    return body.select(key, "pos", "file", "segment", "hunk", "tag", F.when(F.col("tag") != "del", new).cast("int").alias("new_line"), F.expr("substring(line, 2)").alias("content"))


def diff_hunks(diffs: DataFrame, key: str, text: str = "diff") -> DataFrame:
    """(key, file, start, stop) of the hunks on the new side; hunks without new lines and deleted files are left out."""
    rows = diffs.where(F.col(text).isNotNull()).select(key, F.posexplode(F.split(F.col(text), "\n")).alias("pos", "line"))
    w = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    name = F.regexp_replace(F.expr("substring(line, 5)"), "^b/", "")
    rows = rows.withColumn("file", F.last(F.when(F.col("line").startswith("+++ "), name), ignorenulls=True).over(w)).where(F.col("line").rlike(_HUNK) & (F.col("file") != "/dev/null"))
    start, n = F.regexp_extract("line", _HUNK, 1).cast("int"), F.coalesce(F.nullif(F.regexp_extract("line", _HUNK, 2), F.lit("")).cast("int"), F.lit(1))
    return rows.where(n > 0).select(key, "file", start.alias("start"), (start + n - 1).alias("stop"))


def file_changes(diffs: DataFrame, key: str, text: str = "diff") -> DataFrame:
    """(key, segment, file, status, binary, added, deleted) per file of each diff: added, deleted, renamed or modified."""
    rows = diffs.where(F.col(text).isNotNull()).select(key, F.posexplode(F.split(F.col(text), "\n")).alias("pos", "line"))
    w = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    c = F.col("line")
    rows = rows.withColumn("segment", F.sum(c.startswith("diff --git").cast("int")).over(w)).where("segment > 0")
    any_ = lambda cond: F.max(cond.cast("int")) == 1
    plus, minus = c.startswith("+") & ~c.startswith("+++ "), c.startswith("-") & ~c.startswith("--- ")
    g = rows.groupBy(key, "segment").agg(
        F.max(F.when(c.startswith("diff --git"), F.regexp_extract("line", r" b/(.+)$", 1))).alias("file"),
        any_(c.startswith("new file mode")).alias("new"), any_(c.startswith("deleted file mode")).alias("gone"), any_(c.startswith("rename to ")).alias("moved"), any_(c.startswith("Binary files ")).alias("binary"),
        F.sum(plus.cast("bigint")).alias("added"), F.sum(minus.cast("bigint")).alias("deleted"),
    )
    status = F.when(F.col("new"), "added").when(F.col("gone"), "deleted").when(F.col("moved"), "renamed").otherwise("modified")
    return g.select(key, "segment", "file", status.alias("status"), "binary", "added", "deleted")
