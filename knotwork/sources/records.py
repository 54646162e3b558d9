"""JSON records, managed blocks, and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.ranking import first_by


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records of a JSON-lines log; lines that cannot be read are left out."""
    known = T._parse_datatype_string(schema)
    full = T.StructType([*known.fields, T.StructField("_bad", T.StringType())])
    rows = spark.read.schema(full).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(path)
    return rows.where(F.col("_bad").isNull()).drop("_bad")


def json_records(lines: DataFrame, line: str, schema: str) -> DataFrame:
    """Records of the JSON text in `line`; lines that cannot be read, and nulls, are left out."""
    read = F.from_json(F.col(line), f"{schema}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    return lines.select(read.alias("r")).where("r IS NOT NULL AND r._bad IS NULL").select("r.*").drop("_bad")


def tail(df: DataFrame, n: int, order: str = "seq") -> DataFrame:
    """The last `n` records by their own sequence, as files have no order."""
    return df.orderBy(F.desc(order)).limit(n)


def events_of(df: DataFrame, text: str, schema: str) -> DataFrame:
    """Events of documents that are an array, or an object with an array in `events`, with the other columns."""
    value = F.trim(text)
    bare = F.from_json(F.when(value.startswith("["), value), f"array<struct<{schema}>>")
    wrapped = F.from_json(F.when(value.startswith("{"), value), f"events array<struct<{schema}>>")["events"]
    return df.select(*(c for c in df.columns if c != text), F.inline(F.coalesce(bare, wrapped)))


def events_document(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Events of documents that are an array, or an object with an array in `events`."""
    text = spark.read.text(path, wholetext=True)
    return events_of(text, "value", schema)


_BLOCK = r"(?s)<!-- lessons:begin -->\n(.*?)<!-- lessons:end -->"
_ENTRY = r"^- \[([a-z]+)\] (.*?) <!-- id:([0-9a-f]{12}) (\S+) -->$"


def managed_block(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, id, severity, lesson, recorded_at) of the entries in the managed block of each text."""
    lines = docs.select(key, F.explode(F.split(F.regexp_extract(F.col(text), _BLOCK, 1), "\n")).alias("l")).where(F.col("l").rlike(_ENTRY))
    g = lambda i: F.regexp_extract("l", _ENTRY, i)
    return lines.select(key, g(3).alias("id"), g(1).alias("severity"), g(2).alias("lesson"), F.try_to_timestamp(g(4)).alias("recorded_at"))


def managed_block_text(entries: DataFrame, key: str) -> DataFrame:
    """The managed block of each key as text, entries in order of id."""
    line = F.concat(F.lit("- ["), "severity", F.lit("] "), "lesson", F.lit(" <!-- id:"), "id", F.lit(" "), F.date_format("recorded_at", "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit(" -->"))
    lines = entries.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("id", line.alias("line")))).alias("ls"))
    return lines.select(key, F.concat(F.lit("<!-- lessons:begin -->\n"), F.array_join(F.transform("ls", lambda x: x["line"]), "\n"), F.lit("\n<!-- lessons:end -->")).alias("text"))


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """`old` with rows of `new` put in by `key`: a new row replaces the old one; of equal new keys the last given, by all columns, stays."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    order = [F.desc("_new"), *(F.desc(c) for c in old.columns if c != key)]
    return first_by(both, [key], order).drop("_new")


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def replace(df: DataFrame, path: str, *partition: str) -> None:
    df.write.mode("overwrite").partitionBy(*partition).parquet(path)
