"""Problem 7: a mixture of sources with target shares of all tokens, drawn by Pareto order sampling."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.keys import fingerprint
from ..session import cut
from ..sources.tables import table

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the split pattern that goes with this vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# Parts of the rank scale in which tokens are added up; the order is exact within the one part where a source reaches its size.
PARTS = 1 << 16
_ENCODERS: dict[str, object] = {}


def _encoder(path: str):
    import tiktoken

    if path not in _ENCODERS:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _ENCODERS[path] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODERS[path]


def with_tokens(documents: DataFrame, vocabulary: str = VOCABULARY, text: str = "text") -> DataFrame:
    """`documents` with `tokens`, the tokens of the whole `text` under the tokenizer in file `vocabulary`, instead of the text; 0 for null."""
    kept = [f for f in documents.schema.fields if f.name != text]
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(vocabulary)
        for batch in batches:
            n = [0 if x is None else len(encoder.encode_ordinary(x)) for x in batch.column(len(names)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(names))), pa.array(n, pa.int64())], names=[*names, "tokens"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), "tokens bigint"])
    return documents.select(*names, text).mapInArrow(run, schema)


def canonical_source(c: Column) -> Column:
    """A source in one spelling: lower case, without blanks around it, '_' between words."""
    return F.regexp_replace(F.lower(F.btrim(c)), r"[\s-]+", "_")


def _level(classes: list[tuple[int, int]], cap: int, wanted: float) -> float:
    """The level h with sum(min(cap, h / 2**j) * tokens) = wanted over `classes` of (j, tokens); the highest that matters where all are at the cap."""
    at_cap, open_ = 0, sorted(classes)
    while open_:
        j, tokens = open_[0]
        rate = sum(t / 2**i for i, t in open_)
        h = (wanted - cap * at_cap) / rate
        if h / 2**j <= cap:
            return max(h, 0.0)
        at_cap += tokens
        open_.pop(0)
    return float(cap * 2 ** max((j for j, _ in classes), default=0))


def plan(sizes: dict[str, list[tuple[int, int]]], targets: list[tuple[str, float, int]], total: float | None = None) -> dict[str, dict]:
    """What each source gives: its share among those that have documents, its tokens and its level of copies.

    sizes: (j, tokens) by source, for documents whose text occurs about 2**j times in the source. Without `total` the mixture is the largest
    in which every source reaches its share within its cap, so that the actual shares are the targets; a given total above that is met
    as far as the caps allow. Targets without documents get nothing, and the others share their part in proportion.
    """
    there = {s: (share, cap) for s, share, cap in targets if share and cap and sum(t for _, t in sizes.get(s, [])) > 0}
    whole = sum(share for share, _ in there.values())
    most = {s: cap * sum(t for _, t in sizes[s]) for s, (_, cap) in there.items()}
    if total is None:
        total = min((most[s] * whole / share for s, (share, _) in there.items()), default=0.0)
    out = {}
    for s, (share, cap) in there.items():
        wanted = float(min(total * share / whole, most[s]))
        out[s] = {"share": share / whole, "wanted": wanted, "cap": cap, "level": _level(sizes[s], cap, wanted)}
    return out


def mixture(documents: DataFrame, targets: DataFrame, seed: int = 2026, total: float | None = None, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, source, tokens, repeats) of the mixture of `documents` (doc_id, source, text) by `targets` (source, target_share, max_repeats).

    Each document is due a number of copies in proportion to its weight, which is one over the number of documents of its source with
    the same text (to the power of two below), so that repeated texts are not used more often for it, and never above max_repeats;
    the level is set so that the source's tokens meet its target (see `plan`). Whole copies are certain. For the fraction p that is left, documents
    are ranked by random odds over inclusion odds, u/(1-u) / (p/(1-p)) with u a hash of seed and doc_id, and the first ones whose
    tokens make up what is missing get one copy more: a sample of fixed size with unequal chances. Ranks are not sorted at large: tokens are added up
    in PARTS parts of the scale, and only the part in which a source reaches its size is put in order, so that no source, however
    large, is one task. Documents with null, unknown or untargeted sources, or without tokens, take no part. Equal seeds give equal mixtures.
    """
    docs = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), canonical_source(F.col("source")).alias("source"), "text")
    known = targets.select(canonical_source(F.col("source")).alias("source"), "target_share", "max_repeats")
    a, b = fingerprint("text")
    sized = with_tokens(docs.join(known.select("source"), "source", "left_semi").select("doc_id", "source", a.alias("t1"), b.alias("t2"), "text"), vocabulary)
    sized = cut(sized.where("tokens > 0"))
    repeated = sized.groupBy("source", "t1", "t2").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("source", "t1", "t2", F.floor(F.log2("n")).cast("int").alias("j"))
    classed = sized.join(repeated, ["source", "t1", "t2"], "left").select("doc_id", "source", "tokens", F.coalesce("j", F.lit(0)).alias("j"))
    sizes: dict[str, list[tuple[int, int]]] = {}
    for r in classed.groupBy("source", "j").agg(F.sum("tokens").alias("tokens")).collect():  # at most 64 rows a source
        sizes.setdefault(r["source"], []).append((r["j"], r["tokens"]))
    parts = plan(sizes, [tuple(r) for r in known.collect()], total)
    due = [(s, j, min(float(p["cap"]), p["level"] / 2**j), p["wanted"]) for s, p in parts.items() for j, _ in sizes[s]]
    spark = documents.sparkSession
    due_rows = spark.createDataFrame(due, "source string, j int, due double, wanted double")
    ranked = classed.join(F.broadcast(due_rows), ["source", "j"])  # at most 64 rows a source
    whole = F.floor(F.col("due") + 1e-9)
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id"), 11).cast("double") + 0.5) / float(1 << 53)
    ranked = ranked.withColumns({"whole": whole, "p": F.greatest(F.col("due") - whole, F.lit(0.0)), "u": u})
    odds = (F.col("u") / (1 - F.col("u"))) * ((1 - F.col("p")) / F.col("p"))
    ranked = ranked.withColumn("rank", F.when(F.col("p") > 1e-9, odds / (1 + odds)))
    ranked = ranked.withColumn("part", F.floor(F.col("rank") * PARTS).cast("int"))
    by_part = ranked.groupBy("source", "part").agg(F.sum(F.when(F.col("part").isNotNull(), F.col("tokens")).otherwise(0)).alias("tokens"), F.sum(F.col("whole") * F.col("tokens")).alias("certain"), F.max("wanted").alias("wanted"))
    own = Window.partitionBy("source")
    by_part = by_part.withColumn("missing", F.col("wanted") - F.sum("certain").over(own)).where("part IS NOT NULL")
    by_part = by_part.withColumn("before", F.sum("tokens").over(own.orderBy("part")) - F.col("tokens"))
    reached = by_part.where((F.col("before") < F.col("missing")) & (F.col("before") + F.col("tokens") >= F.col("missing"))).select("source", F.col("part").alias("last_part"), (F.col("missing") - F.col("before")).alias("room"))
    all_in = by_part.groupBy("source").agg((F.sum("tokens") < F.max("missing")).alias("all_in"))
    placed = ranked.join(F.broadcast(reached), "source", "left").join(F.broadcast(all_in), "source", "left")  # one row a source
    at_edge = placed.where(F.col("part") == F.col("last_part"))
    order = Window.partitionBy("source").orderBy("rank", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    edge = at_edge.withColumn("sum", F.sum("tokens").over(order)).withColumn("extra", (F.col("sum") - F.col("tokens") / 2 <= F.col("room")).cast("int"))
    rest = placed.where(F.col("part").isNull() | F.col("last_part").isNull() | (F.col("part") != F.col("last_part")))
    rest = rest.withColumn("extra", F.coalesce((F.col("part") < F.col("last_part")) | (F.col("part").isNotNull() & F.col("all_in")), F.lit(False)).cast("int"))
    cols = ["doc_id", "source", "tokens", (F.col("whole") + F.col("extra")).cast("int").alias("repeats")]
    return rest.select(*cols).unionByName(edge.select(*cols)).where("repeats > 0")


def p7_mixture(spark: SparkSession, sf: str) -> DataFrame:
    """The chosen documents with their repeats."""
    return mixture(table(spark, sf, "documents", "doc_id", "source", "text"), table(spark, sf, "source_targets"))


def p7_shares(spark: SparkSession, sf: str) -> DataFrame:
    """Target and actual share of each source, with its documents, tokens and highest repeat."""
    targets = table(spark, sf, "source_targets")
    mixed = mixture(table(spark, sf, "documents", "doc_id", "source", "text"), targets)
    sums = mixed.groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.sum(F.col("tokens") * F.col("repeats")).alias("mixed_tokens"), F.max("repeats").alias("highest_repeat"))
    out = targets.select(canonical_source(F.col("source")).alias("source"), "target_share", "max_repeats").join(F.broadcast(sums), "source", "left")
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("documents", "mixed_tokens", "highest_repeat")}
    out = out.withColumns(zero)
    return out.withColumn("actual_share", F.round(F.col("mixed_tokens") / F.sum("mixed_tokens").over(Window.partitionBy()), 6))


QUERIES = {"p7_mixture": p7_mixture, "p7_shares": p7_shares}
SQL: dict[str, str] = {}
