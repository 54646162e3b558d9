"""Problem 6: passages of evaluation items inside training documents, found with suffix arrays of the training text."""

from __future__ import annotations

import itertools
import re
import unicodedata
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.dataset as ds
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut, ensure_checkpoint_dir
from ..sources.tables import table

# Shortest passage that counts, in words.
MIN_WORDS = 13
# Words of training text in one suffix array, words of evaluation text searched at a time, and places of passages followed at a time; they bound memory only.
SHARD_WORDS, BLOCK_WORDS, OCCURRENCES = 1_500_000, 200_000, 2_000_000

_MARKUP = re.compile(r"</?[A-Za-z][A-Za-z0-9-]*(?:\s[^<>]*)?/?>|&(?:[A-Za-z]{2,8}|#\d{1,6});")
_WORD = re.compile(r"[^\W_]+")


def words_of(text: str | None) -> list[str]:
    """Runs of letters and digits without regard to case; markup and what stands between them are passed over."""
    if not text:
        return []
    if not text.isascii():
        text = unicodedata.normalize("NFC", text)
    if "<" in text or "&" in text:
        text = _MARKUP.sub(" ", text)
    return _WORD.findall(text.casefold())


def suffix_array(tokens: np.ndarray, depth: int) -> np.ndarray:
    """Positions of `tokens` (ids of 0 and more) in the order of the `depth` or more tokens that follow, by prefix doubling."""
    n = len(tokens)
    rank = np.unique(tokens, return_inverse=True)[1].astype(np.int64)
    order = np.argsort(rank, kind="stable")
    length = 1
    while length < depth and n:
        after = np.zeros(n, np.int64)
        if length < n:
            after[: n - length] = rank[length:] + 1
        both = rank * (n + 1) + after
        order = np.argsort(both, kind="stable")
        ranked = both[order]
        new = np.empty(n, np.int64)
        new[order] = np.concatenate(([0], np.cumsum(ranked[1:] != ranked[:-1])))
        rank, length = new, length * 2
        if n and rank[order[-1]] == n - 1:
            break
    return order


def _narrow(tokens: np.ndarray, order: np.ndarray, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of `queries` (k tokens), the range of `order` whose suffixes begin with it: one binary search for all rows at once."""
    k = queries.shape[1]
    padded = np.concatenate((tokens, np.full(k, -1, tokens.dtype)))

    def search(right: bool) -> np.ndarray:
        lo, hi = np.zeros(len(queries), np.int64), np.full(len(queries), len(order), np.int64)
        while True:
            open_ = np.flatnonzero(lo < hi)
            if not len(open_):
                return lo
            mid = (lo[open_] + hi[open_]) // 2
            at, state = order[mid], np.zeros(len(open_), np.int8)
            for i in range(k):
                here = padded[at + i]
                want = queries[open_, i]
                state = np.where(state == 0, np.sign(here - want).astype(np.int8), state)
            below = state <= 0 if right else state < 0
            lo[open_[below]] = mid[below] + 1
            hi[open_[~below]] = mid[~below]

    return search(False), search(True)


class _Shard:
    """Words of some documents in one array, with a separator that occurs in no query after each."""

    def __init__(self) -> None:
        self.ids: dict[str, int] = {}
        self.parts: list[np.ndarray] = []
        self.docs: list[int] = []
        self.size = 0

    def add(self, doc: int, words: list[str]) -> None:
        ids = self.ids
        self.parts.append(np.fromiter((ids.setdefault(w, len(ids) + 1) for w in words), np.int64, len(words)))
        self.docs.append(doc)
        self.size += len(words) + 1

    def built(self, least: int) -> _Shard:
        """The shard with its suffix array, to be searched for any number of blocks of items."""
        self.starts = np.cumsum([0, *(len(p) + 1 for p in self.parts)])
        self.tokens = np.zeros(self.size, np.int64)
        for s, p in zip(self.starts, self.parts):
            self.tokens[s : s + len(p)] = p
        self.order = suffix_array(self.tokens, least)
        return self

    def matches(self, items: list[tuple[int, list[str]]], least: int) -> Iterator[tuple[int, int, int]]:
        """(document, item, words of the longest verbatim match) for every pair that shares `least` or more consecutive words."""
        known = [np.fromiter((self.ids.get(w, -2) for w in words), np.int64, len(words)) for _, words in items]
        rows, whence = [], []
        first = np.cumsum([0, *(len(k) + 1 for k in known)])
        for n, own in enumerate(known):
            if len(own) >= least:
                windows = np.lib.stride_tricks.sliding_window_view(own, least)
                good = np.flatnonzero((windows >= 0).all(axis=1))
                rows.append(windows[good])
                whence.append(first[n] + 1 + good)
        if not rows:
            return
        sought = np.full(first[-1] + 1, -3, np.int64)  # the items one after the other, parted by what is in no text
        for n, own in enumerate(known):
            sought[first[n] + 1 : first[n] + 1 + len(own)] = own
        queries, offset = np.concatenate(rows), np.concatenate(whence)
        lo, hi = _narrow(self.tokens, self.order, queries)
        longest: dict[tuple[int, int], int] = {}
        at_once = np.searchsorted(np.cumsum(hi - lo), np.arange(OCCURRENCES, int((hi - lo).sum()) + OCCURRENCES, OCCURRENCES), side="left") + 1
        for a, b in zip([0, *at_once[:-1].tolist()], at_once.tolist()):
            n_each = (hi - lo)[a:b]
            q = np.repeat(np.arange(a, min(b, len(lo))), n_each)
            place = self.order[lo[q] + np.arange(len(q)) - np.repeat(np.cumsum(n_each) - n_each, n_each)]
            there = offset[q]
            # a passage counts from its first word: the word before differs
            fresh = (place == 0) | (self.tokens[np.maximum(place - 1, 0)] != sought[there - 1])
            place, there = place[fresh], there[fresh]
            length = np.full(len(place), least, np.int64)
            open_ = np.arange(len(place))
            while len(open_):
                x, y = place[open_] + length[open_], there[open_] + length[open_]
                inside = x < len(self.tokens)
                same = inside & (self.tokens[np.minimum(x, len(self.tokens) - 1)] == sought[y])
                open_ = open_[same]
                length[open_] += 1
            docs = np.searchsorted(self.starts, place, side="right") - 1
            own = np.searchsorted(first, there, side="right") - 1
            for pair, n in zip(zip(docs.tolist(), own.tolist()), length.tolist()):
                if n > longest.get(pair, 0):
                    longest[pair] = n
        for (doc, n), length in longest.items():
            yield self.docs[doc], items[n][0], length


def _blocks(folder: str) -> Iterator[list[tuple[int, list[str]]]]:
    """The items in `folder` (item_id, words), about BLOCK_WORDS words at a time."""
    fs, path = pa.fs.FileSystem.from_uri(folder)
    block: list[tuple[int, list[str]]] = []
    size = 0
    for batch in ds.dataset(path, filesystem=fs, format="parquet").to_batches(columns=["item_id", "words"], batch_size=256):
        for item, words in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if block and size + len(words) > BLOCK_WORDS:
                yield block
                block, size = [], 0
            block.append((item, words))
            size += len(words)
    if block:
        yield block


def leaks(documents: DataFrame, evaluation: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", least: int = MIN_WORDS) -> DataFrame:
    """(doc_id, item_id, words): each document that shares `least` or more consecutive words with an item of `evaluation`, and the longest shared run.

    The items are the stated query set. Their words are written once to the shared folder, and every task reads them from there in blocks of about
    BLOCK_WORDS words, so that neither the driver nor a task holds all of a large set. The documents are read once: each task cuts its documents
    into shards of about SHARD_WORDS words, builds the suffix array of each once and finds every suffix of every item in it by binary
    search: the range of training suffixes that begin with the same `least` words gives all places of the passage, and each passage is
    followed from its first word to its end. No shuffle; memory follows the shard and the block, a longer document is
    searched in pieces that overlap by the longest item. Null and empty texts match nothing; equal documents each come out; an item under `least` words cannot leak.
    Separators keep a match from running over the end of a document. Other columns are not read.
    """
    spark = documents.sparkSession
    folder = f"{ensure_checkpoint_dir(spark)}/items-{uuid.uuid4().hex}"

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, w) for i, w in zip(batch.column(0).to_pylist(), map(words_of, batch.column(1).to_pylist())) if len(w) >= least]
            yield pa.RecordBatch.from_pydict({"item_id": pa.array([i for i, _ in rows], pa.int64()), "words": pa.array([w for _, w in rows], pa.list_(pa.string()))})

    evaluation.select(F.col(item_id).cast("bigint").alias("item_id"), F.col(item_text).alias("text")).where("text IS NOT NULL").mapInArrow(split, "item_id bigint, words array<string>").write.parquet(folder)
    overlap = spark.read.schema("item_id bigint, words array<string>").parquet(folder).agg(F.max(F.size("words"))).first()[0] or 0  # one number

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next(_blocks(folder), None)
        if first is None:
            return
        alone = len(list(itertools.islice(_blocks(folder), 2))) == 1

        def rows(shard: _Shard, again: bool = False) -> Iterator[pa.RecordBatch]:
            shard = shard.built(least)
            best: dict[tuple[int, int], int] = {}
            for block in [first] if alone else _blocks(folder):
                for d, i, n in shard.matches(block, least):
                    best[d, i] = max(n, best.get((d, i), 0))
                if best and not again:
                    yield batch_of(best)
                    best = {}
            if again:
                yield from best.items()

        def batch_of(best: dict[tuple[int, int], int]) -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({doc_id: pa.array([d for d, _ in best], pa.int64()), "item_id": pa.array([i for _, i in best], pa.int64()), "words": pa.array(list(best.values()), pa.int32())})

        def pieces(doc: int, words: list[str]) -> Iterator[pa.RecordBatch]:
            best: dict[tuple[int, int], int] = {}
            for at in range(0, len(words), SHARD_WORDS):
                one = _Shard()
                one.add(doc, words[at : at + SHARD_WORDS + overlap])
                for pair, n in rows(one, True):
                    best[pair] = max(n, best.get(pair, 0))
            if best:
                yield batch_of(best)

        shard = _Shard()
        for batch in batches:
            for doc, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = words_of(body)
                if len(words) < least:
                    continue
                if len(words) > SHARD_WORDS:
                    yield from pieces(doc, words)
                    continue
                if shard.size and shard.size + len(words) > SHARD_WORDS:
                    yield from rows(shard)
                    shard = _Shard()
                shard.add(doc, words)
        if shard.size:
            yield from rows(shard)

    return documents.select(F.col(doc_id).cast("bigint").alias(doc_id), text).where(F.col(text).isNotNull()).mapInArrow(run, f"{doc_id} bigint, item_id bigint, words int")


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    """Documents that hold thirteen or more consecutive words of an item."""
    return leaks(table(spark, sf, "documents", "doc_id", "text"), table(spark, sf, "eval_items")).select("doc_id", "item_id")


def p6_leaked_items(spark: SparkSession, sf: str) -> DataFrame:
    """The items that leaked, with the number of documents and the longest passage."""
    found = leaks(table(spark, sf, "documents", "doc_id", "text"), table(spark, sf, "eval_items"))
    return found.groupBy("item_id").agg(F.count(F.lit(1)).alias("documents"), F.max("words").alias("longest"))


def p6_clean_documents(spark: SparkSession, sf: str) -> DataFrame:
    """The documents that are left once those with a leak are removed."""
    documents = table(spark, sf, "documents", "doc_id", "text")
    found = cut(leaks(documents, table(spark, sf, "eval_items")).select("doc_id").distinct())
    return documents.select("doc_id").join(found, "doc_id", "left_anti")


QUERIES = {"p6_found": p6_found, "p6_leaked_items": p6_leaked_items, "p6_clean_documents": p6_clean_documents}
_GRAMS = r"""
WITH w AS (
  SELECT doc_id AS id, list_filter(string_split(regexp_replace(lower(regexp_replace(text, '</?[A-Za-z][A-Za-z0-9-]*(\s[^<>]*)?/?>|&([A-Za-z]{2,8}|#[0-9]{1,6});', ' ', 'g')), '[^\p{L}\p{N}]+', ' ', 'g'), ' '), lambda x: x <> '') AS ws FROM documents),
e AS (
  SELECT item_id AS id, list_filter(string_split(regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g'), ' '), lambda x: x <> '') AS ws FROM eval_items),
dg AS (SELECT DISTINCT id, list_aggregate(ws[i:i+12], 'string_agg', ' ') AS g FROM w, unnest(range(1, len(ws) - 11)) t(i)),
eg AS (SELECT DISTINCT id, list_aggregate(ws[i:i+12], 'string_agg', ' ') AS g FROM e, unnest(range(1, len(ws) - 11)) t(i)),
found AS (SELECT DISTINCT dg.id AS doc_id, eg.id AS item_id FROM dg JOIN eg USING (g))
"""
# passages as runs of grams on a diagonal
_RUNS = _GRAMS.replace("dg AS (SELECT DISTINCT id,", "dg AS (SELECT id, i AS p,").replace("eg AS (SELECT DISTINCT id,", "eg AS (SELECT id, i AS p,").replace(
    "found AS (SELECT DISTINCT dg.id AS doc_id, eg.id AS item_id FROM dg JOIN eg USING (g))",
    "met AS (SELECT dg.id AS doc_id, eg.id AS item_id, dg.p - eg.p AS diagonal, dg.p AS p FROM dg JOIN eg USING (g)), "
    "runs AS (SELECT doc_id, item_id, count(*) + 12 AS words FROM (SELECT *, p - row_number() OVER (PARTITION BY doc_id, item_id, diagonal ORDER BY p) AS run FROM met) GROUP BY doc_id, item_id, diagonal, run)",
)
SQL = {
    "p6_leaked_items": _RUNS + "SELECT item_id, count(DISTINCT doc_id) AS documents, max(words)::INT AS longest FROM runs GROUP BY item_id",
    "p6_found": _GRAMS + "SELECT doc_id, item_id FROM found",
    "p6_clean_documents": _GRAMS + "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM found)",
}
