"""Similarity operators: sets by Jaccard within a key, names by edit distance; exact, by counts of whole blocks at once."""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut, kept

# Rows of a block; rows compared with a block at once. Pairs of a key that are joined as rows; keys with more are compared by blocks.
BLOCK, STRIP, ALONE = 16_384, 512, 1000
# A word is a column of the product where at least one of so many pairs has it in common; rarer ones are added pair by pair.
RARE = 2000


def _partitions(df: DataFrame) -> int:
    """A given number of partitions is kept: the pairs of blocks are small, but long to compare."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


class _Sets:
    """The rows (id, n, t) of a block: ids, weights, sizes, and the words as places in a list of words, with the row of each."""

    def __init__(self, rows: pa.StructArray) -> None:
        self.id, self.n = (rows.field(f).to_numpy(zero_copy_only=False) for f in ("id", "n"))
        lists = pc.split_pattern(rows.field("t"), " ")
        self.size = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        coded = pc.list_flatten(lists).dictionary_encode()
        self.words, self.word = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.row = np.repeat(np.arange(len(self.size)), self.size)


def _products(a: _Sets, b: _Sets, p: int, q: int) -> Iterator[tuple[int, np.ndarray]]:
    """For strips of the rows of `a` from the given place on: (p + q) * common - p * (size + size) with each row of `b`.

    This is not negative where common / all is p / q or more. All are integers, exact as float32.
    """
    na, nb = len(a.size), len(b.size)
    word = pc.index_in(b.words, value_set=a.words).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)[b.word]
    known = word >= 0
    word, row = word[known], b.row[known]
    in_b = np.bincount(word, minlength=len(a.words))
    common = np.bincount(a.word, minlength=len(a.words)) * in_b
    column = common * RARE > na * nb
    rare = (common > 0) & ~column
    place, n = np.cumsum(column) - 1, int(column.sum())
    y = np.zeros((nb, n + 2), np.float32)
    own = column[word]
    y[row[own], place[word[own]]] = p + q
    y[:, n], y[:, n + 1] = 1, -p * b.size
    own = rare[word]
    few = row[own][np.argsort(word[own], kind="stable")]
    first = np.cumsum(in_b * rare) - in_b * rare
    ends = np.cumsum(a.size)
    for start in range(0, na, STRIP):
        stop = min(start + STRIP, na)
        at = slice(ends[start] - a.size[start], ends[stop - 1])
        w, r = a.word[at], a.row[at] - start
        x = np.zeros((stop - start, n + 2), np.float32)
        own = column[w]
        x[r[own], place[w[own]]] = 1
        x[:, n], x[:, n + 1] = -p * a.size[start:stop], 1
        m = x @ y.T
        own = rare[w]
        w, r = w[own], r[own]
        times = in_b[w]
        if times.sum():
            other = few[np.repeat(first[w] - (np.cumsum(times) - times), times) + np.arange(times.sum())]
            np.add.at(m.reshape(-1), np.repeat(r, times) * nb + other, np.float32(p + q))
        yield start, m


def _summed(a: _Sets, b: _Sets, same: bool, both: bool, p: int, q: int) -> dict[str, np.ndarray]:
    others, back = np.zeros(len(a.size), np.int64), np.zeros(len(b.size), np.int64)
    for start, m in _products(a, b, p, q):
        i, j = np.nonzero(m >= 0)
        others[start : start + len(m)] += np.bincount(i, b.n[j], len(m)).astype(np.int64)
        if both and not same:
            back += np.bincount(j, a.n[start + i], len(back)).astype(np.int64)
    ids, sums = np.concatenate((a.id, b.id)), np.concatenate((others, back))
    return {"a": ids[sums > 0], "others": sums[sums > 0]}


def _best(a: _Sets, b: _Sets, same: bool, both: bool, p: int, q: int) -> dict[str, np.ndarray]:
    out: list[tuple[np.ndarray, ...]] = []
    for start, m in _products(a, b, p, q):
        i, j = np.nonzero(m >= 0)
        size = a.size[start + i] + b.size[j]
        common = (m[i, j].astype(np.int64) + p * size) // (p + q)
        every = size - common
        low = -((2_000_000 * common + every) // (2 * every))
        order = np.lexsort((b.id[j], low, i))
        order = order[np.concatenate(([True], np.diff(i[order]) > 0))[: len(order)]]
        out.append((a.id[start + i[order]], low[order], b.id[j[order]], common[order], every[order]))
    return dict(zip(("a", "low", "other", "common", "every"), map(np.concatenate, zip(*out))))


def similar_sets(left: DataFrame, right: DataFrame, least: float, best: bool = False) -> DataFrame:
    """Rows (id, keys, t, n) of `left` with those of `right` of equal keys and a Jaccard of `least` or more, t being distinct words, at least one, with a space between.

    (a, others): the sum of their n, which counts a row that is on both sides too. With `best` (a, other, common, every): the one of
    highest Jaccard, rounded to six digits, and lowest id, with the numbers of common and of all words.

    Every pair is compared. Keys of few pairs are joined row by row. Of the others, the rows are dealt to blocks by id, and the common words of
    two blocks are counted by one product of matrices, each pair of blocks in a task of its own; with the same rows on both sides a pair of blocks counts both ways.
    The rows meet the sizes of their keys once, and each further step reads only those it needs. No join sends a side to the driver: what is told of the sizes beforehand comes from compressed files and is far too low.
    """
    p, q = Fraction(str(least)).as_integer_ratio()
    same = left is right
    n_each = [d.groupBy("keys").agg(F.count(F.lit(1)).alias(n)) for d, n in ((left, "l"), (right, "r"))]
    n_each = cut(n_each[0].join(n_each[1].hint("merge"), "keys"))
    big = F.col("l") * F.col("r") > ALONE

    def told(d: DataFrame) -> DataFrame:
        return kept(d.select("keys", "id", "t", "n").join(n_each.hint("merge"), "keys"))

    left = told(left)
    right = left if same else told(right)
    a = left.where(~big).select("keys", F.col("id").alias("a"), F.split("t", " ").alias("u"))
    b = right.where(~big).select("keys", F.col("id").alias("other"), F.split("t", " ").alias("v"), "n")
    size = F.size("u") + F.size("v")
    few = a.join(b.hint("merge"), "keys").where((p + q) * F.least(F.size("u"), F.size("v")) >= p * size)
    few = few.withColumn("common", F.size(F.array_intersect("u", "v")).cast("bigint")).where((p + q) * F.col("common") >= p * size).withColumn("every", size - F.col("common"))

    def dealt(d: DataFrame, own: str, far: str, i: str, j: str, name: str) -> DataFrame:
        blocks = {n: F.ceil(F.col(n) / BLOCK).cast("int") for n in (own, far)}
        d = d.where(big).withColumns({i: F.pmod(F.xxhash64("id"), blocks[own]).cast("int"), "far": blocks[far]})
        d = d.groupBy("keys", i, "far").agg(F.collect_list(F.struct("id", "n", "t")).alias(name))
        first, last = F.lit(0), F.col("far") - 1
        if same:  # each pair of blocks once
            first, last = (F.col(i), last) if i == "i" else (first, F.col(i))
        return d.select("keys", i, F.explode(F.sequence(first, last)).alias(j), name).repartition(_partitions(d), "keys", "i", "j")

    pairs = dealt(left, "l", "r", "i", "j", "x").join(dealt(right, "r", "l", "j", "i", "y").hint("merge"), ["keys", "i", "j"])
    fold = _best if best else _summed

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                x, y = (_Sets(batch.column(c)[k].values) for c in (1, 2))
                yield pa.RecordBatch.from_pydict({n: pa.array(v, pa.int64()) for n, v in fold(x, y, batch.column(0)[k].as_py(), same, p, q).items()})

    pairs = pairs.select((F.lit(same) & (F.col("i") == F.col("j"))).alias("same"), "x", "y")
    if not best:
        many = pairs.mapInArrow(compared, "a bigint, others bigint")
        return few.select("a", F.col("n").alias("others")).unionByName(many).groupBy("a").agg(F.sum("others").alias("others"))
    many = pairs.mapInArrow(compared, "a bigint, low bigint, other bigint, common bigint, every bigint")
    few = few.select("a", F.expr("-((2000000 * common + every) div (2 * every))").alias("low"), "other", "common", F.col("every").cast("bigint").alias("every"))
    top = few.unionByName(many).groupBy("a").agg(F.min(F.struct("low", "other", "common", "every")).alias("top"))
    return top.select("a", "top.other", "top.common", "top.every")


# Names and asked words of a block; longer names have no bits enough and are joined by their length. Pairs whose distance is worked out at once.
NAMES, ASKED, LONGEST, AT_ONCE = 8192, 4096, 64, 200_000
# Columns of the product at most: more pairs of characters share columns, which only lets more candidates through.
COLUMNS = 1021
# Two distances by length that are no further apart may round to one similarity.
TIE = 1.1e-6


def _characters(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The characters of the words, a row a word, and their numbers."""
    n = np.fromiter(map(len, words), np.int64, len(words))
    return np.array(words, f"<U{max(1, n.max())}").view(np.uint32).reshape(len(words), -1).astype(np.int64), n


def _distances(masks: np.ndarray, at: np.ndarray, m: int, text: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Edit distances of names of `m` characters, rows `at` of `masks` (name, character), and the characters `text` of which `n` count; bit-parallel (Myers, Hyyrö)."""
    one, last = np.uint64(1), np.uint64(1 << (m - 1))
    pv, mv = np.full(len(at), ~np.uint64(0)), np.zeros(len(at), np.uint64)
    d = np.full(len(at), m, np.int64)
    for k in range(int(n.max()) if len(n) else 0):
        eq = masks[at, text[:, k]]
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph, mh = mv | ~(xh | pv), pv & xh
        d += np.where(k < n, ((ph & last) > 0).astype(np.int64) - ((mh & last) > 0), 0)
        ph, mh = (ph << one) | one, mh << one
        pv, mv = mh | ~(xv | ph), ph & xv
    return d


def nearest_in(asked: list[str], names: list[str], most: float) -> list[tuple[str, str, int]]:
    """For each of `asked` those of `names` (LONGEST characters at most) with the fewest edits by length, `most` or fewer: of each number of edits and length the first.

    An edit changes two pairs of neighbouring characters at most, so names at that distance have enough of them in common; only these are measured,
    first the one with most in common, as nothing that is further away than the best so far counts.
    """
    a, na = _characters(asked)
    b, nb = _characters(names)
    kinds = np.unique(a)
    text = np.searchsorted(kinds, a)
    place = np.searchsorted(kinds, b).clip(max=len(kinds) - 1)
    masks = np.zeros((len(names), len(kinds)), np.uint64)
    row, col = np.nonzero((kinds[place] == b) & (np.arange(b.shape[1]) < nb[:, None]))
    np.bitwise_or.at(masks, (row, place[row, col]), np.uint64(1) << col.astype(np.uint64))

    def bigrams(c: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        row, col = np.nonzero(np.arange(c.shape[1] - 1) < n[:, None] - 1)
        return row, c[row, col] << 21 | c[row, col + 1]

    (rb, gb), (ra, ga) = bigrams(b, nb), bigrams(a, na)
    every = np.unique(gb)
    x, y = (np.zeros((len(r), min(len(every), COLUMNS) or 1), np.float32) for r in (a, b))
    for z, r, g in ((x, ra, ga), (y, rb, gb)):
        at = np.searchsorted(every, g).clip(max=max(len(every) - 1, 0))
        own = every[at] == g if len(every) else np.zeros(0, bool)
        np.add.at(z, (r[own], at[own] % z.shape[1]), 1)
    best = np.full(len(asked), most)
    found: list[tuple[np.ndarray, ...]] = []

    def bound(rows: np.ndarray, longest: np.ndarray) -> np.ndarray:
        return np.floor(longest * np.minimum(most, best[rows] + TIE) + 1e-9).astype(np.int64)

    def measured(rows: np.ndarray, at: np.ndarray, m: int, keep: bool) -> None:
        for k in range(0, len(rows), AT_ONCE):
            r, o = rows[k : k + AT_ONCE], at[k : k + AT_ONCE]
            d, longest = _distances(masks, o, m, text[r], na[r]), np.maximum(na[r], m)
            good = d <= bound(r, longest)
            r, o, d, longest = r[good], o[good], d[good], longest[good]
            np.minimum.at(best, r, d / longest)
            if keep:
                found.append((r, o, d, longest))

    for m in np.unique(nb).tolist():
        own = np.flatnonzero(nb == m)
        near = np.flatnonzero(np.abs(na - m) <= np.floor(np.maximum(na, m) * most + 1e-9))
        for k in range(0, len(near), STRIP):
            rows = near[k : k + STRIP]
            longest = np.maximum(na[rows], m)
            common = x[rows] @ y[own].T
            top = common.argmax(axis=1)
            hopeful = common[np.arange(len(rows)), top] >= longest - 1 - 2 * bound(rows, longest)
            measured(rows[hopeful], own[top[hopeful]], m, False)
            i, j = np.nonzero(common >= (longest - 1 - 2 * bound(rows, longest))[:, None])
            measured(rows[i], own[j], m, True)
    first: dict[tuple[int, int, int], str] = {}
    for r, o, d, longest in found:
        good = d / longest <= best[r] + TIE
        for i, j, edits, n in zip(r[good].tolist(), o[good].tolist(), d[good].tolist(), longest[good].tolist()):
            key = (i, edits, n)
            if key not in first or names[j] < first[key]:
                first[key] = names[j]
    return [(asked[i], name, edits) for (i, edits, _), name in first.items()]


def nearest_names(asked: DataFrame, names: DataFrame, most: float = 0.4) -> DataFrame:
    """(symbol, name, d): of all `names` (name) those nearest to each of `asked` (symbol) with d edits, `most` of the longer one's length at most.

    Both are distinct. Each block of one side meets each of the other in a task of its own, so there are several rows for a symbol; the nearest of all is among them.
    """
    asked, names = cut(asked.withColumn("n", F.length("symbol"))), cut(names.withColumn("n", F.length("name")))
    short = names.where(F.col("n") <= LONGEST)
    near = asked.where(F.col("n") * (1 - most) <= LONGEST + 1)
    i, j = (max(1, -(-d.count() // size)) for d, size in ((near, ASKED), (short, NAMES)))

    def dealt(d: DataFrame, word: str, own: str, n: int, far: str, of: int, name: str) -> DataFrame:
        d = d.groupBy(F.pmod(F.xxhash64(word), F.lit(n)).cast("int").alias(own)).agg(F.collect_list(word).alias(name))
        return d.withColumn(far, F.explode(F.sequence(F.lit(0), F.lit(of - 1)))).repartition(_partitions(d), "i", "j")

    pairs = dealt(near, "symbol", "i", i, "j", j, "x").join(dealt(short, "name", "j", j, "i", i, "y").hint("merge"), ["i", "j"])

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                out = nearest_in(batch.column(0)[k].as_py(), batch.column(1)[k].as_py(), most)
                yield pa.RecordBatch.from_pydict({n: pa.array([r[c] for r in out], kind) for c, (n, kind) in enumerate((("symbol", pa.string()), ("name", pa.string()), ("d", pa.int64())))})

    found = pairs.select("x", "y").mapInArrow(compared, "symbol string, name string, d bigint")
    lo, hi = F.ceil(F.col("n") * (1 - most)).cast("int"), F.floor(F.col("n") / (1 - most)).cast("int")
    probes = asked.where(hi > LONGEST).select("symbol", F.explode(F.sequence(F.greatest(lo, F.lit(LONGEST + 1)), hi)).alias("n"))
    long = probes.join(names.where(F.col("n") > LONGEST).hint("merge"), "n")
    allowed = F.floor(F.greatest(F.length("symbol"), F.length("name")) * most + 1e-9).cast("int")
    return found.unionByName(long.withColumn("d", F.levenshtein("symbol", "name").cast("bigint")).where(F.col("d") <= allowed).select("symbol", "name", "d"))
