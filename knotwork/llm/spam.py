"""Problem 8: pages of keywords, links or tags instead of prose, by the perplexity of their word classes under a prose model."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut
from ..sources.tables import table

# Function words of the four languages by their part in a sentence.
CLASSES = {
    "d": "the a an this that these those its our their my your his her der die das den dem des ein eine einen einem einer eines dieser diese dieses le la les un une des ce cet cette ces l son sa ses notre nos el los las una unos unas este esta estos estas lo su sus".split(),
    "p": "of to in on at by for from with without into over under after before since until as about than von zu im am auf mit für nach vor bei aus seit an bis durch über de du en dans sur par pour avec sans sous avant après depuis au aux d del al con sin por para tras hasta desde sobre antes después".split(),
    "c": "and or but if when then because while unless otherwise even so since once whenever und oder aber wenn weil falls dass ob sobald solange bevor nachdem denn et ou mais si quand que qu parce puis lorsque pendant tant y e o pero cuando porque mientras luego como".split(),
    "v": "is are was were be been has have had do does did must should can will would may let make ist sind war waren wird werden hat haben darf muss soll kann lassen läuft est sont été a ont doit peut faut fait il es son fue ha han debe hay está".split(),
    "o": "it we you they i he she them us who which what there here one wir ich sie es man sich er uns ihr klar nous vous je tu elle on se s qui se nos nosotros yo él ella ellos".split(),
    "n": "not no never nor only still nicht niemals nie kein keine nur noch ne pas jamais plus n rien aucun no nunca jamás solo más ni".split(),
}
_KIND = {w: k for k, ws in CLASSES.items() for w in ws}

# Symbols of the model: function words by class; w a content word, r one that stands among the last content words
# already, R one that stands there twice or more, W with a capital,
# I an identifier, N a number, U an address, H a hash tag, T a markup tag, L the start of a paragraph, S a sentence end, others as they are. Line ends, signs that
# begin a line (quote, comment, list), emphasis, commas and dashes say little about prose and are passed over.
_MARKS = "dpcvonwrRWINUHTLS;:|/()[]>\"=+~"
_AT = {s: i for i, s in enumerate(_MARKS)}
_OTHER = len(_MARKS)
SYMBOLS = _OTHER + 1
_BEGIN = re.compile(r"(?m)^[ \t]*(?:[>#*;%•-]+|//+|\d+[.)])(?=\s)")
# Every character belongs to a token, so that their lengths give their places. A word takes one blank after it along.
_TOKEN = re.compile(
    r"(?:https?://|www\.)[^\s<>\"')\]|]+|(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}/[^\s<>\"')\]|]*|</?[A-Za-z][^<>]*>|#[^\W_][\w-]*|\d+(?:[.,:]\d+)*(?![^\W_]) ?|[^\W_][^\W_]*(?:[_-]\w+)* ?|\n\s*\n|`{3,}|[^\w\s]|_|[^\S\n]+|\n"
)
_SENTENCE_END, _PASSED = set(".!?…"), set("`*_,-–—•")
# Words looked back for a repetition; tokens over which surprise is averaged, the shortest prose sentence and its least share of function words.
LOOK_BACK, WINDOW, SENTENCE, FUNCTION_SHARE = 24, 17, 6, 0.2
# A window is abnormal beyond so many standard errors of the prose mean, a run in the form of a sentence beyond SENTENCE_TIMES as many; a page, beyond those of one window.
HIGH, LOW, SENTENCE_TIMES = 4.0, 4.0, 2.0
# Surprise is added up in whole parts of a bit, so that sums do not depend on what else is in a batch.
_BIT = 1 << 20

# What a token is, in one number: its symbol, or that it is passed over or a code fence; whether it is a content word, and one that may be a repetition; the number of the word.
_SKIP, _FENCE, _CONTENT, _PLAIN, _WORD_AT = 62, 63, 64, 128, 8


class _Codes(dict):
    """Token to what it is; grows with the vocabulary, and is emptied between batches when large."""

    def __init__(self) -> None:
        self.words: dict[str, int] = {}

    def __missing__(self, token: str) -> int:
        code = self[token] = self._code(token)
        return code

    def _code(self, token: str) -> int:
        bare = token.strip()
        if not bare:
            return _AT["L"] if token.count("\n") > 1 else _SKIP
        first = bare[0]
        if first == "<" and len(bare) > 1:
            return _AT["T"]
        if first == "#" and len(bare) > 1:
            return _AT["H"]
        if not first.isalnum():
            if bare.startswith("```"):
                return _FENCE
            return _SKIP if bare in _PASSED else _AT["S"] if bare in _SENTENCE_END else _AT.get(bare, _OTHER)
        if "/" in bare or bare.startswith("www."):
            return _AT["U"]
        if bare[0].isdigit() and all(ch.isdigit() or ch in ".,:" for ch in bare):
            return _AT["N"]
        low = bare.lower()
        kind = _KIND.get(low)
        if kind:
            return _AT[kind]
        out = _CONTENT | self.words.setdefault(low, len(self.words)) << _WORD_AT
        if "_" in bare or (not bare.islower() and not bare[1:].islower() and not bare.isupper() and len(bare) > 1) or not bare.replace("-", "").isalpha():
            return out | _AT["I"]
        return out | _PLAIN | (_AT["w"] if first.islower() or (bare.isupper() and len(bare) > 1) else _AT["W"])


def classes_of(texts: list[str], codes: _Codes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, whether in fenced code, characters up to the next token, tokens of each text) of the tokens of all `texts` in turn."""
    every: list[str] = []
    n_each = np.zeros(len(texts), np.int64)
    for i, text in enumerate(texts):
        had = len(every)
        every += _TOKEN.findall(_BEGIN.sub(lambda m: "•" * len(m.group()), text))
        n_each[i] = len(every) - had
    code = np.fromiter(map(codes.__getitem__, every), np.int64, len(every))
    size = np.fromiter(map(len, every), np.int64, len(every))
    doc = np.repeat(np.arange(len(texts)), n_each)
    symbol = code & 63
    fences = np.concatenate(([0], np.cumsum(symbol == _FENCE)))
    first = np.concatenate(([0], np.cumsum(n_each)))[:-1]
    fenced = (fences[1:] - fences[first][doc]) % 2 == 1
    # repetitions: the content words before that are the same
    at = np.flatnonzero(code & _CONTENT)
    word = doc[at] * (len(codes.words) + 1) + (code[at] >> _WORD_AT)
    order = np.argsort(word, kind="stable")
    same = np.zeros(len(at), bool)
    same[1:] = word[order][1:] == word[order][:-1]
    last = np.full(len(at), -LOOK_BACK)
    last[order[1:][same[1:]]] = order[:-1][same[1:]]
    place = np.arange(len(at))
    near = (last >= 0) & (place - last < LOOK_BACK)
    before = np.where(last >= 0, last[np.maximum(last, 0)], -LOOK_BACK)
    twice = near & (before >= 0) & (place - before < LOOK_BACK)
    plain = (code[at] & _PLAIN) > 0
    symbol[at[near & plain]] = _AT["r"]
    symbol[at[twice & plain]] = _AT["R"]
    kept = np.flatnonzero(symbol < _SKIP)
    start = np.cumsum(size) - size
    ends = np.cumsum(np.bincount(doc, size, len(texts)).astype(np.int64)) if len(texts) else np.zeros(0, np.int64)
    following = np.empty(len(kept), np.int64)
    if len(kept):
        following[:-1] = start[kept[1:]]
        following[-1] = ends[-1]
        following = np.minimum(following, ends[doc[kept]])
    return symbol[kept].astype(np.uint8), fenced[kept], following - start[kept], np.bincount(doc[kept], minlength=len(texts))


def _binary(data: np.ndarray, n_each: np.ndarray) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum(n_each))).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(n_each), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


def _bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary column without nulls, in turn, and the number of each row."""
    sizes = np.diff(np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]).astype(np.int64)
    begin = np.frombuffer(column.buffers()[1], np.int32)[column.offset]
    data = np.frombuffer(column.buffers()[2], np.uint8)[begin : begin + sizes.sum()] if len(column) and sizes.sum() else np.zeros(0, np.uint8)
    return data, sizes


def classed(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_chars, classes, widths): the tokens of each text, a byte for the class of each (the high bit: in fenced code) and one for its width, 255 and on for more.

    The one pass over the texts: what learns and what scores reads these bytes. n_chars is null for a null text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = _Codes()
        for batch in batches:
            if len(codes) > 1_000_000:
                codes = _Codes()
            texts = batch.column(1).to_pylist()
            symbols, fenced, width, n_each = classes_of([x or "" for x in texts], codes)
            more = width // 255 + 1
            widths = np.full(int(more.sum()), 255, np.uint8)
            widths[np.cumsum(more) - 1] = width % 255
            per_doc = np.bincount(np.repeat(np.arange(len(texts)), n_each), more, len(texts)).astype(np.int64)
            chars = pa.array([None if x is None else len(x) for x in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), chars, _binary(symbols | fenced.astype(np.uint8) << 7, n_each), _binary(widths, per_doc)], names=[key, "n_chars", "classes", "widths"])

    return documents.select(F.col(key).cast("bigint").alias(key), text).mapInArrow(run, f"{key} bigint, n_chars bigint, classes binary, widths binary")


def _read(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, in code, tokens of each text) of a column of classes."""
    data, n_each = _bytes_of(column)
    return (data & 127).astype(np.int64), data > 127, n_each


def _contexts(symbols: np.ndarray, n_each: np.ndarray) -> np.ndarray:
    """For each token the index of (two before, one before, itself) in a flat table; a line end stands before the first of a text."""
    padded = np.full(len(symbols) + 2 * len(n_each), _AT["L"], np.int64)
    at = np.arange(len(symbols)) + 2 * (np.repeat(np.arange(len(n_each)), n_each) + 1)
    padded[at] = symbols
    return (padded[at - 2] * SYMBOLS + padded[at - 1]) * SYMBOLS + symbols


_FUNCTION = np.zeros(128, bool)
_FUNCTION[[_AT[k] for k in CLASSES]] = True
_BREAK = np.zeros(128, bool)
_BREAK[[_AT[k] for k in "SLUHT|"]] = True


def sentences(symbols: np.ndarray, code: np.ndarray, n_each: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ranges of tokens that are sentences: runs without addresses or tags up to a sentence end, in one paragraph of one text, long enough, with enough function words."""
    if not len(symbols):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    bounds = np.unique(np.concatenate(([0], np.flatnonzero(_BREAK[symbols]) + 1, np.cumsum(n_each))))
    function = np.concatenate(([0], np.cumsum(_FUNCTION[symbols])))
    a, b = bounds[:-1], bounds[1:]
    good = (b - a >= SENTENCE) & ~code[a]
    good &= (function[b] - function[a] >= FUNCTION_SHARE * (b - a)) & (symbols[b - 1] == _AT["S"])
    return a[good], b[good]


def _covered(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, a, 1)
    np.add.at(step, b, -1)
    return np.cumsum(step[:-1]) > 0


def prose_tokens(symbols: np.ndarray, code: np.ndarray, n_each: np.ndarray) -> np.ndarray:
    """Which tokens the model learns from: those of sentences, and a paragraph's start after one."""
    a, b = sentences(symbols, code, n_each)
    out = _covered(a, b, len(symbols))
    after = b[(b < len(symbols)) & ~np.isin(b, np.cumsum(n_each))]
    out[after[symbols[after] == _AT["L"]]] = True
    return out


class ProseModel:
    """Interpolated trigram model of word classes, with the mean and deviation of the surprise of prose under it."""

    def __init__(self, counts: np.ndarray) -> None:
        tri = counts.reshape(SYMBOLS, SYMBOLS, SYMBOLS).astype(float)
        bi, uni = tri.sum(axis=0), tri.sum(axis=(0, 1))
        p1 = (uni + 0.5) / (uni.sum() + 0.5 * SYMBOLS)
        p2 = (bi + 4 * p1) / (bi.sum(axis=1, keepdims=True) + 4)
        p3 = (tri + 4 * p2[None]) / (tri.sum(axis=2, keepdims=True) + 4)
        self.surprise = np.rint(-np.log2(p3).ravel() * _BIT).astype(np.int64)
        n, bits = max(counts.sum(), 1), self.surprise / _BIT
        self.mean = float((counts * bits).sum() / n)
        self.deviation = math.sqrt(max(float((counts * (bits - self.mean) ** 2).sum() / n), 1e-9)) if counts.any() else math.inf

    def _side(self, mean, n, times: float = 1.0):
        """1 where the mean surprise of n tokens is abnormally high, -1 where abnormally low, else 0."""
        error = times * self.deviation / np.sqrt(n)
        return (mean > self.mean + HIGH * error).astype(int) - (mean < self.mean - LOW * error).astype(int)

    def scores(self, symbols: np.ndarray, code: np.ndarray, n_each: np.ndarray, width: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(characters that stand where the surprise is abnormal, perplexity, side of the whole page) of each text; code is normal."""
        docs = np.repeat(np.arange(len(n_each)), n_each)
        surprise = self.surprise[_contexts(symbols, n_each)]
        half, at = WINDOW // 2, np.arange(len(symbols))
        total = np.concatenate(([0], np.cumsum(surprise)))
        last = np.cumsum(n_each)
        lo, hi = np.maximum(at - half, (last - n_each)[docs]), np.minimum(at + half + 1, last[docs])
        odd = (self._side((total[hi] - total[lo]) / (hi - lo) / _BIT, hi - lo) != 0) & ~code
        a, b = sentences(symbols, code, n_each)
        fine = self._side((total[b] - total[a]) / (b - a) / _BIT, b - a, SENTENCE_TIMES) == 0
        odd &= ~_covered(a[fine], b[fine], len(symbols))  # only its neighbours are odd
        spam = np.bincount(docs, width * odd, len(n_each))
        mean = (total[last] - total[last - n_each]) / np.maximum(n_each, 1) / _BIT
        return spam, 2**mean, np.where(n_each > 0, self._side(mean, np.clip(n_each, 1, WINDOW)), 0)


def prose_counts(classes: DataFrame) -> np.ndarray:
    """Numbers of the class trigrams in the sentences of all `classes` (as `classed`). Tasks send sums over at most SYMBOLS**3 trigrams, however many texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(SYMBOLS**3, np.int64)
        for batch in batches:
            symbols, code, n_each = _read(batch.column(0))
            sums += np.bincount(_contexts(symbols, n_each)[prose_tokens(symbols, code, n_each)], minlength=SYMBOLS**3)
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_pydict({"gram": pa.array(at, pa.int64()), "n": pa.array(sums[at], pa.int64())})

    counted = classes.select("classes").mapInArrow(count, "gram bigint, n bigint").groupBy("gram").agg(F.sum("n").alias("n"))
    out = np.zeros(SYMBOLS**3, np.int64)
    for gram, n in counted.collect():
        out[gram] = n
    return out


def with_spam_share(classes: DataFrame, model: ProseModel, key: str = "doc_id") -> DataFrame:
    """(key, spam_share, perplexity, page) of texts as `classed`: the share of characters where a text is abnormal under `model`, its perplexity, and whether that is itself abnormally high or low.

    Texts are read whole, one by one, without a shuffle. Null and empty texts have nulls; equal rows
    get equal scores. A model without any prose takes everything for equally likely and finds nothing.
    """

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            symbols, code, n_each = _read(batch.column(2))
            data, parts = _bytes_of(batch.column(3))
            ends = np.flatnonzero(data < 255)
            width = np.diff(np.concatenate(([0], np.cumsum(data.astype(np.int64))[ends])))
            spam, perplexity, side = model.scores(symbols, code, n_each, width)
            chars = np.array([x or 0 for x in batch.column(1).to_pylist()], np.int64)
            none = chars == 0
            share = pa.array(np.round(spam / np.maximum(chars, 1), 9), pa.float64(), mask=none)
            page = pa.array([("low", None, "high")[s + 1] for s in side.tolist()], pa.string())
            yield pa.RecordBatch.from_pydict({key: batch.column(0), "spam_share": share, "perplexity": pa.array(np.round(perplexity, 6), pa.float64(), mask=none), "page": page})

    return classes.select(key, "n_chars", "classes", "widths").mapInArrow(score, f"{key} bigint, spam_share double, perplexity double, page string")


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    """Documents of which more than half is keywords, links or tags."""
    return p8_scores(spark, sf).where(F.col("spam_share") > 0.5).select("doc_id")


def p8_scores(spark: SparkSession, sf: str) -> DataFrame:
    """The spam share and perplexity of every document, and whether the perplexity of the page is abnormal."""
    classes = cut(classed(table(spark, sf, "documents", "doc_id", "text")))
    return with_spam_share(classes, ProseModel(prose_counts(classes)))


QUERIES = {"p8_found": p8_found, "p8_scores": p8_scores}
SQL: dict[str, str] = {}
