"""Problem 5: texts that were stored without their ending."""

from __future__ import annotations

import re
from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.keys import fingerprint
from ..session import cut, kept
from ..sources.tables import table

# Near-copies: five words a shingle, similarity of 0.8 or more. 6 bands of 2 find a pair of that similarity in all but 1 of 450 cases;
# all texts of a bucket are compared, BUCKET of them at once. With fewer words than COPY_WORDS, one differing shingle is too many.
SHINGLE, SIMILARITY, BANDS, BAND_ROWS, BUCKET, COPY_WORDS = 5, 0.8, 6, 2, 500, 8
# A text ends where at most so much of its closing words' other uses go on: without further evidence, and at a length where a source cuts.
GOES_ON, GOES_ON_AT_LIMIT = 0.5, 0.05
# A length is a limit of its source when at least this share of its texts has it, and so many times the mean of the lengths around it; a
# short one only where the source has no longer text.
LIMIT_SHARE, LIMIT_TIMES, LIMIT_SHORT = 0.01, 6.0, 60
# Words held at once by a task that counts contexts; bounds memory only.
TOKENS = 1_000_000
# Numbers of words at which openings are first looked up: any numbers will do, nearer ones give more keys and fewer texts to look into.
RUNGS = np.unique((4 * 1.12 ** np.arange(160)).astype(np.int64))

_U = np.uint64
_COEFF = np.random.default_rng(20_260_101).integers(1, 2**61 - 1, size=(2, BANDS * BAND_ROWS), dtype=np.uint64) | _U(1)
_PLACES = np.random.default_rng(20_260_102).integers(1, 2**63 - 1, size=SHINGLE, dtype=np.uint64) | _U(1)
_MARKS = r"(?:\.\.\.|…|\ufffd)+$"
_WORDS = re.compile(r"[^\W_]+")
_AT_END = re.compile(_MARKS)
_BLANK_END = re.compile(r"[\s\u200b]+$")
_STOP = re.compile(r"[.!?][\"'”’»)\]`*_]*$")
_CLOSED = re.compile(r"[.!?][\"'”’»)\]`]*\s*$")
_PATH = re.compile(r"^[^/]+(?:/[^/]+)+\.\w{1,5}(?::\d+)?$")
_FIGURE = re.compile(r"\d+(?:[.,]\d+)*")


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(29))) * _U(0xBF58476D1CE4E5B9)
    return h ^ (h >> _U(32))


def _multipliers(n: int, seed: int) -> np.ndarray:
    """One number for each place of a text, the same for every text: what stands there is multiplied with it, and the sums up to a place are hashes of the openings."""
    with np.errstate(over="ignore"):
        x = (np.arange(1, n + 1, dtype=np.uint64) + _U(seed)) * _U(0x9E3779B97F4A7C15)
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
        return (x ^ (x >> _U(31))) | _U(1)


class _Texts:
    """Some plain texts (words with one space between) as one array of characters, with the hashes of all their openings."""

    def __init__(self, texts: list[str]) -> None:
        self.n_each = np.fromiter(map(len, texts), np.int64, len(texts))
        self.chars = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        self.last = np.cumsum(self.n_each)
        self.first = self.last - self.n_each
        self.doc = np.repeat(np.arange(len(texts)), self.n_each)
        place = np.arange(len(self.chars)) - self.first[self.doc]
        longest = int(self.n_each.max()) if len(texts) else 0
        self.hashes = []
        for seed in (1, 7_777_777):
            with np.errstate(over="ignore"):
                sums = np.concatenate(([_U(0)], np.cumsum((self.chars.astype(np.uint64) + _U(1)) * _multipliers(longest, seed)[place], dtype=np.uint64)))
                self.hashes.append((sums[1:] - sums[self.first][self.doc]))

    def whole(self) -> list[np.ndarray]:
        """Two hashes of each text."""
        some = self.n_each > 0
        at = np.maximum(self.last - 1, 0)
        return [np.where(some, h[at], _U(0)).view(np.int64) if len(h) else np.zeros(len(some), np.int64) for h in self.hashes]

    def _spaces(self) -> tuple[np.ndarray, ...]:
        """Where spaces are, how many stand before each place, the words of each text and the least words of an opening of it."""
        space = self.chars == 32
        before = np.concatenate(([0], np.cumsum(space)))
        words = before[self.last] - before[self.first] + 1
        return space, before, words, np.maximum(SHINGLE, np.ceil(SIMILARITY * (words - SHINGLE + 1) - 1e-9).astype(np.int64) + SHINGLE - 1)

    def stems(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A hash of as many first words of each text as are whole in all its openings, down to a rung; of the rungs of all texts that it may itself
        be an opening of, the hashes, one text after the other, and their number for each. Texts with fewer words than a shingle have none."""
        space, before, words, least = self._spaces()
        some = words >= SHINGLE
        at = np.flatnonzero(space)

        def stem(doc: np.ndarray, n: np.ndarray) -> np.ndarray:
            return self.hashes[0][at[before[self.first[doc]] + n - 1] - 1].view(np.int64)

        low = np.where(some, np.searchsorted(RUNGS, least - 1, "right") - 1, 0)
        high = np.where(some, np.searchsorted(RUNGS, words - 1, "right") - 1, -1)
        n_each = high - low + 1
        doc = np.repeat(np.arange(len(words)), n_each)
        rung = np.arange(len(doc)) - (np.cumsum(n_each) - n_each)[doc] + low[doc]
        own = np.zeros(len(words), np.int64)
        if some.any():
            own[some] = stem(np.flatnonzero(some), RUNGS[low[some]])
        return own, stem(doc, RUNGS[rung]) if len(doc) else np.zeros(0, np.int64), n_each

    def openings(self) -> list[np.ndarray]:
        """Two hashes of each opening, in whole or cut words, that has at least SIMILARITY of the shingles of its text. No opening ends within a figure."""
        if not len(self.chars):
            return [np.zeros(0, np.int64)] * 2
        space, before, _, least = self._spaces()
        word = before[1:] - before[self.first][self.doc] - space
        digit = (self.chars >= 48) & (self.chars <= 57)
        other = [c for c in np.unique(self.chars[self.chars > 127]).tolist() if chr(c).isdigit()]
        if other:
            digit |= np.isin(self.chars, other)
        good = ~space & (word >= least[self.doc] - 1)
        good[self.last[self.n_each > 0] - 1] = False
        good[:-1] &= ~(digit[:-1] & digit[1:])
        return [h[good].view(np.int64) for h in self.hashes]


class _Hashes(dict):
    def __missing__(self, word: str) -> int:
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def bands_of(texts: list[list[str]], known: _Hashes) -> np.ndarray:
    """Hashes of the min-hash bands of each of `texts` (words, at least one), a row a text; a text shorter than a shingle is one shingle."""
    n_each = np.fromiter(map(len, texts), np.int64, len(texts))
    word = np.fromiter((known[w] for t in texts for w in t), np.uint64, int(n_each.sum()))
    last = np.cumsum(n_each)
    n_shingles = np.maximum(n_each - SHINGLE + 1, 1)
    ends = np.cumsum(n_shingles)
    doc = np.repeat(np.arange(len(texts)), n_shingles)
    start = (last - n_each)[doc] + np.arange(int(ends[-1])) - (ends - n_shingles)[doc]
    with np.errstate(over="ignore"):
        shingle = np.zeros(len(start), np.uint64)
        for k in range(SHINGLE):
            at = start + k
            shingle += np.where(at < last[doc], word[np.minimum(at, len(word) - 1)], _U(0)) * _PLACES[k]
        shingle = _mixed(shingle)
        low = np.stack([np.minimum.reduceat(_mixed(shingle * a + b), ends - n_shingles) for a, b in zip(*_COEFF)], axis=1)
        bands = [_mixed(low[:, b * BAND_ROWS] * _U(0x9E3779B97F4A7C15) + low[:, b * BAND_ROWS + 1] + _U(b)) for b in range(BANDS)]
    return np.stack(bands, axis=1).view(np.int64)


def _shingles(words: list[str]) -> set[int]:
    return {hash(tuple(words[i : i + SHINGLE])) for i in range(len(words) - SHINGLE + 1)}


def goes_on_in(a: list[str], b: list[str]) -> bool:
    """Whether the words `b`, nearly those of `a`, go on where `a` ends: the last word of `a` has its place in `b`, in whole with more words after it or as the start of a longer word."""
    m = [x for x in SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks() if x.size]
    if not m:
        return False
    i, j = m[-1].a + m[-1].size, m[-1].b + m[-1].size
    if i == len(a):
        return j < len(b)
    last = a[-1]
    return i == len(a) - 1 and j < len(b) and b[j].startswith(last) and not (last[-1].isdigit() and b[j][len(last)].isdigit())


def cut_in_bucket(rows: list[tuple[str, bool, int]], across: bool) -> list[int]:
    """The places of the open texts among `rows` (plain, open, block) that another goes on from, similar by SIMILARITY. With `across`, only texts of different blocks are compared."""
    texts = sorted(((x.split(" "), op, at, i) for i, (x, op, at) in enumerate(rows)), key=lambda r: len(r[0]))
    sets = [_shingles(r[0]) for r in texts]
    out = []
    for i, (words, op, at, place) in enumerate(texts):
        if not op:
            continue
        own, n = _shingles(words[:-1]), len(sets[i])
        for k in range(len(texts)):
            m = len(sets[k])
            if len(texts[k][0]) - SHINGLE + 1 > (n + 1) / SIMILARITY and m > (n + 1) / SIMILARITY:
                continue
            if k == i or len(texts[k][0]) < len(words) or (across and texts[k][2] == at) or n + 1 < SIMILARITY * m:
                continue
            # the shingle of a cut last word counts as common, as its word is the other's
            common = min(len(own & sets[k]) + 1, n, m)
            if common >= SIMILARITY * (n + m - common) - 1e-9 and goes_on_in(words, texts[k][0]):
                out.append(place)
                break
    return out


class _Tokens(dict):
    """Raw token to (word, stop): words in lower case with figures as 0 and kinds for code and paths; stop where a sentence or clause ends."""

    def __missing__(self, raw: str) -> tuple[str, bool]:
        core = raw.lstrip("\"'“”‘’«»([`*_").rstrip("\"'“”‘’«»)]`*_.,;:!?…")
        if _PATH.match(core):
            word = "<path.x>"
        elif "/" in core:
            word = "<path>"
        elif "_" in core or "#" in core or any(a.islower() and b.isupper() for a, b in zip(core, core[1:])):
            word = "<name>"
        else:
            word = _FIGURE.sub("0", core.lower())
        out = self[raw] = (word, bool(_STOP.search(raw)))
        return out


def closing(text: str) -> str:
    """`text` without blanks and cut marks at the end."""
    return _AT_END.sub("", _BLANK_END.sub("", text)).rstrip(" ")


def plainly(text: str) -> list[str]:
    """The words of `text` in lower case."""
    return _WORDS.findall(text.lower())


_PROFILE = "t1 bigint, t2 bigint, p1 bigint, p2 bigint, n int, open boolean, open_end boolean, broken boolean, before string, last string, word string, stopped boolean, stem bigint, stems array<bigint>, bands array<bigint>, text string"


def profiles(texts: DataFrame) -> DataFrame:
    """For each of the distinct `texts` (t1, t2, text), with the text: the hash and number of its words in lower case (`plainly`), whether it ends within a sentence
    (open, and open_end, which passes over emphasis), whether it breaks off in half a character, its last word with the two before it in its sentence ('^' where the sentence starts),
    and the keys by which near-copies meet: `_Texts.stems`, those of other texts only where it is open, and min-hash bands, from COPY_WORDS words on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, known = _Tokens(), _Hashes()
        for batch in batches:
            if len(tokens) > TOKENS:
                tokens = _Tokens()
            if len(known) > TOKENS:
                known = _Hashes()
            texts: list[list[str]] = []
            cols: list[list] = [[] for _ in range(8)]
            for x in batch.column(2).to_pylist():
                texts.append(plainly(x))
                bare = _BLANK_END.sub("", x)
                marked = bool(_AT_END.search(bare))
                end = closing(x)
                few = end.rsplit(None, 3)[-3:] if end else []
                own = [tokens[r] for r in few] or [("", False)]
                last = "^" if len(own) < 2 or own[-2][1] else own[-2][0]
                before = "^" if last == "^" or len(own) < 3 or own[-3][1] else own[-3][0]
                for c, v in zip(cols, (len(texts[-1]), not _CLOSED.search(x) or bool(_AT_END.search(x)), marked or not _STOP.search(end), x.rstrip().endswith("\ufffd"), before, last, *own[-1])):
                    c.append(v)
            plain = _Texts([" ".join(t) for t in texts])
            p1, p2 = plain.whole()
            stem, stems, n_each = plain.stems()
            opened = np.array(cols[1], bool)
            stems, n_each = stems[np.repeat(opened, n_each)], n_each * opened
            banded = np.array(cols[0], np.int64) >= COPY_WORDS
            bands = bands_of([t for t, b in zip(texts, banded) if b], known).ravel() if banded.any() else np.zeros(0, np.int64)
            lists = [pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(n))), pa.int32()), pa.array(v)) for v, n in ((stems, n_each), (bands, banded * BANDS))]
            arrays = [batch.column(0), batch.column(1), pa.array(p1), pa.array(p2), pa.array(cols[0], pa.int32()), *(pa.array(c, pa.bool_()) for c in cols[1:4]), *(pa.array(c, pa.string()) for c in cols[4:7]), pa.array(cols[7], pa.bool_()), pa.array(stem), *lists, batch.column(2)]
            yield pa.RecordBatch.from_arrays(arrays, names=[f.split()[0] for f in _PROFILE.split(", ")])

    return texts.select("t1", "t2", "text").mapInArrow(run, _PROFILE)


def near_copies(own: DataFrame) -> DataFrame:
    """(p1, p2) of those of the texts with profiles `own` that are a near-copy of a longer one and end before it, within a sentence.

    An opening of another text, whose last word may be cut, is found exactly: every text whose first words are also those of another, open one
    (`_Texts.stems`) offers its openings of sufficient length as keys (`_Texts.openings`). Copies that differ elsewhere too are found by min-hash bands over five-word shingles: all texts of a bucket
    are compared, buckets of the same texts once, large ones in blocks, the similarity is verified and the words are aligned (`goes_on_in`). A copy has at least
    SIMILARITY of the longer one's shingles. A figure with more digits is another figure, not a longer copy. Only hashes are shuffled
    until a bucket has an open text that is no opening, and another text.
    """

    def offered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k1, k2 = _Texts([" ".join(plainly(x)) for x in batch.column(0).to_pylist()]).openings()
            yield pa.RecordBatch.from_pydict({"p1": pa.array(k1), "p2": pa.array(k2)})

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: set[tuple[int, int]] = set()
            for across, rows in zip(batch.column(0).to_pylist(), batch.column(1)):
                own = rows.as_py()
                found |= {(own[i]["p1"], own[i]["p2"]) for i in cut_in_bucket([(" ".join(plainly(r["text"])), r["open"], r["at"]) for r in own], across)}
            one, two = zip(*sorted(found)) if found else ((), ())
            yield pa.RecordBatch.from_pydict({"p1": pa.array(one, pa.int64()), "p2": pa.array(two, pa.int64())})

    key = ["p1", "p2"]
    asked = own.where((F.col("n") >= SHINGLE) & F.col("open"))
    ends = [f(c).alias(f"{name}_{c}") for c in key for name, f in (("low", F.min), ("high", F.max))]
    stems = asked.select(F.explode("stems").alias("stem"), *key).groupBy("stem").agg(*ends)
    another = F.greatest(*(F.greatest(F.col(f"low_{c}") != F.col(c), F.col(f"high_{c}") != F.col(c)) for c in key))
    longer = own.where(F.col("n") >= SHINGLE).select("stem", *key, "text").join(stems.hint("merge"), "stem").where(another)
    openings = longer.select("text").mapInArrow(offered, "p1 bigint, p2 bigint")
    asked = asked.select(*key).distinct()
    opening = cut(asked.join(openings.hint("merge"), key, "left_semi"))
    done = opening.withColumn("done", F.lit(True))
    each = own.where(F.col("n") >= COPY_WORDS).dropna(subset=key).groupBy(*key).agg(F.max("open").alias("open"), F.first("bands").alias("bands")).join(done.hint("merge"), key, "left")
    rows = each.select(F.explode("bands").alias("bucket"), *key, (F.col("open") & F.col("done").isNull()).alias("open")).where("bucket IS NOT NULL").repartition("bucket")
    several = (F.min("p1") != F.max("p1")) | (F.min("p2") != F.max("p2"))
    same = [F.bit_xor(F.xxhash64(*k)).alias(name) for k, name in ((key, "s1"), (key[::-1], "s2"))]
    buckets = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("size"), several.alias("several"), F.max("open").alias("any"), *same).where("several AND any")
    buckets = buckets.groupBy("size", "s1", "s2").agg(F.min("bucket").alias("bucket")).select("bucket", F.ceil(F.col("size") / BUCKET).cast("int").alias("k"))
    rows = kept(rows.join(buckets.hint("merge"), "bucket"))
    rows = rows.join(own.groupBy(*key).agg(F.first("text").alias("text")).hint("merge"), key)
    rows = rows.withColumn("at", F.pmod(F.xxhash64(*key), F.col("k")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1))).select("bucket", F.least("at", "other").alias("lo"), F.greatest("at", "other").alias("hi"), *key, "text", "open", "at")
    blocks = rows.groupBy("bucket", "lo", "hi").agg(F.collect_list(F.struct(*key, "text", "open", "at")).alias("rows"))
    near = blocks.select((F.col("lo") != F.col("hi")).alias("across"), "rows").mapInArrow(compared, "p1 bigint, p2 bigint")
    return opening.unionByName(cut(near)).distinct()


def _keyed(texts: DataFrame) -> DataFrame:
    a, b = fingerprint("text")
    return texts.select(a.alias("t1"), b.alias("t2"), "text")


def near_copies_cut(texts: DataFrame, text: str = "text") -> DataFrame:
    """Those of the distinct `texts` that `near_copies` finds. Null texts are left out."""
    texts = _keyed(texts.select(F.col(text).alias("text")).where("text IS NOT NULL"))
    own = kept(profiles(texts))
    found = own.where("open").join(near_copies(own).hint("merge"), ["p1", "p2"], "left_semi").select("t1", "t2")
    return texts.join(found.hint("merge"), ["t1", "t2"], "left_semi").select(F.col("text").alias(text)).distinct()


def contexts_of(texts: DataFrame, text: str = "text") -> DataFrame:
    """(before, last, word, stops, finals, n) of the tokens of `texts` with the two words before each in its sentence, '^' where the sentence starts:
    how often a sentence ends there, a text without a sentence end, and all uses. Added up within parts of a task; sum them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = _Tokens()
        held: list[list[tuple[str, bool]]] = []
        size = 0

        def counted() -> pa.RecordBatch:
            ids: dict[str, int] = {"^": 0}
            n_each = np.fromiter(map(len, held), np.int64, len(held))
            word = np.fromiter((ids.setdefault(w, len(ids)) for t in held for w, _ in t), np.int64, int(n_each.sum()))
            stop = np.fromiter((s for t in held for _, s in t), bool, len(word))
            ends = np.cumsum(n_each)[n_each > 0]
            final = np.zeros(len(word), bool)
            final[ends - 1] = True
            fresh = np.zeros(len(word), bool)  # nothing of the sentence stands before
            fresh[0] = True
            fresh[1:] = stop[:-1] | final[:-1]
            last = np.where(fresh, 0, np.roll(word, 1))
            before = np.where(fresh | np.roll(fresh, 1), 0, np.roll(word, 2))
            rows, at = np.unique(np.stack((before, last, word), axis=1) if len(ids) > 1 << 21 else before << 42 | last << 21 | word, axis=0, return_inverse=True)
            at = at.ravel()
            if rows.ndim == 1:
                rows = np.stack((rows >> 42, rows >> 21 & (1 << 21) - 1, rows & (1 << 21) - 1), axis=1)
            names = pa.array(list(ids), pa.string())
            sums = [np.bincount(at, x, len(rows)).astype(np.int64) for x in (stop, final & ~stop)]
            return pa.RecordBatch.from_arrays([*(names.take(pa.array(rows[:, i])) for i in range(3)), *map(pa.array, sums), pa.array(np.bincount(at, minlength=len(rows)))], names=["before", "last", "word", "stops", "finals", "n"])

        for batch in batches:
            for x in batch.column(0).to_pylist():
                own = [tokens[r] for r in closing(x).split()]
                if own:
                    held.append(own)
                    size += len(own)
                if size > TOKENS:
                    yield counted()
                    tokens, held, size = _Tokens(), [], 0
        if held:
            yield counted()

    return texts.select(text).mapInArrow(run, "before string, last string, word string, stops bigint, finals bigint, n bigint")


def terminality(texts: DataFrame, text: str = "text") -> DataFrame:
    """(before, last, word, ends, goes_on) of all closing words: how often they end a sentence or text, and how often they, or a longer word they begin, go on.

    Counted over all `texts`, with the two words before, and with before = '*' over one word before. A closing fragment
    of a word has no uses of its own, but those of the words that it begins.
    """
    sums = [F.sum(c).alias(c) for c in ("stops", "finals", "n")]
    wide = kept(contexts_of(texts, text).groupBy("before", "last", "word").agg(*sums))
    both = wide.unionByName(wide.groupBy(F.lit("*").alias("before"), "last", "word").agg(*sums))
    ending = both.where("finals > 0")
    prefixes = F.transform(F.sequence(F.lit(1), F.length("word") - 1), lambda i: F.substr(F.col("word"), F.lit(1), i))
    longer = both.where((F.length("word") > 1) & ~F.col("word").startswith("<")).join(ending.select("before", "last").distinct().hint("merge"), ["before", "last"], "left_semi")
    fragments = longer.select("before", "last", F.explode(prefixes).alias("word"), "n", "finals").groupBy("before", "last", "word").agg(F.sum(F.col("n") - F.col("finals")).alias("longer"))
    out = ending.join(fragments.hint("merge"), ["before", "last", "word"], "left")
    return out.select("before", "last", "word", (F.col("stops") + F.col("finals")).alias("ends"), (F.col("n") - F.col("stops") - F.col("finals") + F.coalesce("longer", F.lit(0))).alias("goes_on"))


def _sizes(rows: DataFrame) -> DataFrame:
    """(tbl, row_key, source, unit, size): the length of each text in characters and in bytes."""
    sizes = F.explode(F.array(F.struct(F.lit("chars").alias("unit"), F.col("chars").alias("size")), F.struct(F.lit("bytes").alias("unit"), F.col("bytes").alias("size"))))
    return rows.select("tbl", "row_key", F.coalesce("source", F.lit("")).alias("source"), sizes.alias("s")).select("tbl", "row_key", "source", "s.unit", "s.size")


def limits(rows: DataFrame) -> DataFrame:
    """(tbl, source, unit, size): the lengths, in characters or bytes, at which a source cuts: they stand out among the lengths around them; short ones only if nothing of the source is longer."""
    if "chars" not in rows.columns:
        rows = rows.select("tbl", F.lit(0).alias("row_key"), "source", F.length("text").alias("chars"), F.octet_length("text").alias("bytes"))
    counts = _sizes(rows).groupBy("tbl", "source", "unit", "size").agg(F.count(F.lit(1)).alias("n"))
    own = Window.partitionBy("tbl", "source", "unit")
    near = own.orderBy("size").rangeBetween(-8, 8)
    counts = counts.withColumns({"all": F.sum("n").over(own), "longest": F.max("size").over(own), "around": (F.sum("n").over(near) - F.col("n")) / 16.0})
    piled = (F.col("n") >= LIMIT_SHARE * F.col("all")) & (F.col("n") >= LIMIT_TIMES * F.col("around"))
    enough = F.when(F.col("size") == F.col("longest"), F.col("n") >= 3).otherwise((F.col("n") >= 5) & (F.col("size") >= LIMIT_SHORT))
    return counts.where(piled & enough).select("tbl", "source", "unit", "size")


def cut_off(rows: DataFrame) -> DataFrame:
    """Rows (tbl, row_key, source, text) whose text was cut: tbl, row_key, source, `evidence` (broken, copy or words), goes_on and limited.

    broken: the end is half a character. copy: a near-copy goes on where this text ends (`near_copies`). words: no sentence end stands
    there, and the closing words go on in most of their other uses (`terminality`); where a source's texts pile up at one length, fewer
    uses suffice. Null, empty and blank texts are whole; equal texts of one source fare alike; a null source is a source of its own.
    Everything is worked out once for each distinct text; statistics are over all of them. Rows and texts meet by 128-bit fingerprints.
    """
    rows = rows.select("tbl", "row_key", "source", "text").where(F.col("text").isNotNull() & F.col("text").rlike(r"[^\s\x{A0}\x{200B}]"))
    own = kept(profiles(_keyed(rows.select("text").distinct())))
    copies = near_copies(own).withColumn("copy", F.lit(True))
    t = kept(terminality(own))
    wide = t.where("before <> '*'").select("before", "last", "word", F.col("ends").alias("e3"), F.col("goes_on").alias("g3"))
    narrow = t.where("before = '*'").select("last", "word", F.col("ends").alias("e2"), F.col("goes_on").alias("g2"))
    ends = own.where("open_end").select("t1", "t2", "p1", "p2", "open", "broken", "before", "last", "word", "stopped")
    scored = ends.join(wide.hint("merge"), ["before", "last", "word"], "left").join(narrow.hint("merge"), ["last", "word"], "left").join(copies.hint("merge"), ["p1", "p2"], "left")
    # the wider context where it has been seen going on or ending often enough, else both together
    enough = F.col("e3") + F.col("g3") >= 8
    share = F.when(enough, F.col("g3") / (F.col("e3") + F.col("g3"))).otherwise((F.col("g3") + F.col("g2")) / (F.col("e3") + F.col("g3") + F.col("e2") + F.col("g2")))
    judged = scored.select("t1", "t2", "broken", (F.col("open") & F.col("copy").isNotNull()).alias("copy"), "stopped", F.coalesce(share, F.lit(0.0)).alias("goes_on"))
    a, b = fingerprint("text")
    rows = rows.select("tbl", "row_key", "source", a.alias("t1"), b.alias("t2"), F.length("text").alias("chars"), F.octet_length("text").alias("bytes"))
    at_limit = _sizes(rows).join(limits(rows), ["tbl", "source", "unit", "size"], "left_semi").select("tbl", "row_key").distinct().withColumn("limited", F.lit(True))
    out = rows.join(judged.hint("merge"), ["t1", "t2"]).join(at_limit.hint("merge"), ["tbl", "row_key"], "left")
    words = ~F.col("stopped") & ((F.col("goes_on") > GOES_ON) | (F.col("limited") & (F.col("goes_on") > GOES_ON_AT_LIMIT)))
    evidence = F.when(F.col("broken"), "broken").when(F.col("copy"), "copy").when(words, "words")
    return out.select("tbl", "row_key", "source", evidence.alias("evidence"), "goes_on", F.coalesce("limited", F.lit(False)).alias("limited")).where(F.col("evidence").isNotNull())


def _rows(spark: SparkSession, sf: str) -> DataFrame:
    runs = table(spark, sf, "test_runs").select(F.lit("test_runs").alias("tbl"), F.col("seq").alias("row_key"), "source", F.col("message").alias("text"))
    return runs.unionByName(table(spark, sf, "stale_entries").select(F.lit("stale_entries").alias("tbl"), F.col("entry_key").alias("row_key"), "source", "text"))


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    """Rows whose message or text was cut."""
    return cut_off(_rows(spark, sf)).select("tbl", "row_key")


def p5_share_by_source(spark: SparkSession, sf: str) -> DataFrame:
    """Rows with a text, cut rows and their share per table and source."""
    rows = _rows(spark, sf)
    had = rows.where(F.col("text").rlike(r"[^\s\x{A0}\x{200B}]")).groupBy("tbl", "source").agg(F.count(F.lit(1)).alias("texts"))
    lost = cut_off(rows).groupBy("tbl", "source").agg(F.count(F.lit(1)).alias("cut_off"))
    same = had.tbl == lost.tbl
    joined = had.join(lost, same & had.source.eqNullSafe(lost.source), "left").select(had.tbl, had.source, "texts", F.coalesce("cut_off", F.lit(0)).alias("cut_off"))
    return joined.withColumn("share", F.round(F.col("cut_off") / F.col("texts"), 6))


QUERIES = {"p5_found": p5_found, "p5_share_by_source": p5_share_by_source}
SQL: dict[str, str] = {}
