"""Problem 2: personal details in free text, found by bootstrapped contextual extraction."""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator
from functools import reduce

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut
from ..sources.tables import table

KINDS = ("email", "phone", "id_number", "address", "name")
# How an instance without a verdict counts against its patterns, by round: little while verdicts spread, in full at the end.
UNKNOWN = (0.2, 0.5, 1.0)
# The scores from which an instance has a verdict in the rounds and a detail counts at the end, and how a pattern's lack of instances weighs.
ACCEPT, FINAL, DOUBT = 0.5, 0.7, 1.5

# Words before a number that say what it is. They make seeds; what stands around the seeds makes the patterns.
_ID_LABEL = (
    r"passports?|pasaporte|passeport|reisepass|ausweis|personalausweis|personalausweisnummer|ssn|social security|national insurance|ni|nino|dni|nie|nif|cif|nir|insee|steuer-?id|steuernummer|steueridentifikationsnummer|idnr|tax|tin|vat id|"
    r"numéro fiscal|n° fiscal|sécurité sociale|seguridad social|seguro|insurance|versicherung|versicherungsnummer|sozialversicherungsnummer|driver'?s? licen[cs]e|driving licen[cs]e|licen[cs]e|führerschein|permis|permis de conduire|permiso|carnet|licencia|identity card|id card|carte d'identité"
)
_LABELLED = re.compile(rf"(?:^|[^\w])(?:{_ID_LABEL})(?:[ -]?(?:no|nr|num|number|nummer|núm|numéro|nº|n°))?[.:]?$", re.IGNORECASE)
_NO_DETAIL = re.compile(
    r"(?:^|[^\w])(?:epoch|order|build|port|version|amount|limit|limit is|ticket|commit|trace|hash|issue|pr|rows?|bytes?|sha|took|sku|invoice|release|timestamp|offset|size|total|sum|seed|pid|job|revision|checksum)[:=]*$", re.IGNORECASE
)
# Characters before a number in which its label stands: more than the longest of the labels above has.
_LABEL_CHARS = 60
_PLAIN_NUMBER = re.compile(r"^(?:\d{4}-\d{2}-\d{2}|\d{1,3}(?:\.\d{1,3}){3}|\d+\.\d{1,2}|\d{1,4} 000|\d{1,3}(?:,\d{3})+|\d{1,2}\.\d{1,3}\.\d+|\d{2}:\d{2}(?::\d{2})?)$")
_PHONE_SEED = re.compile(r"^(?:tel:|\+\d|00[1-9]\d{0,2} \d|00[1-9]\d{10,}|\(\d{3}\) ?\d{3}-\d{4})")

_EMAIL = re.compile(
    r"(?<![\w.+-])[\w][\w.+-]*(?:@|\s@\s(?=[\w-]+(?:\.[\w-]+)*\.[A-Za-z]{2})|\s?[\[({<]\s?(?:at|chez|arroba|ät|a)\s?[\])}>]\s?|\s(?:at|AT|arroba|chez)\s(?=[\w-]+\s?(?:[\[({<]\s?(?:dot|punto|point|punkt)|\s(?:dot|DOT|punto|point|punkt)\s)))[\w-]+(?:(?:\.|\s?[\[({<]\s?(?:dot|punto|point|punkt)\s?[\])}>]\s?|\s(?:dot|DOT|punto|point|punkt)\s)[\w-]+)+",
)
_AT_WORD = re.compile(r"[\[({<]\s?(?:at|chez|arroba|ät|a)\s?[\])}>]|\s(?:at|AT|arroba|chez)\s(?=[\w-]+\s?(?:[\[({<]|\s(?:dot|DOT|punto|point|punkt)\s))")
_HOST_ONLY = re.compile(r"^(?:git|svn|hg|root|deploy)@|@\d+\.", re.IGNORECASE)

_U = "A-ZÀ-ÖØ-Þ"
_CAP = rf"[{_U}][\w'’-]*"
_TOWN = rf"(?:,? (?:Flat|Apt|Unit|Piso|app|Whg)\.? ?\w{{1,4}})?(?:, \d{{1,2}} ?(?:[A-Z]|º ?[A-Z]?)\b)?(?:,? \d{{4,5}}(?= ?{_CAP}))?(?:,? {_CAP}(?![ ]{_CAP}))?(?: \d{{5}}(?!\d))?"
_STREET = "street|st|road|rd|avenue|ave|lane|ln|square|sq|drive|court|ct|close|place|pl|way|terrace|boulevard|blvd|row|crescent|gardens"
_ADDRESS = re.compile(
    rf"(?:(?:Flat|Apt\.?|Unit) \w+,? |{_CAP} House,? )?(?<![\w.,-])\d{{1,5}} ?[A-Za-z]?(?: bis| ter)?,? (?:[^\W\d_][\w'’-]* ){{1,3}}?(?i:{_STREET})\b\.?{_TOWN}"
    rf"|(?<![\w-])(?:{_CAP}|[a-zà-ÿ][\w-]*)(?:straße|strasse|str\.|weg|gasse|platz|allee|damm|ufer) \d{{1,4}} ?[a-zA-Z]?\b{_TOWN}"
    rf"|(?<![\w.,-])\d{{1,4}} ?(?:bis|ter|quater)?,? (?i:rue|avenue|av\.|boulevard|bd|place|chemin|allée|impasse|quai|cours|route) (?:(?:de|du|des|la|le|les) |l'|d')*[^\W\d_][\w'’-]*{_TOWN}"
    rf"|(?<![\w/])(?i:calle|c/|avda\.?|avenida|plaza|paseo|pza\.?|camino|ronda|carrer) ?(?:(?:de|del|la|las|los|el) )*[^\W\d_][\w'’-]*(?: [^\W\d_][\w'’-]*)?,? (?:(?:nº|n\.º|no\.|núm\.) ?)?\d{{1,4}}\b{_TOWN}"
)

# Every address above has one of these, which are looked for first: words, and what may be part of a word.
_STREET_WORDS = frozenset(_STREET.split("|")) | frozenset("rue avenue av boulevard bd place chemin allée impasse quai cours route".split())
_STREET_PARTS = "straße strasse str. weg gasse platz allee damm ufer calle c/ avda avenida plaza paseo pza camino ronda carrer".split()
_LETTERS = re.compile(r"[^\W\d_]+")


def _has_street(text: str) -> bool:
    low = text.lower()
    return any(p in low for p in _STREET_PARTS) or not _STREET_WORDS.isdisjoint(_LETTERS.findall(low))


# What may be an address with a kind of street that is not listed: capitalised words and a house number with a town or post code, in either order.
_LOW_CAP = rf"[{_U}][a-zà-öø-ÿ'’-]+"
_LOOSE_ADDRESS = re.compile(rf"(?<![\w.,-])(?:{_LOW_CAP} ){{1,3}}\d{{1,4}} ?[a-z]?,? (?:\d{{4,5}} )?{_LOW_CAP}|(?<![\w.,-])\d{{1,4}} ?[a-z]?,? (?:{_LOW_CAP} ){{1,3}}{_LOW_CAP},? \d{{4,5}}\b")

_NUMBER = re.compile(
    r"(?<![\w@#/.\-+])(?:tel:)?\+?(?:\(\d{1,5}\)|\d)[\d]*(?:[ .\-/]{1,2}\(?\d+\)?)*(?:-?[A-Z](?![\w]))?(?:,? ?(?:ext|x|extension|durchwahl|poste|int)\.? ?\d{1,5})?(?![\w@])"
    r"|(?<![\w@#/.\-+])[A-Z]{1,5}[ -]?\d[\dA-Z]*(?:[ .\-/]\d[\dA-Z]*)*(?:[ -][A-Z](?![\w'’]))?(?![\w@])"
    r"|(?<![\w@#/.\-+])[A-Z]{2,6}\d{2}[A-Z]\d{2}[A-Z0-9]{3,8}(?![\w@])"
    r"|(?<![\w@#/.\-+])(?=[A-Z0-9]*[A-Z])(?=(?:[A-Z]*\d){4})[A-Z0-9]{7,18}(?![\w@])",
)
_LEAD_LABEL = re.compile(r"^[A-Z]{3,5}[ -](?=\d)")

_TITLE = r"(?:Dr|Mr|Mrs|Ms|Miss|Prof|Frau|Herr|Sr|Sra|Srta|Mme|Mlle|M|Don|Doña|Señora?|Monsieur|Madame|Sir|Ing)"
_PART = rf"(?:[{_U}][a-zà-öø-ÿ]+(?:[-'’][{_U}]?[a-zà-öø-ÿ]+)*|[{_U}]['’][{_U}][a-zà-öø-ÿ]+(?:-[{_U}][a-zà-öø-ÿ]+)*|[{_U}]['’][{_U}]{{2,}}|[{_U}]{{2,}}(?:[-'’][{_U}]+)*)"
_INITIAL = rf"[{_U}]\."
_PARTICLE = r"(?:van|von|de|del|der|den|da|di|la|le|du|zu|ter|ten|bin|el|y)"
_NAME = re.compile(rf"(?<![\w@#/.\-\[])(?:{_TITLE}\.? (?:{_PARTICLE} ){{0,3}})?(?:{_PART}|{_INITIAL})(?:,? (?:{_PARTICLE} ){{0,3}}(?:{_TITLE}\.? )?(?:{_PARTICLE} ){{0,3}}(?:{_PART}|{_INITIAL}(?= )))*(?![\w/_(=]|\.\w)")
# Pieces of a name at most, without particles.
SPAN = 6
_PIECE = re.compile(rf"{_TITLE}\.?(?= )|{_PART}|{_INITIAL}|{_PARTICLE}|,")
_SEED_NAME = re.compile(rf"^(?:{_TITLE}\.? (?:{_INITIAL} )?(?:{_PARTICLE} )*{_PART}|{_INITIAL} (?:{_PARTICLE} )*{_PART}|{_PART} {_INITIAL} (?:{_PARTICLE} )*{_PART})")
_IS_PARTICLE = re.compile(rf"{_PARTICLE}$")
_WORD = re.compile(r"[^\W_]+(?:['’-][^\W_]+)*|[.!?;:(),\[\]]")
_DIGITS = re.compile(r"\d+")
_END = set(".!?;:(),[]")


def _hash(words: str) -> int:
    return xxhash.xxh3_64_intdigest(words) - 2**63


class _Around:
    """The words of a text with their places, from which the lexical patterns around any span are taken: up to three words before it, two or three after, within the sentence; digits as 0.

    A pattern is shuffled as a 64-bit hash of its words, even for those before and odd for those after.
    """

    def __init__(self, text: str) -> None:
        self.text, self.starts = text, None

    def _read(self) -> None:
        spans = [m.span() for m in _WORD.finditer(self.text)]
        self.starts, self.ends = [a for a, _ in spans], [b for _, b in spans]
        self.words = [_DIGITS.sub("0", self.text[a:b].lower()) for a, b in spans]

    def before(self, start: int, least: int = 1) -> list[int]:
        if self.starts is None:
            self._read()
        i = bisect.bisect_right(self.ends, start)
        left: list[str] = []
        while i and len(left) < 3 and self.words[i - 1] not in _END:
            i -= 1
            left.insert(0, self.words[i])
        return [(_hash("<" + " ".join(left[-n:])) >> 1) << 1 for n in (1, 2, 3) if least <= n <= len(left) and (n > 1 or len(left[-1]) > 2)]

    def after(self, end: int) -> list[int]:
        if self.starts is None:
            self._read()
        i = bisect.bisect_left(self.starts, end)
        right: list[str] = []
        while i < len(self.words) and len(right) < 3 and self.words[i] not in _END:
            right.append(self.words[i])
            i += 1
        return [_hash(">" + " ".join(right[:n])) | 1 for n in (2, 3) if n <= len(right)]

    def sides(self, start: int, end: int, least: int = 1) -> list[int]:
        return self.before(start, least) + self.after(end)


def candidates(text: str) -> list[tuple[str, int, int, str, str, list[int]]]:
    """(group, start, end, instance, seed, patterns) of all spans of `text` that may be a detail. seed is a kind, 'none', or '' where not known."""
    out: list[tuple[str, int, int, str, str, list[int]]] = []
    taken = bytearray(len(text))
    around = _Around(text)

    def free(a: int, b: int) -> bool:
        return taken.find(1, a, b) < 0

    def take(a: int, b: int) -> None:
        taken[a:b] = b"\x01" * (b - a)

    if "@" in text or _AT_WORD.search(text):
        for m in _EMAIL.finditer(text):
            if not _HOST_ONLY.search(m.group()):
                out.append(("email", m.start(), m.end(), m.group().lower(), "email", around.sides(*m.span())))
                take(*m.span())
    digit = any(map(str.isdigit, text))
    for m in _ADDRESS.finditer(text) if digit and _has_street(text) else ():
        if free(*m.span()):
            out.append(("address", m.start(), m.end(), m.group().lower(), "address", around.sides(*m.span())))
            take(*m.span())
    for m in _NUMBER.finditer(text) if digit else ():
        start, end = m.span()
        label = _LEAD_LABEL.match(m.group())
        if label:
            start += label.end()
        if text[end - 1] == ")" and "(" not in text[start:end]:
            end -= 1
        shown = text[start:end]
        digits = sum(ch.isdigit() for ch in shown)
        if digits < 5 or (digits < 7 and shown.replace(" ", "").replace("-", "").isdigit()) or not free(start, end):
            continue
        stop = start
        while stop and text[stop - 1] in " :#=":
            stop -= 1
        from_ = max(0, stop - _LABEL_CHARS)
        left = text[from_:stop]
        named = _LABELLED.search(left)
        before = start  # what stands before the label is the context
        if label and _LABELLED.search(text[max(0, m.start() - 1) : start].rstrip(" :#-")):
            named, before = label, m.start()
        elif named:
            before = from_ + named.start() + (not left[named.start()].isalnum())
        if named:
            seed = "id_number"
        elif _NO_DETAIL.search(left) or _PLAIN_NUMBER.match(shown):
            seed = "none"
        elif _PHONE_SEED.match(shown):
            seed = "phone"
        else:
            seed = ""
        out.append(("number", start, end, shown, seed, around.sides(before, end)))
        take(start, end)
    for m in _LOOSE_ADDRESS.finditer(text) if digit else ():
        if free(*m.span()):
            out.append(("address", m.start(), m.end(), m.group().lower(), "", around.sides(*m.span())))
    for m in _NAME.finditer(text):
        found = list(_PIECE.finditer(text, m.start(), m.end()))
        if len(found) < 2:
            continue
        pieces = [p.group() for p in found]
        comma = [p == "," for p in pieces]
        full = [not c and not _IS_PARTICLE.match(p) for c, p in zip(comma, pieces)]
        left, right = [around.before(p.start()) for p in found], [around.after(p.end()) for p in found]
        # any two to SPAN pieces of the run in a row, with one comma at most, may be the name
        for i in range(len(pieces)):
            if comma[i]:
                continue
            size = commas = 0
            for j in range(i, len(pieces)):
                commas += comma[j]
                size += full[j]
                if size > SPAN or commas > 1:
                    break
                start, end = found[i].start(), found[j].end()
                if size < 2 or comma[j] or not free(start, end):
                    continue
                shown = text[start:end]
                # a title or initial with one part is no whole name where the run goes on
                ends = j + 1 == len(pieces) or comma[j + 1]
                seed = "name" if (ends or j - i > 1) and _SEED_NAME.fullmatch(shown) else ""
                out.append(("name", start, end, shown.lower(), seed, left[i] + right[j]))
    return out


_CANDIDATE = "tbl string, row_key bigint, field string, grp string, start int, stop int, instance string, seed string, patterns array<bigint>"


def candidates_of(texts: DataFrame) -> DataFrame:
    """`candidates` of every row of `texts` (tbl, row_key, field, text)."""
    names = ["tbl", "row_key", "field", "grp", "start", "stop", "instance", "seed", "patterns"]
    schema = pa.schema([("tbl", pa.string()), ("row_key", pa.int64()), ("field", pa.string()), ("grp", pa.string()), ("start", pa.int32()), ("stop", pa.int32()), ("instance", pa.string()), ("seed", pa.string()), ("patterns", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(t, k, f, *c) for t, k, f, x in zip(*(batch.column(i).to_pylist() for i in range(4))) for c in candidates(x)]
            columns = list(zip(*rows)) if rows else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), type=schema.field(i).type) for i, c in enumerate(columns)], schema=schema)

    return texts.where(F.length("text") > 0).select("tbl", F.col("row_key").cast("bigint").alias("row_key"), "field", "text").mapInArrow(run, _CANDIDATE)


_SCORED = ("email", "phone", "id_number", "address", "name", "none")
_GROUPS = "grp IN ('number', 'name', 'address', 'email')"


def pattern_scores(found: DataFrame) -> DataFrame:
    """(grp, pattern, email, phone, id_number, address, name, none): how far each pattern points to each kind, by rounds over the pattern-instance graph.

    Seeds have their kind from the start. A pattern's score for a kind is the sum of its distinct instances' scores over the
    number of those with a verdict, plus UNKNOWN of the round for each without and DOUBT; an instance's score joins its best pattern on either side,
    as the chance that not both are wrong. In each round patterns that surround good instances make their other instances good.
    """
    hashed = F.xxhash64("instance").alias("instance")
    edges = cut(found.where(_GROUPS).select("grp", hashed, "seed", F.explode("patterns").alias("pattern")).distinct())
    seeds = edges.groupBy("grp", "instance").agg(F.max("seed").alias("seed"))
    verdict = seeds.where("seed <> ''").select("grp", "instance", *(F.when(F.col("seed") == k, 1.0).otherwise(0.0).alias(k) for k in _SCORED))
    # Of an instance and a pattern only one edge counts, whatever its seed says there
    links = edges.select("grp", "instance", "pattern").distinct()
    patterns = None
    for turn, unknown in enumerate(UNKNOWN):
        known = links.join(verdict, ["grp", "instance"], "left")
        weight = sum((F.coalesce(F.col(k), F.lit(0.0)) for k in _SCORED), F.lit(0.0))
        total = F.sum(F.greatest(weight, F.lit(unknown))) + DOUBT
        patterns = known.groupBy("grp", "pattern").agg(*((F.sum(F.coalesce(F.col(k), F.lit(0.0))) / total).alias(k) for k in _SCORED))
        patterns = cut(patterns.where(reduce(lambda a, b: a | b, (F.col(k) >= 0.05 for k in _SCORED))))
        if turn < len(UNKNOWN) - 1:
            scored = links.join(patterns, ["grp", "pattern"]).groupBy("grp", "instance").agg(*(_either_side(k) for k in _SCORED))
            sure = reduce(lambda a, b: a | b, (F.col(k) >= ACCEPT for k in _SCORED))
            learned = scored.where(sure).join(seeds.where("seed <> ''"), ["grp", "instance"], "left_anti")
            verdict = cut(seeds.where("seed <> ''").select("grp", "instance", *(F.when(F.col("seed") == k, 1.0).otherwise(0.0).alias(k) for k in _SCORED)).unionByName(learned.select("grp", "instance", *_SCORED)))
    return patterns


def _either_side(k: str):
    before = F.col("pattern").bitwiseAND(F.lit(1).cast("bigint")) == 0
    left, right = F.max(F.when(before, F.col(k)).otherwise(0.0)), F.max(F.when(~before, F.col(k)).otherwise(0.0))
    return (1 - (1 - left) * (1 - right)).alias(k)


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("nth", T.LongType()), T.StructField("start", T.IntegerType()), T.StructField("stop", T.IntegerType())])))
def _settled(rows: pd.Series) -> pd.Series:
    """The spans of one text that do not overlap, best scores first, then longer ones, numbered by kind in the order of the text."""

    def settle(spans) -> list[tuple[str, int, int, int]]:
        kept: list[tuple[int, int, str]] = []  # in order of the text, none overlaps another
        for s in sorted(spans, key=lambda s: (-round(s["score"], 3), s["start"] - s["stop"], s["start"])):
            i = bisect.bisect_left(kept, (s["start"],))
            if (i == 0 or kept[i - 1][1] <= s["start"]) and (i == len(kept) or kept[i][0] >= s["stop"]):
                kept.insert(i, (s["start"], s["stop"], s["kind"]))
        count: dict[str, int] = {}
        out = []
        for a, b, kind in kept:
            count[kind] = count.get(kind, 0) + 1
            out.append((kind, count[kind], a, b))
        return out

    return rows.map(settle)


def _small_names(texts: DataFrame, names: DataFrame) -> DataFrame:
    """Candidates for names in lower case: words that are first parts of at least two of the `names` found so far, with the one to three words that follow.

    A word that stands in lower case in more than five times as many texts as there are names with it is an ordinary word and none of these.
    """
    row = ["tbl", "row_key", "field"]
    first = F.regexp_extract("instance", rf"^(?:(?i:{_TITLE})\.? )?(\p{{L}}{{3,}})[ ]", 1)
    parts = names.select(first.alias("part"), "instance").where("part <> ''").groupBy("part").agg(F.count_distinct("instance").alias("n")).where("n >= 2")
    each = texts.where(F.length("text") > 0).select(*row, F.explode(F.array_distinct(F.split("text", r"[^\p{L}]+"))).alias("word")).where(F.length("word") >= 3)
    words = each.select(*row, F.lower("word").alias("part"), (F.col("word") == F.lower("word")).alias("small")).join(parts, "part", "left_semi")
    words = cut(words)
    ordinary = words.where("small").groupBy("part").agg(F.count(F.lit(1)).alias("uses"))
    parts = parts.join(ordinary, "part", "left").where(F.coalesce("uses", F.lit(0)) <= 5 * F.col("n")).select("part")
    hits = words.join(parts, "part").groupBy(*row).agg(F.collect_set("part").alias("parts"))
    schema = pa.schema([("tbl", pa.string()), ("row_key", pa.int64()), ("field", pa.string()), ("grp", pa.string()), ("start", pa.int32()), ("stop", pa.int32()), ("instance", pa.string()), ("seed", pa.string()), ("patterns", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for t, k, f, x, own in zip(*(batch.column(i).to_pylist() for i in range(5))):
                around = _Around(x)
                # found at every word, as a word before the name may be taken for its first part
                for m in re.finditer(r"(?<![\w@.+/-])(?=((?i:" + "|".join(map(re.escape, own)) + rf")(?: {_PARTICLE}){{0,2}} [^\W\d_A-Z][\w'’-]*)(?![\w@]))", x):
                    rows.append((t, k, f, "name", m.start(1), m.end(1), m.group(1).lower(), "", around.sides(*m.span(1), 2)))
            columns = list(zip(*rows)) if rows else [[]] * len(schema)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), type=schema.field(i).type) for i, c in enumerate(columns)], schema=schema)

    return texts.join(hits, row).select(*row, "text", "parts").mapInArrow(run, _CANDIDATE)


def _weighed(found: DataFrame, patterns: DataFrame) -> DataFrame:
    """Kind, score for it and score against any for each span in `found`, by its seed or else the best patterns beside it."""
    row = ["tbl", "row_key", "field"]
    lettered = F.regexp_replace(F.lower("instance"), r"^tel:|(?:ext|x|extension|durchwahl|poste|int)\.? ?\d+$", "").rlike("[a-z]")
    own = found.where(_GROUPS).select(*row, "grp", "start", "stop", "seed", F.xxhash64("instance").alias("instance"), lettered.alias("lettered"), F.explode_outer("patterns").alias("pattern"))
    scored = own.join(patterns, ["grp", "pattern"], "left").groupBy(*row, "grp", "start", "stop", "seed", "instance", "lettered").agg(*(_either_side(k) for k in _SCORED))
    by_seed = lambda k: F.when(F.col("seed") == k, 1.0).when(F.col("seed") == "none", 0.0).otherwise(F.coalesce(k, F.lit(0.0)))
    phone = F.when(F.col("lettered"), 0.0).otherwise(by_seed("phone"))  # no telephone number has letters but in its extension
    number = F.when(phone >= by_seed("id_number"), "phone").otherwise("id_number")
    kind = F.when(F.col("grp") == "number", number).otherwise(F.col("grp"))
    score = F.when(F.col("grp") == "number", F.greatest(phone, by_seed("id_number"))).otherwise(F.coalesce(*(F.when(F.col("grp") == k, by_seed(k)) for k in ("name", "address", "email"))))
    # of what overlaps, an address or mailbox shown by its shape goes first
    score = score + F.when((F.col("seed") != "") & F.col("grp").isin("address", "email"), 1.0).otherwise(0.0)
    against = F.when((F.col("grp") == "number") & (F.col("seed") == ""), F.coalesce("none", F.lit(0.0))).otherwise(0.0)
    weighed = cut(scored.select(*row, "start", "stop", "instance", kind.alias("kind"), score.alias("score"), against.alias("against")))
    # A product may stand in a place for names now and then; a name does so nearly always
    steady = weighed.where("kind = 'name'").groupBy("instance").agg(F.avg((F.col("score") >= FINAL).cast("double")).alias("share")).where("share >= 0.5").select("instance")
    names = weighed.where("kind = 'name'").join(steady, "instance", "left_semi")
    return weighed.where("kind <> 'name'").unionByName(names).drop("instance")


def details(texts: DataFrame) -> DataFrame:
    """(tbl, row_key, field, kind, nth, start, stop) of every personal detail in `texts` (tbl, row_key, field, text).

    Spans that may be a detail are taken from each text by shape. A span is a seed where its shape alone shows the kind (a mailbox, a listed kind of
    street with a house number) or where a label, a dialling prefix, a title or an initial says so. Seeds induce lexical patterns (the words around them),
    which `pattern_scores` weighs over the whole corpus; patterns of high score then find the numbers, names and addresses that have
    no such sign, and tell phone from id numbers, and both from order numbers, dates and the like. nth counts
    the details of a kind in a text. Null and empty texts have none; equal texts have equal ones; a row key is expected once per table and field.
    """
    texts = texts.select("tbl", F.col("row_key").cast("bigint").alias("row_key"), "field", "text")
    found = cut(candidates_of(texts))
    patterns = pattern_scores(found)
    row = ["tbl", "row_key", "field"]
    strict = _weighed(found, patterns)
    names = found.join(strict.where((F.col("kind") == "name") & (F.col("score") >= FINAL)).select(*row, "start", "stop"), [*row, "start", "stop"], "left_semi").where("grp = 'name'")
    weighed = strict.unionByName(_weighed(_small_names(texts, names), patterns))
    accepted = weighed.where((F.col("score") >= FINAL) & (F.col("score") > F.col("against"))).drop("against")
    spans = accepted.groupBy(*row).agg(F.collect_list(F.struct("kind", "score", "start", "stop")).alias("spans"))
    return spans.select(*row, F.explode(_settled("spans")).alias("d")).select(*row, "d.kind", "d.nth", "d.start", "d.stop")


@F.pandas_udf(T.StringType())
def _replaced(text: pd.Series, spans: pd.Series) -> pd.Series:
    def one(x: str, ds) -> str:
        if ds is None:
            return x
        for d in sorted(ds, key=lambda d: -d["start"]):
            x = x[: d["start"]] + f"[{d['kind'].upper()}]" + x[d["stop"] :]
        return x

    return pd.Series([one(x, ds) for x, ds in zip(text, spans)])


def redacted(texts: DataFrame) -> DataFrame:
    """`texts` with each detail replaced by a placeholder of its type, as [PHONE]; all else stays as it is, null stays null."""
    row = ["tbl", "row_key", "field"]
    texts = texts.select("tbl", F.col("row_key").cast("bigint").alias("row_key"), "field", "text")
    spans = details(texts).groupBy(*row).agg(F.collect_list(F.struct("kind", "start", "stop")).alias("spans"))
    return texts.join(spans, row, "left").select(*row, _replaced("text", "spans").alias("text"))


def _texts(spark: SparkSession, sf: str) -> DataFrame:
    notes = table(spark, sf, "notes", "note_key", "lesson", "evidence")
    fields = F.explode(F.array(F.struct(F.lit("lesson").alias("field"), F.col("lesson").alias("text")), F.struct(F.lit("evidence").alias("field"), F.col("evidence").alias("text"))))
    of_notes = notes.select(F.lit("notes").alias("tbl"), F.col("note_key").alias("row_key"), fields.alias("f")).select("tbl", "row_key", "f.field", "f.text")
    return of_notes.unionByName(table(spark, sf, "redact_results").select(F.lit("redact_results").alias("tbl"), F.col("result_key").alias("row_key"), F.lit("text").alias("field"), "text"))


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    """Each personal detail."""
    return details(_texts(spark, sf)).select("tbl", "row_key", "field", "kind", "nth")


def p2_redacted(spark: SparkSession, sf: str) -> DataFrame:
    """All texts with placeholders for the details."""
    return redacted(_texts(spark, sf))


QUERIES = {"p2_found": p2_found, "p2_redacted": p2_redacted}
SQL: dict[str, str] = {}
