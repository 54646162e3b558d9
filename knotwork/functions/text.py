"""Token and similarity expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words left out by the lexical tokenizer.
LEXICAL_STOP = "the a an and or but of to in on for with is are was were be been being this that it its as at by from must should always never".split()
# Words left out when an alternative is matched with a rejected one.
REJECTED_STOP = LEXICAL_STOP + "not do does make makes made".split()
# Words left out when two statements are compared by topic.
TOPIC_STOP = "the a an is are be of to for with and or at in on by under over than from this that".split()
# Words without meaning in source code.
CODE_STOP = (
    "the and for this self new return const let var function async await yield import export from default class interface type enum extends implements public "
    "private protected static readonly void null undefined true false number string boolean object any unknown never throw catch try finally else case switch "
    "while break continue typeof instanceof def pass elif with not value result options option args"
).split()
# Characters read of a text, and tokens kept of one.
READ_CHARS, TOKEN_CAP, TEXT_TOKEN_CAP = 4000, 50, 200


def _without(words: Column, stop: list[str], longer: int) -> Column:
    return F.array_except(F.filter(words, lambda w: F.length(w) > longer), F.array(*(F.lit(s) for s in stop)))


def lexical_tokens(c: Column, stop: list[str] = LEXICAL_STOP, longer: int = 2, keep_underscore: bool = True) -> Column:
    """Distinct ASCII words of `c` over `longer` characters without `stop`; empty for null."""
    kept = "[^a-z0-9_ ]+" if keep_underscore else "[^a-z0-9 ]"
    return _without(F.split(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), kept, " "), r"\s+"), stop, longer)


def split_identifier(c: Column) -> Column:
    """Parts of an identifier at camel, acronym, snake and other boundaries, lower case."""
    spaced = F.regexp_replace(F.regexp_replace(c, "([a-z0-9])([A-Z])", "$1 $2"), "([A-Z]+)([A-Z][a-z])", "$1 $2")
    return F.transform(F.filter(F.split(spaced, "[^A-Za-z0-9]+"), lambda p: p != ""), F.lower)


def code_tokens(c: Column, cap: int = TOKEN_CAP) -> Column:
    """The first `cap` distinct identifier parts of the first READ_CHARS characters of `c`, over two characters, without CODE_STOP, in order."""
    words = F.regexp_extract_all(F.substring(F.coalesce(c, F.lit("")), 1, READ_CHARS), F.lit("([A-Za-z][A-Za-z0-9_$]*)"), 1)
    parts = F.flatten(F.transform(F.array_distinct(words), split_identifier))  # a word that comes again has no new parts
    return F.slice(_without(parts, CODE_STOP, 2), 1, cap)


def jaccard(a: Column, b: Column) -> Column:
    """Common over all of two sets; 0 where either is empty."""
    common = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(common / (F.size(a) + F.size(b) - common))


def js_round(c: Column, digits: int = 0) -> Column:
    """Rounding of halves towards plus infinity, as floor(x + 0.5)."""
    scale = 10.0**digits
    return F.floor(c * scale + 0.5) / scale if digits else F.floor(c + 0.5)


# The same in SQL, for the oracle.
def sql_list(words: list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def sql_lexical(c: str, stop: list[str] = LEXICAL_STOP, longer: int = 2, keep_underscore: bool = True) -> str:
    kept = "[^a-z0-9_ ]+" if keep_underscore else "[^a-z0-9 ]"
    return f"list_distinct(list_filter(string_split_regex(regexp_replace(lower(coalesce({c}, '')), '{kept}', ' ', 'g'), '\\s+'), lambda w: length(w) > {longer} AND NOT list_contains({sql_list(stop)}, w)))"


def sql_jaccard(a: str, b: str) -> str:
    common = f"len(list_intersect({a}, {b}))"
    return f"CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0.0::DOUBLE ELSE {common}::DOUBLE / (len({a}) + len({b}) - {common}) END"


def sql_split_identifier(c: str) -> str:
    spaced = f"regexp_replace(regexp_replace({c}, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '([A-Z]+)([A-Z][a-z])', '\\1 \\2', 'g')"
    return f"list_transform(list_filter(string_split_regex({spaced}, '[^A-Za-z0-9]+'), lambda p: p <> ''), lambda p: lower(p))"
