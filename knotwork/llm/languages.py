"""Function words of the four languages of the data, and how texts are matched against them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Frequent words without content. Words of two languages stand in both.
FUNCTION_WORDS = {
    "en": "the and that is are was were it its to of if when then this with not for must should after before because do let we you be has have which while until unless there here i as by an or so from than but can will they at on in why how what".split(),
    "de": "der die das den dem des und ist sind war wird werden nicht ein eine einen einem einer wenn dass ob mit von für auf bis weil falls nach vor bei wir ich sich nur muss darf noch auch über zu im am als aber oder es sie man kann sobald solange bevor nachdem an aus warum wie was".split(),
    "fr": "le la les des du un une et est sont ne pas que qui pour dans avec sur il elle nous vous je doit quand après avant parce puis plus ce cette ces au aux l d n qu se sa son si tant mais ou où par en de comme pourquoi comment".split(),
    "es": "el la los las un una y es son no que se para por con si cuando después antes porque debe del al lo nos su más está hasta tras luego hay he ha sin pero o como mientras desde en de qué cómo".split(),
}

# Names of the languages, to see a request for one of them in a prompt.
LANGUAGE_NAMES = {
    "en": "english englisch englische anglais inglés ingles".split(),
    "de": "german deutsch deutsche allemand alemán aleman".split(),
    "fr": "french französisch französische français francais francés frances".split(),
    "es": "spanish spanisch spanische espagnol español espanol castellano".split(),
}


# Scripts by the name that patterns have for them, and names of languages written in them, to see a request for one in a prompt.
SCRIPTS = {
    "Cyrillic": "russian russisch russisches russische russe ruso russo русск ukrainian ukrainisch ukrainien ucraniano украин bulgarian bulgarisch bulgare búlgaro serbian serbisch serbe serbio",
    "Greek": "greek griechisch grec griego ελληνικ",
    "Arabic": "arabic arabisch arabe árabe عرب persian persisch persan persa farsi urdu",
    "Hebrew": "hebrew hebräisch hébreu hebreo עברית",
    "Devanagari": "hindi हिन्दी marathi nepali",
    "Thai": "thai thailändisch thaï tailandés ไทย",
    "Hangul": "korean koreanisch coréen coreano 한국어",
    "Han": "chinese chinesisch chinois chino 中文 汉语 japanese japanisch japonais japonés 日本語",
    "Latin": "english englisch anglais inglés german deutsch allemand alemán french französisch français francés spanish spanisch espagnol español английск немецк французск испанск 英語 英文 英语 영어",
}
# Letters of one way of writing that count as one script.
_LETTERS = {"Han": ("Han", "Hiragana", "Katakana")}


def words_of(c: Column) -> Column:
    """The words of `c`, lower case, parted at anything but letters and digits, one space between and around them; an elided article is a word of its own."""
    return F.concat(F.lit(" "), F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", " "), F.lit(" "))


def split_words(words: Column) -> Column:
    return F.split(F.btrim(words), " +")


def listed(words: list[str]) -> Column:
    """`words` as an array, in one expression that is folded."""
    return F.split(F.lit(" ".join(words)), " ")


def language_scores(words: Column) -> Column:
    """Struct with the number of distinct function words of each language among `words`, an array."""
    return F.struct(*(F.size(F.array_intersect(listed(ws), words)).alias(k) for k, ws in FUNCTION_WORDS.items()))


def best_language(scores: Column, least: int = 2) -> Column:
    """The language with the highest score, null below `least` or when two share it."""
    top = F.greatest(*(scores[k] for k in FUNCTION_WORDS))
    winners = sum(((scores[k] == top).cast("int") for k in FUNCTION_WORDS), F.lit(0))
    pick = F.coalesce(*(F.when(scores[k] == top, F.lit(k)) for k in FUNCTION_WORDS))
    return F.when((top >= least) & (winners == 1), pick)


def script_of(c: Column, least: int) -> Column:
    """The script that has more than half of the letters of `c`, null with fewer than `least` letters."""
    n = F.length(F.regexp_replace(c, r"[^\p{L}]", ""))
    own = lambda s: F.length(F.regexp_replace(c, "[^" + "".join(rf"\p{{Is{x}}}" for x in _LETTERS.get(s, (s,))) + "]", ""))
    return F.when(n >= least, F.coalesce(*(F.when(own(s) * 2 > n, F.lit(s)) for s in SCRIPTS)))


def script_asked(words: Column, script: Column) -> Column:
    """Whether a language written in `script` is named in the text `words`."""
    return F.coalesce(*(F.when(script == s, words.rlike("|".join(names.split()))) for s, names in SCRIPTS.items()), F.lit(False))


# The same in SQL, for the check.
def sql_script(c: str, least: int) -> str:
    own = lambda s: f"length(regexp_replace({c}, '[^" + "".join(rf"\p{{{x}}}" for x in _LETTERS.get(s, (s,))) + "]', '', 'g'))"
    n = rf"length(regexp_replace({c}, '[^\p{{L}}]', '', 'g'))"
    return f"CASE WHEN {n} < {least} THEN NULL " + " ".join(f"WHEN {own(s)} * 2 > {n} THEN '{s}'" for s in SCRIPTS) + " END"


def sql_script_asked(words: str, script: str) -> str:
    return "coalesce(CASE " + " ".join(f"WHEN {script} = '{s}' THEN regexp_matches({words}, '{'|'.join(names.split())}')" for s, names in SCRIPTS.items()) + " END, false)"
