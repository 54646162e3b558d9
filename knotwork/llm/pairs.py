"""Problem 4: prompt and response pairs whose response is no proper answer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import table
from .formatting import letters_and_digits
from .languages import FUNCTION_WORDS, LANGUAGE_NAMES, best_language, language_scores, listed, script_asked, script_of, split_words, sql_script, sql_script_asked, words_of

# Order of the rules: a pair that triggers several is counted under the first.
ORDER = ("empty", "copy", "refusal", "truncated", "wrong_language")

# What stands for no answer, letters and digits only.
PLACEHOLDERS = "empty emptyanswer emptyoutput emptyresponse nooutput noanswer noresponse nocontent na null none nil nan undefined blank tbd placeholder answer output response leer keineantwort keineausgabe vide aucuneréponse aucunesortie vacío sinrespuesta sinsalida".split()

# Wordings of a declined request, matched on words (lower case, parted at punctuation and apostrophes).
REFUSALS = {
    "en": [
        "(?:i ?m|i am|we are) (?:so |very |really |truly )?sorry (?:but )?(?:i|we|i ?m|i am|that|this)(?: \\S+){0,4} (?:can ?t|cannot|can not|unable|not able|not allowed|outside|won ?t)",
        "sorry (?:but )?(?:i (?:can ?t|cannot|won ?t|am unable|am not able)|this (?:request|task) (?:is|falls))",
        "i (?:cannot|can ?t|can not|won ?t|will not|could not|am unable to|am not able to|am not allowed to|am not permitted to) (?:help|assist|comply|answer|fulfil|fulfill|support|proceed|continue with (?:this|that)|do (?:this|that|it|so)|make (?:this|that|the) change|work on (?:this|that)|complete (?:this|that)|provide (?:this|that|any)|discuss|respond|carry out (?:this|that))",
        "(?:as|being) an? (?:ai|assistant|language model|ai assistant|ai model)(?: \\S+){0,5} (?:not|can ?t|cannot|unable|won ?t)",
        "(?:i|we) (?:must|have to|need to|will have to) (?:respectfully )?(?:decline|refuse|reject)",
        "i (?:respectfully )?(?:refuse|decline) (?:to|this|that)",
        "(?:not|nothing) (?:something )?(?:that )?i can (?:do|help|assist|support)",
        "(?:don ?t|do not|would not|wouldn ?t) feel comfortable",
        "(?:i ?m|i am) not comfortable",
        "(?:against|violates?|outside) (?:of )?(?:my|our) (?:guidelines|policy|policies|rules|scope)",
        "(?:outside|beyond) (?:of )?what (?:i ?m|i am) (?:allowed|able|permitted)",
        "(?:i ?m|i am) not (?:allowed|permitted|authorized|authorised) to",
    ],
    "de": [
        "(?:tut mir leid|es tut mir leid|leider|entschuldigung)(?: \\S+){0,6} (?:nicht|keine?n?)(?: \\S+){0,2} (?:helfen|beantworten|bearbeiten|erfüllen|unterstützen|ausführen|erledigen|weiterhelfen|tun|machen)",
        "(?:kann|darf|werde|möchte|will) (?:ich )?(?:\\S+ ){0,4}nicht (?:helfen|beantworten|bearbeiten|erfüllen|unterstützen|ausführen|erledigen|weiterhelfen|tun|machen)",
        "(?:muss|möchte|will|werde)(?: \\S+){0,4} ablehnen",
        "(?:ist mir|bin ich|ich bin|es ist mir)(?: \\S+){0,3} nicht (?:erlaubt|gestattet|befugt|berechtigt|möglich)",
        "(?:verstößt|verstoßen|geht) gegen (?:meine|unsere|die) (?:richtlinien|regeln|vorgaben)",
    ],
    "fr": [
        "(?:désolée?|navrée?|regrette)(?: \\S+){0,4} ne (?:peux|puis|suis|pourrai)",
        "je ne (?:peux|puis|pourrai|vais|suis) (?:pas )?(?:malheureusement )?(?:pas )?(?:vous |t |y |le )?(?:aider|répondre|faire|traiter|accéder|satisfaire|en mesure|autorisée?|habilitée?|effectuer)",
        "je (?:dois|suis obligée? de|suis contrainte? de|préfère|me vois contrainte? de) (?:refuser|décliner|rejeter)",
        "je (?:refuse|décline)",
        "(?:contraire|contre|enfreint) (?:à )?(?:mes|nos|les) (?:règles|consignes|directives|principes)",
    ],
    "es": [
        "(?:lo siento|lo lamento|disculpa|perdón|lamentablemente)(?: \\S+){0,4} no (?:puedo|podré|me es posible|estoy)",
        "no (?:puedo|podré|voy a) (?:ayudar|ayudarte|ayudarle|hacer|hacerlo|responder|atender|cumplir|realizar|contestar|asistir)",
        "no (?:tengo permitido|tengo permiso|estoy autorizad[oa]|se me permite|me está permitido)",
        "(?:debo|tengo que|he de|me veo obligad[oa] a) (?:rechazar|negarme|declinar)",
        "(?:va en contra de|contra|incumple) (?:mis|nuestras|las) (?:normas|reglas|directrices|pautas)",
    ],
}
_REFUSAL = " (?:" + "|".join(p for ps in REFUSALS.values() for p in ps) + ") "
# Every wording has one of these words, which are looked for first.
_REFUSING = (
    "sorry can cant cannot wont will won could unable not decline refuse reject ai assistant model comfortable guidelines policy policies rules scope outside beyond "
    "nicht kein keine keinen ablehnen richtlinien regeln vorgaben ne refuser décliner rejeter refuse décline règles consignes directives principes no rechazar negarme declinar normas reglas directrices pautas"
).split()

# A short output without code that opens with a refusal is one, whatever follows; the SQL has this rule only.
OPENING_WORDS, OTHER_WORDS = 40, 90

# Words by which a sentence explains a refusal or offers something else, matched on words.
EXPLAINING = (
    "because|since|therefore|policy|policies|guidelines?|rules|safety|safely|harm|harmful|risks?|illegal|permissions?|allowed|permitted|authori[sz]ed|sorry|apologi[sz]e|understand|instead|happy to|glad to|"
    "let me know|please|if you|you (?:asked|want|wanted|requested|may|might|could|can)|your (?:request|question|prompt|task)|the (?:request|prompt|task) (?:is|asks|asked|was)|this (?:request|task)|i (?:cannot|can ?t|can not|won ?t|will not|could|can|am not|would|hope)|"
    "weil|richtlinien|regeln|stattdessen|bitte|gerne|wenn (?:du|sie)|(?:deine|ihre) (?:anfrage|frage|bitte)|"
    "parce que|car|règles|directives|plutôt|veuillez|si vous|si tu|votre (?:demande|question)|"
    "porque|normas|directrices|en su lugar|por favor|si (?:quieres|desea|usted)|(?:tu|su) (?:solicitud|petición|pregunta)"
)
# A solution has at least so many words besides the sentences that refuse, explain or restate the task.
SOLUTION_WORDS = 12

_FENCE = r"(?s)```.*?(?:```|$)"
_TAG = r"</?[A-Za-z][^<>]*>"
_TERMINAL = r"[.!?;:。！？…)\]}>\"'”’»*_`|~]$"
_CUT_MARK = r"(?:\.\.\.|…)$"
_BLANKS = " \t\n\x0b\f\r\u00a0\u200b\ufeff"
_ITEM = r"^\s*(?:[-*+•]|\d+[.)])\s+\S"
# A label of more letters than this before a copied prompt is one only if a colon or line end closes it and no sentence ends in it.
LABEL = 24
# Letters of the end of a text by which a copy is ruled out before the whole is compared.
_END = 64
# Words after which a phrase has to go on.
DANGLING = "the a an of to in on at by for from with and or but der die das den dem des ein eine und oder von zu mit für le la les des du un une et ou de à pour el los las un una y o del para con".split()


def tail(output: Column) -> Column:
    """`output` without blanks and zero-width characters at its ends."""
    return F.btrim(F.coalesce(output, F.lit("")), F.lit(_BLANKS))


def _asked(words: Column, names: Column) -> Column:
    """The languages that a prompt asks for; `names` are its words, an array."""
    every = [n for ns in LANGUAGE_NAMES.values() for n in ns]
    found = F.array_compact(F.array(*(F.when(words.rlike(" (?:in|into|auf|ins|en|al|au|to|vers) (?:" + "|".join(ns) + ") "), F.lit(k)) for k, ns in LANGUAGE_NAMES.items())))
    return F.when(F.arrays_overlap(names, listed(every)), found).otherwise(F.array().cast("array<string>"))


def _stages():
    """Functions from a getter of the columns so far to a dict of new ones, one after the other."""

    def top(scores: Column) -> Column:
        return F.greatest(*(scores[k] for k in FUNCTION_WORDS))

    def ends(c):
        return {"tail": tail(c("o")), "code": c("o").contains("`"), "end_o": letters_and_digits(F.right(tail(c("o")), F.lit(_END))), "end_p": letters_and_digits(F.right(tail(c("p")), F.lit(_END)))}

    def texts(c):
        # a copy ends as the prompt does: only then are the letters of both needed
        m = F.least(F.length(c("end_o")), F.length(c("end_p")))
        maybe = F.right(c("end_o"), m) == F.right(c("end_p"), m)
        bare = F.regexp_replace(F.regexp_replace(c("o"), r"```[A-Za-z]*", " "), _TAG, " ")
        marked = c("code") | c("o").contains("<")
        return {
            "lp": F.when(maybe, letters_and_digits(c("p"))).otherwise(""), "lo": F.when(maybe, letters_and_digits(c("o"))).otherwise(""),
            "bare": F.when(marked, letters_and_digits(bare)).when(c("o").rlike(r"(?:[\p{L}\p{N}][^\p{L}\p{N}]*){25}"), "longer than any placeholder").otherwise(letters_and_digits(c("o"))),
            "words": words_of(c("o")), "words_p": words_of(_prose(c("p"))), "prose": F.when(c("code"), _prose(c("o"))).otherwise(c("o")),
            "fences": F.when(c("code"), F.size(F.split(c("tail"), "```")) - 1).otherwise(0), "last": F.substring_index(c("tail"), "\n", -1),
        }

    def parts(c):
        unquoted = F.regexp_replace(c("prose"), r"“[^”]*”|«[^»]*»|\"[^\"]*\"", " ")
        return {
            "label": F.instr(c("lo"), c("lp")) - 1, "beside": F.length(F.replace(c("lo"), c("lp"), F.lit(""))),
            "own_words": split_words(c("words")), "array_p": split_words(c("words_p")),
            "inner_words": F.when(c("prose").rlike("[“«\"]"), split_words(words_of(unquoted))), "outer_words": F.when(c("code"), split_words(words_of(c("prose")))),
        }

    def languages(c):
        outer = F.coalesce(c("outer_words"), c("own_words"))
        return {
            "refused": F.arrays_overlap(c("own_words"), listed(_REFUSING)) & c("words").rlike(_REFUSAL),
            "inner": F.when(c("inner_words").isNotNull(), language_scores(c("inner_words"))), "outer": language_scores(outer), "of_prompt": language_scores(c("array_p")),
            "asked": _asked(c("words_p"), c("array_p")), "foreign_letters": c("prose").rlike(_NOT_LATIN) | c("p").rlike(_NOT_LATIN),
        }

    def scores(c):
        return {"scores": F.when(top(c("inner")) >= 3, c("inner")).otherwise(c("outer")), "lang_p": best_language(c("of_prompt"), 1)}

    def winner(c):
        letters = lambda x, least: F.when(c("foreign_letters"), script_of(x, least))
        return {
            "lang": best_language(c("scores"), 3), "own": F.coalesce(*(F.when(c("lang_p") == k, c("scores")[k]) for k in FUNCTION_WORDS)),
            "sure": top(c("of_prompt")) >= 2, "script_p": letters(_prose(c("p")), 4), "script_o": letters(c("prose"), 10),
        }

    def flags(c):
        whole = c("tail").rlike(_TERMINAL) & ~(c("tail").rlike(_CUT_MARK) & (F.length(c("tail")) > 3))
        label = (c("label") <= LABEL) | (F.length(letters_and_digits(F.regexp_extract(c("o"), r"^([^\n:.!?]*)[:\n]", 1))) == c("label"))
        opening = F.concat(F.substring_index(c("words"), " ", OPENING_WORDS), F.lit(" "))
        short = ~c("o").contains("```") & (F.size(F.split(c("words"), " ")) <= OTHER_WORDS)
        foreign = ~F.array_contains(c("asked"), c("lang")) & (c("lang") != c("lang_p")) & (top(c("scores")) >= F.when(c("sure"), 1.5 * c("own")).otherwise(4 * c("own") + 4))
        return {
            "empty": c("bare").isin("", *PLACEHOLDERS),
            "copy": (c("lp") != "") & (c("label") >= 0) & (c("beside") == c("label")) & c("lo").endswith(c("lp")) & label,
            "refusal": c("refused") & (short & opening.rlike(_REFUSAL) | ~_solved(c("p"), c("o"))),
            "truncated": (c("fences") % 2 == 1) | (~whole & c("tail").rlike(r"\s") & ~(c("last").rlike(_ITEM) & _item_ends(c("tail"), c("last")))) | _unclosed(c("tail"), c("code")),
            "wrong_language": F.coalesce(foreign, F.lit(False)) | F.coalesce((c("script_p") != c("script_o")) & ~script_asked(c("words_p"), c("script_o")), F.lit(False)),
        }

    return ends, texts, parts, languages, scores, winner, flags


# What is passed over when brackets are counted: numbers of lists, faces made of signs, all other characters.
_NO_BRACKET = r"(?:^|\s)\w{1,3}\)|[:;]-?[()]|[^()\[\]“”«»]"
_NOT_LATIN = r"[^\P{L}\p{IsLatin}]"


def _item_ends(text: Column, last: Column) -> Column:
    """Whether a list item without a sentence end is whole: none of the other items of `text` has one, and its last word closes a phrase."""
    others = F.filter(F.split(text, "\n"), lambda x: x.rlike(_ITEM) & x.rlike(r"[.!?]\s*$"))
    return (F.size(others) == 0) & ~last.rlike(r"(?:[,(–—-]|(?i:\s(?:" + "|".join(DANGLING) + r")))\s*$")


def _unclosed(text: Column, code: Column) -> Column:
    """Whether a bracket or quotation mark is open at the end of `text`: in its last paragraph, outside code."""
    last = F.substring_index(F.when(code, _prose(text)).otherwise(text), "\n\n", -1)
    left = F.regexp_replace(last, _NO_BRACKET, "")
    for _ in range(3):
        left = F.regexp_replace(left, r"\(\)|\[\]|“”|«»", "")
    return F.when(text.rlike(r"[(\[“«]"), left.rlike(r"[(\[“«]$")).otherwise(False)


def _solved(prompt: Column, output: Column) -> Column:
    """Whether `output` has a solution besides the sentences that refuse, explain or restate the prompt: code in a fence or SOLUTION_WORDS words."""
    code = F.exists(F.regexp_extract_all(output, F.lit(r"(?s)```[^\n`]*\n?(.*?)(?:```|$)"), F.lit(1)), lambda x: x.rlike(r"[\p{L}\p{N}]"))
    bare = F.regexp_replace(output, _FENCE, " ")
    sentences = F.transform(F.split(F.regexp_replace(bare, r"([.!?。！？])\s+", "$1\n"), r"\n+"), words_of)
    asked = words_of(prompt)
    left = F.filter(sentences, lambda x: ~x.rlike(_REFUSAL) & ~x.rlike(f" (?:{EXPLAINING}) ") & ~asked.contains(x))
    return code | (F.aggregate(left, F.lit(0), lambda n, x: n + F.size(F.filter(F.split(x, " "), lambda w: w != ""))) >= SOLUTION_WORDS)


def _prose(output: Column) -> Column:
    """`output` without code."""
    return F.regexp_replace(F.regexp_replace(output, _FENCE, " "), r"`[^`\n]*`", " ")


def with_defects(df: DataFrame, prompt: str = "prompt", output: str = "output") -> DataFrame:
    """`df` with `defects`, an array of every defect type that the pair triggers, in the order of the rules (ORDER).

    empty: no letter or digit but in markup, or a placeholder. copy: the letters and digits of the prompt, once or repeated, after at
    most a label: LABEL letters, or any number up to a colon or line end. refusal: a phrase of REFUSALS in the opening of a short output without code, or anywhere in an output
    without a solution besides (`_solved`). truncated: an unclosed code fence, bracket or quotation, or an end that closes no sentence, list item, code or one-word answer;
    a list item is measured by the other items. wrong_language: the prose outside code and quotes
    has mainly function words of another of the four languages than the prompt's, or is in another script, and the prompt does not ask for that.
    A null or empty output is `empty`; with a null or empty prompt no copy and no language can be told. Texts of any length are
    read whole; equal rows get equal defects. All rules are built-in expressions on one scan: no shuffle, no Python.
    """
    own = "__"
    while any(c.startswith(own) for c in df.columns):
        own += "_"
    get = lambda k: F.col(own + k)
    kept = [F.col(f"`{c}`") for c in df.columns if c != "defects"]
    out = df.select(*kept, F.coalesce(prompt, F.lit("")).alias(own + "p"), F.coalesce(output, F.lit("")).alias(own + "o"))
    for stage in _stages():  # each in a projection of its own, so that a column is worked out once however often later ones read it
        out = out.select("*", *(v.alias(own + k) for k, v in stage(get).items()))
    return out.select(*kept, F.array_compact(F.array(*(F.when(get(k), F.lit(k)) for k in ORDER))).alias("defects"))


def _exploded(runs: DataFrame, defects: Column) -> DataFrame:
    # a filter on `defects` would be moved below the projections with all of their expressions copied into it; none moves below an outer explode
    return runs.select("run_key", F.explode_outer(defects).alias("defect")).where(F.col("defect").isNotNull())


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    """Each defective run with the first defect it triggers."""
    return _exploded(with_defects(table(spark, sf, "bench_runs", "run_key", "prompt", "output")), F.slice("defects", 1, 1))


def p4_defects(spark: SparkSession, sf: str) -> DataFrame:
    """Every defect type that each run triggers."""
    return _exploded(with_defects(table(spark, sf, "bench_runs", "run_key", "prompt", "output")), F.col("defects"))


QUERIES = {"p4_found": p4_found, "p4_defects": p4_defects}
_S = "'"


def _sql_letters(c: str) -> str:
    return f"replace(lower(regexp_replace({c}, '[^\\p{{L}}\\p{{N}}\\p{{M}}]|[\\x{{FE00}}-\\x{{FE0F}}]', '', 'g')), 'ß', 'ss')"


def _sql_words(c: str) -> str:
    return f"(' ' || regexp_replace(lower({c}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g') || ' ')"


def _sql_prose(c: str) -> str:
    return f"regexp_replace(regexp_replace({c}, '(?s)```.*?(?:```|$)', ' ', 'g'), '`[^`\\n]*`', ' ', 'g')"


def _sql_scores(words: str) -> str:
    return "[" + ", ".join(f"len(list_intersect(string_split(trim({words}), ' '), [{', '.join(repr(w) for w in ws)}]))" for ws in FUNCTION_WORDS.values()) + "]"


def _sql_best(scores: str, least: int) -> str:
    return f"CASE WHEN list_max({scores}) >= {least} AND len(list_filter({scores}, lambda x: x = list_max({scores}))) = 1 THEN list_position({scores}, list_max({scores})) END"


_ASKED = "list_filter([" + ", ".join(f"CASE WHEN regexp_matches(pw, ' (?:in|into|auf|ins|en|al|au|to|vers) (?:{'|'.join(n)}) ') THEN {i} END" for i, n in enumerate(LANGUAGE_NAMES.values(), 1)) + "], lambda x: x IS NOT NULL)"
_SENTENCES = "string_split_regex(regexp_replace(regexp_replace(o, '(?s)```.*?(?:```|$)', ' ', 'g'), '([.!?。！？])\\s+', '\\1' || chr(10), 'g'), '\\n+')"
_LEFT = f"list_filter(list_transform({_SENTENCES}, lambda x: {_sql_words('x')}), lambda x: NOT regexp_matches(x, '{_REFUSAL}') AND NOT regexp_matches(x, ' (?:{EXPLAINING}) ') AND NOT contains({_sql_words('p')}, x))"
_SQL_SOLVED = f"(len(list_filter(regexp_extract_all(o, '(?s)```[^\\n`]*\\n?(.*?)(?:```|$)', 1), lambda x: regexp_matches(x, '[\\p{{L}}\\p{{N}}]'))) > 0 OR coalesce(list_sum(list_transform({_LEFT}, lambda x: len(list_filter(string_split(x, ' '), lambda w: w <> '')))), 0) >= {SOLUTION_WORDS})"
_OTHERS = f"len(list_filter(string_split(tail, chr(10)), lambda x: regexp_matches(x, '{_ITEM}') AND regexp_matches(x, '[.!?]\\s*$')))"
_PAIRS_OUT = "regexp_replace({}, '\\(\\)|\\[\\]|“”|«»', '', 'g')"
_OPEN = _PAIRS_OUT.format(_PAIRS_OUT.format(_PAIRS_OUT.format(f"regexp_replace(list_last(string_split({_sql_prose('tail')}, chr(10) || chr(10))), '{_NO_BRACKET}', '', 'g')")))
_WITH = f"""
WITH r0 AS (SELECT run_key, coalesce(prompt, '') AS p, coalesce(output, '') AS o FROM bench_runs),
r1 AS (SELECT *, {_sql_letters('p')} AS lp, {_sql_letters('o')} AS lo, {_sql_letters("regexp_replace(regexp_replace(o, '```[A-Za-z]*', ' ', 'g'), '</?[A-Za-z][^<>]*>', ' ', 'g')")} AS bare,
 trim(o, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(160) || chr(8203) || chr(65279)) AS tail, {_sql_words('o')} AS words, {_sql_words(_sql_prose('p'))} AS pw, {_sql_prose('p')} AS pp, {_sql_prose('o')} AS pr FROM r0),
r2 AS (SELECT *, strpos(lo, lp) - 1 AS label, CASE WHEN lp = '' THEN length(lo) ELSE length(replace(lo, lp, '')) END AS beside, list_last(string_split(tail, chr(10))) AS last, array_to_string(string_split(words, ' ')[1:{OPENING_WORDS}], ' ') || ' ' AS opening, len(string_split(tail, '```')) - 1 AS fences,
 {_sql_scores(_sql_words("regexp_replace(pr, '“[^”]*”|«[^»]*»|\"[^\"]*\"', ' ', 'g')"))} AS inn, {_sql_scores(_sql_words('pr'))} AS outr, {_sql_scores('pw')} AS sp, {_ASKED} AS asked, {sql_script('pp', 4)} AS script_p, {sql_script('pr', 10)} AS script_o FROM r1),
r3 AS (SELECT *, CASE WHEN list_max(inn) >= 3 THEN inn ELSE outr END AS sc, {_sql_best('sp', 1)} AS lang_p FROM r2),
r4 AS (SELECT *, {_sql_best('sc', 3)} AS lang FROM r3),
r5 AS (SELECT run_key, bare IN ({", ".join(repr(x) for x in ["", *PLACEHOLDERS])}) AS d_empty,
 lp <> '' AND label >= 0 AND beside = label AND suffix(lo, lp) AND (label <= {LABEL} OR length({_sql_letters("regexp_extract(o, '^([^\\n:.!?]*)[:\\n]', 1)")}) = label) AS d_copy,
 regexp_matches(words, '{_REFUSAL}') AND (NOT contains(o, '```') AND len(string_split(words, ' ')) <= {OTHER_WORDS} AND regexp_matches(opening, '{_REFUSAL}') OR NOT {_SQL_SOLVED}) AS d_refusal,
 fences % 2 = 1 OR (NOT (regexp_matches(tail, '{_TERMINAL.replace(_S, _S + _S)}') AND NOT (regexp_matches(tail, '{_CUT_MARK}') AND length(tail) > 3)) AND regexp_matches(tail, '\\s')
  AND NOT (regexp_matches(last, '{_ITEM}') AND {_OTHERS} = 0 AND NOT regexp_matches(last, '(?:[,(–—-]|(?i:\\s(?:{"|".join(DANGLING)})))\\s*$'))) OR regexp_matches({_OPEN}, '[(\\[“«]$') AS d_truncated,
 coalesce(NOT list_contains(asked, lang) AND lang <> lang_p AND list_max(sc) >= CASE WHEN list_max(sp) >= 2 THEN 1.5 * sc[lang_p] ELSE 4 * sc[lang_p] + 4 END, false) OR coalesce(script_p <> script_o AND NOT {sql_script_asked('pw', 'script_o')}, false) AS d_wrong FROM r4)
"""
_CASES = (("empty", "d_empty"), ("copy", "d_copy"), ("refusal", "d_refusal"), ("truncated", "d_truncated"), ("wrong_language", "d_wrong"))
SQL = {
    "p4_found": _WITH + "SELECT run_key, CASE " + " ".join(f"WHEN {c} THEN '{k}'" for k, c in _CASES) + " END AS defect FROM r5 WHERE d_empty OR d_copy OR d_refusal OR d_truncated OR d_wrong",
    "p4_defects": _WITH + " UNION ALL ".join(f"SELECT run_key, '{k}' AS defect FROM r5 WHERE {c}" for k, c in _CASES),
}
