"""Text normalisation, sentence segmentation and tokenisation as column expressions.

Every rule is one regular-expression step of a projection, so a chain of rules stays inside a
code-generated scan stage; nothing here shuffles or calls Python per row.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Ligatures, header length, illegal characters, reserved words.
SPACE, SPACE_IN_LINE = r"(?U)\s+", r"(?U)[^\S\n]+"
LIGATURES = {
    "Ĳ": "IJ", "ĳ": "ij", "Ǆ": "DŽ", "ǅ": "Dž", "ǆ": "dž", "Ǉ": "LJ", "ǈ": "Lj", "ǉ": "lj",
    "Ǌ": "NJ", "ǋ": "Nj", "ǌ": "nj", "Ǳ": "DZ", "ǲ": "Dz", "ǳ": "dz", "‥": "..", "…": "...",
    "⁇": "??", "⁈": "?!", "⁉": "!?", "ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl",
    "ﬅ": "st", "ﬆ": "st",
}
HEADER = 25
NOT_XML = r"[^\x01-\x{D7FF}\x{E000}-\x{FFFD}\x{10000}-\x{10FFFF}]"
RESTRICTED_XML = r"[\x01-\x08\x0B-\x0C\x0E-\x1F\x7F-\x84\x86-\x9F]"
CONTROL = r"[\x00-\x1f\x7f]"
RESERVED = r"<(?:s|unk|/s|\s*and\s*|)>|\[\s*and\s*\]"

# Marks that open a sentence or close one, and abbreviations that end in a period
# without ending a sentence.  The second set does so only before a number.
OPENING = r"""['"(\[¿¡\p{Pi}\x{201E}]"""
CLOSING = r"""['")\]\p{Pf}]"""
ABBREVIATIONS = {
    "en": ("A B C D E F G H I J K L M N O P Q R S T U V W X Y Z "
           "Adj Adm Adv Asst Bart Bldg Brig Bros Capt Cmdr Col Comdr Con Corp Cpl DR Dr Drs Ens Gen Gov "
           "Hon Hr Hosp Insp Lt MM MR MRS MS Maj Messrs Mlle Mme Mr Mrs Ms Msgr Op Ord Pfc Ph Prof Pvt "
           "Rep Reps Res Rev Rt Sen Sens Sfc Sgt Sr St Supt Surg v vs i.e rev e.g Nos Nr "
           "Jan Feb Mar Apr Jun Jul Aug Sep Oct Nov Dec").split(),
    "de": ("A B C D E F G H I J K L M N O P Q R S T U V W X Y Z Abs Art Bd Dr Hr Fr Nr Prof St Str "
           "bzw ca d.h etc evtl ggf inkl max min u.a usw vgl z.B").split(),
    "fr": ("A B C D E F G H I J K L M N O P Q R S T U V W X Y Z Dr M MM Mgr Mlle Mme Mmes Pr St Ste "
           "av cf etc ex fig p pp vol").split(),
    "es": ("A B C D E F G H I J K L M N O P Q R S T U V W X Y Z Dr Dra Sr Sra Srta Ud Uds Vd Vds "
           "art cap etc fig núm p pág tel vol").split(),
}
ABBREVIATIONS_BEFORE_NUMBER = {"en": ["No", "Art", "pp"], "de": [], "fr": ["no"], "es": ["no"]}

Normalizer = Callable[[Column], Column]


# -- normalisers ----------------------------------------------------------------------------

def whitespace(c: Column) -> Column:
    """Runs of Unicode white space become one blank; none at either end."""
    return F.trim(F.regexp_replace(c, SPACE, " "))


def ligatures(c: Column) -> Column:
    """Typographic ligatures become separate letters; texts without any are passed through."""
    spelled = reduce(lambda acc, kv: F.replace(acc, F.lit(kv[0]), F.lit(kv[1])), LIGATURES.items(), c)
    return F.when(c.rlike("[Ĳ-ĳǄ-ǌǱ-ǳ‥-…⁇-⁉ﬀ-ﬆ]"), spelled).otherwise(c)


def dos(c: Column) -> Column:
    """Carriage returns, line feeds and form feeds are removed."""
    return F.translate(c, "\r\n\f", "")


def moses(c: Column) -> Column:
    """Without control characters and reserved words; vertical bars become underscores."""
    return F.translate(F.regexp_replace(F.regexp_replace(c, CONTROL, ""), RESERVED, ""), "|", "_")


def header(c: Column) -> Column:
    """A short line is followed by an empty one."""
    return F.regexp_replace(c, rf"^(\S[^\n]{{0,{HEADER}}})(\n?)\z", "$1\n$2")


_NORMALIZERS: dict[str, Normalizer] = {
    "whitespace": whitespace, "ligatures": ligatures, "dos": dos, "moses": moses, "header": header,
    "none": lambda c: c,
}
IMPORT_CHAIN, WRITE_CHAIN = "whitespace,header,ligatures", "moses,whitespace"


def register_normalizer(name: str, fn: Normalizer) -> None:
    _NORMALIZERS[name] = fn


def normalize(c: Column, types: str = IMPORT_CHAIN) -> Column:
    """Apply named normalisers in order; unknown names are ignored."""
    steps = [_NORMALIZERS[t.strip()] for t in types.split(",") if t.strip() in _NORMALIZERS]
    return reduce(lambda acc, fn: fn(acc), steps, c)


def clean_xml(c: Column) -> Column:
    """Without characters XML does not allow."""
    return F.regexp_replace(F.regexp_replace(c, NOT_XML, ""), RESTRICTED_XML, "")


def escape_xml(c: Column) -> Column:
    """XML text: markup characters as entities."""
    for sign, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(sign), F.lit(entity))
    return c


# -- sentences ------------------------------------------------------------------------------

def register_abbreviations(lang: str, always: list[str], before_number: list[str] = ()) -> None:
    """Set the abbreviation list of a language, for instance one read from a file."""
    ABBREVIATIONS[lang] = list(always)
    ABBREVIATIONS_BEFORE_NUMBER[lang] = list(before_number)


def _words(words: list[str]) -> str:
    quoted = sorted((w.replace(".", r"\.") for w in words), key=len, reverse=True)
    return "(?:" + "|".join(quoted) + ")" if quoted else r"(?!)"


# stands for a blank while sentences are cut; no character of any text
HELD = "\uffff"


def _period_rule(lang: str) -> str:
    """A blank after a period that ends a sentence: not an abbreviation, and before a capital or a number."""
    run = r"(?<![\p{L}\p{Nd}.\-])"
    always = _words(ABBREVIATIONS[lang])
    number = _words(ABBREVIATIONS_BEFORE_NUMBER[lang])
    return (rf"(?<=\.)(?<!{run}{always}\.) "
            rf"(?:(?=[0-9])(?<!{run}{number}\. )|(?={OPENING}+[0-9])|(?={OPENING}*\p{{Lu}}))")


def _tidy(c: Column) -> Column:
    c = F.regexp_replace(F.regexp_replace(c, "  +", " "), " ?\n ?", "\n")
    return F.trim(c)


def _by_language(lang: Column, fn: Callable[[str], Column]) -> Column:
    """One expression per language with its own lists, English for all others."""
    out = None
    for code in sorted(ABBREVIATIONS):
        if code != "en":
            out = F.when(lang == code, fn(code)) if out is None else out.when(lang == code, fn(code))
    return fn("en") if out is None else out.otherwise(fn("en"))


# A sentence is over at blanks between an ending mark and a capital.  Closing marks after the ending mark make it sure, whatever opens the next
# sentence; so does a mark that can only end a sentence, or more than one period; a single period needs an opening mark before the capital.
CAPITAL = r"\p{Lu}"
BOUNDARY = "|".join([
    rf"([?!.] *{CLOSING}+) +(?={OPENING}* *{CAPITAL})",
    rf"([?!]|\.\.) +(?={OPENING}*{CAPITAL})",
    rf"([?!.]) +(?={OPENING}+ *{CAPITAL})"])


def _rules_splitter(text: Column, lang: Column) -> Column:
    c = _tidy(F.regexp_replace(text, r"(?U)^\s+", ""))
    c = F.regexp_replace(c, BOUNDARY, "$1$2$3\n")
    # the blank after an acronym of any length ends nothing
    c = F.regexp_replace(c, r"(\.[\p{Lu}\-]+\.+) ", f"$1{HELD}")
    c = _by_language(lang, lambda code: F.regexp_replace(c, _period_rule(code), "\n"))
    return F.filter(F.split(_tidy(F.replace(c, F.lit(HELD), F.lit(" "))), "\n"), lambda s: s != "")


_SPLITTERS: dict[str, Callable[[Column, Column], Column]] = {
    "rules": _rules_splitter,
    "lines": lambda text, lang: F.filter(F.split(text, "\n"), lambda s: F.trim(s) != ""),
    "none": lambda text, lang: F.array(text),
}


def register_splitter(name: str, fn: Callable[[Column, Column], Column]) -> None:
    """Add a splitter: (text, language) → array of sentences."""
    _SPLITTERS[name] = fn


def split_sentences(text: Column, lang: Column, method: str = "rules") -> Column:
    """The sentences of a text as an array."""
    return _SPLITTERS[method](text, lang)


def paragraphs(text: Column) -> Column:
    """Paragraphs of a plain text with the import normalisation applied line by line.

    Blank lines separate paragraphs, lines of a paragraph are joined by blanks, and a short line
    keeps its line end, so that it becomes a sentence of its own.
    """
    c = F.regexp_replace(text, SPACE_IN_LINE, " ")
    c = F.regexp_replace(c, " ?\n ?", "\n")
    c = F.regexp_replace(c, "\n\n+", "\x1e")
    c = F.regexp_replace(c, rf"(^|[\n\x1e])(\S[^\n\x1e]{{0,{HEADER}}})(?=[\n\x1e]|\z)", "$1$2\x1f")
    c = F.regexp_replace(F.replace(c, F.lit("\n"), F.lit(" ")), "\x1f ?", "\n")
    return F.filter(F.transform(F.split(ligatures(c), "\x1e"), lambda p: F.trim(p)), lambda p: ~p.rlike(r"^\s*\z"))


def read_text(docs: DataFrame, text: str = "text", lang: str = "lang", method: str = "rules") -> DataFrame:
    """Plain texts as numbered sentences: one row per sentence with paragraph and position.

    Numbering comes from array positions within the document's own row, so no shuffle is needed.
    """
    keys = [c for c in docs.columns if c != text]
    nested = F.transform(
        paragraphs(F.col(text)),
        lambda p, i: F.transform(split_sentences(p, F.col(lang), method),
                                 lambda s: F.struct((i + 1).alias("para_id"), s.alias("text"))))
    return docs.select(*keys, F.posexplode(F.flatten(nested)).alias("_n", "_s")).select(
        *keys, F.col("_s.para_id").alias("para_id"), (F.col("_n") + 1).alias("sent_pos"),
        F.col("_s.text").alias("sentence"))


# -- tokens ---------------------------------------------------------------------------------

LETTER, ALNUM, NUMBER = r"[\p{L}\p{M}]", r"[\p{L}\p{M}\p{Nd}]", r"\p{N}"
LEFT_ELISION = ("fr", "it")


def _apostrophes(c: Column, lang: Column) -> Column:
    apart = F.replace(c, F.lit("'"), F.lit(" ' "))
    right = F.regexp_replace(c, rf"'(?:(?<={LETTER}')(?={LETTER})|(?<={NUMBER}')(?=s))", " \x02")
    right = F.regexp_replace(right, rf"'(?:(?<!{NUMBER}')|(?!{LETTER}))", " ' ")
    left = F.regexp_replace(c, rf"'(?<={LETTER}')(?={LETTER})", "\x02 ")
    left = F.replace(left, F.lit("'"), F.lit(" ' "))
    split = F.translate(F.when(lang == "en", right).when(lang.isin(*LEFT_ELISION), left).otherwise(apart),
                        "\x02", "'")
    return F.when(F.contains(c, F.lit("'")), split).otherwise(c)


def _final_periods(c: Column, lang: Column) -> Column:
    """Split the period off words that are no abbreviation and stand before no small letter."""
    def rule(code: str) -> str:
        return (rf"(?<= )(?=[^\s.]*+\.)(?!{_words(ABBREVIATIONS[code])}\. )"
                rf"(?!{_words(ABBREVIATIONS_BEFORE_NUMBER[code])}\. [0-9])"
                rf"(?!(?=\S*{LETTER})\S*\.\S*\. )(\S*[^\s.])\.(?= (?!\p{{Ll}}))")
    return _by_language(lang, lambda code: F.regexp_replace(c, rule(code), "$1 ."))


def _rules_tokenizer(text: Column, lang: Column) -> Column:
    c = F.concat(F.lit(" "), text, F.lit(" "))
    c = F.regexp_replace(c, rf"([^\p{{L}}\p{{M}}\p{{Nd}}\s.'`,\-])", " $1 ")
    c = F.regexp_replace(c, r"(\.\.+)", " $1 ")
    c = F.regexp_replace(c, rf",(?:(?<!{NUMBER},)|(?!{NUMBER}))", " , ")
    c = F.replace(F.translate(c, "`", "'"), F.lit("''"), F.lit(' " '))
    c = F.regexp_replace(_apostrophes(c, lang), r"\s{2,}|[\s&&[^ ]]", " ")
    return F.split(F.trim(_final_periods(c, lang)), " ")


def _unicode_tokenizer(text: Column, lang: Column) -> Column:
    """Break after every run of one punctuation mark, and before marks that end a word."""
    c = F.regexp_replace(text, r"(?<=\P{P})(?=\p{P}(?:[\p{P}\s]|\z))", " ")
    c = F.regexp_replace(c, r"(``)(?=\S)", "$1 ")
    c = F.regexp_replace(c, r"(\p{P})(?!\1)", "$1 ")
    return F.filter(F.split(c, r"\s+"), lambda t: t != "")


_TOKENIZERS: dict[str, Callable[[Column, Column], Column]] = {
    "rules": _rules_tokenizer,
    "unicode": _unicode_tokenizer,
    "whitespace": lambda text, lang: F.filter(F.split(text, r"\s+"), lambda t: t != ""),
    "none": lambda text, lang: F.array(text),
}


def register_tokenizer(name: str, fn: Callable[[Column, Column], Column]) -> None:
    """Add a tokenizer: (text, language) → array of tokens."""
    _TOKENIZERS[name] = fn


def tokens(text: Column, lang: Column, method: str = "rules") -> Column:
    """The tokens of a sentence as an array."""
    return _TOKENIZERS[method](text, lang)


def map_tokens(c: Column, kind: str, fn: Callable[[Column], Column]) -> Column:
    """Apply a text function to a nested value: ``string``, ``array`` of strings or ``map`` values."""
    if kind == "array":
        return F.transform(c, lambda x: fn(x))
    if kind == "map":
        return F.transform_values(c, lambda _, v: fn(v))
    return fn(c)


def enclosed(toks: Column, prefix: str = "", suffix: str = "") -> Column:
    """Tokens joined with a prefix and suffix around each."""
    return F.array_join(F.transform(toks, lambda t: F.concat(F.lit(prefix), t, F.lit(suffix))), "")


# Marks that attach to the next word, and marks that attach to the word before.
ATTACH_RIGHT, ATTACH_LEFT = r"[\p{Sc}(\[{¿¡]+", r"[,.?!:;\\%}\])]+"


# a boundary between tokens: a blank that stays, or one that has been taken out already
_GONE = "\x01"
_GAP = r"[ \x01]"


def _pair_quotes(c: Column, quote: str, possessive: bool = False) -> Column:
    """Take out the blank behind an opening quote and before the closing one that follows it.

    A match runs from an opening quote through its partner, so the next match starts outside
    quotes again; a quote without a partner opens.  With ``possessive``, a quote outside quotes
    that follows an ``s`` goes with that word.
    """
    pair = rf"(?s)(?<={_GAP}){quote}(?:(?:{_GAP}(.*?))??{_GAP}({quote})(?={_GAP})|{_GAP}(?=\S))"
    if possessive:
        pair = rf"(?s)(?<=s){_GAP}{quote}(?={_GAP})|" + pair[4:]
    return F.regexp_replace(c, pair, f"{quote}{_GONE}$1{_GONE}$2")


def detokenize(toks: Column, lang: Column) -> Column:
    """A sentence from its tokens: blanks are left out around marks, contractions and quotes."""
    c = F.concat(F.lit(" "), F.regexp_replace(F.array_join(toks, " "), r"\s+", " "), F.lit(" "))
    c = F.regexp_replace(c, rf"(?<={_GAP})({ATTACH_RIGHT}) (?=\S)", f"$1{_GONE}")
    c = F.regexp_replace(c, rf"(?<=\S) (?={ATTACH_LEFT}{_GAP})", _GONE)
    c = F.when(lang == "en", F.regexp_replace(c, rf"(?<={ALNUM}) (?='{LETTER})", _GONE)).when(
        lang == "fr", F.regexp_replace(c, rf"(?<={LETTER}') (?={LETTER})", _GONE)).otherwise(c)
    for quote in ('"', "''", '""'):
        c = _pair_quotes(c, quote)
    c = F.when(lang == "en", _pair_quotes(c, "'", possessive=True)).otherwise(_pair_quotes(c, "'"))
    return F.trim(F.translate(c, _GONE, ""))


# -- subtitles ------------------------------------------------------------------------------

def seconds(stamp: Column) -> Column:
    """``HH:MM:SS,mmm`` in seconds."""
    part = [F.regexp_extract(stamp, r"^(-?\d+)\D(-?\d+)\D(-?\d+)\D(-?\d+)$", i).cast("double") for i in (1, 2, 3, 4)]
    return part[0] * 3600 + part[1] * 60 + part[2] + part[3] / 1000


def clean_cue(c: Column) -> Column:
    """Subtitle text without format codes and tags, and with plain double quotes."""
    c = F.regexp_replace(c, r"(?s)\{.*?\}#?", "")
    c = F.regexp_replace(F.replace(c, F.lit("''"), F.lit('"')), '""+', '"')
    return F.regexp_replace(c, r"<[^>]+>", "")
