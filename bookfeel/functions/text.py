"""Column expressions over text. All stay inside the JVM."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space as the source data counts it: Unicode spaces plus the four
# ASCII separators. ``(?U)`` makes ``\s`` Unicode-aware.
_SPACE = r"\s\x1c-\x1f"
SPACE_RUN = rf"(?U)[{_SPACE}]+"

# Digits of any script, superscripts, and ASCII punctuation.
DIGITS_AND_PUNCTUATION = r"[\p{Nd}²³¹⁰-⁹₀-₉!-/:-@\[-`{-~]+"
NO_LETTERS = r"[^\p{L}]+"

# English stop words (the 179-word list of the usual toolkit).
STOP_WORDS = """
i me my myself we our ours ourselves you you're you've you'll you'd your yours yourself
yourselves he him his himself she she's her hers herself it it's its itself they them their
theirs themselves what which who whom this that that'll these those am is are was were be been
being have has had having do does did doing a an the and but if or because as until while of at
by for with about against between into through during before after above below to from up down
in out on off over under again further then once here there when where why how all any both each
few more most other some such no nor not only own same so than too very s t can will just don
don't should should've now d ll m o re ve y ain aren aren't couldn couldn't didn didn't doesn
doesn't hadn hadn't hasn hasn't haven haven't isn isn't ma mightn mightn't mustn mustn't needn
needn't shan shan't shouldn shouldn't wasn wasn't weren weren't won won't wouldn wouldn't
""".split()

# Contractions a word tokenizer splits in two, at the bar:
# can|not gim|me gon|na got|ta lem|me wan|na
SPLIT_WORDS = (
    r"(?<!\S)(can(?=not)|gim(?=me)|gon(?=na)|got(?=ta)|lem(?=me)|wan(?=na))"
    r"(not|me|na|ta)(?!\S)"
)

# Irregular English forms; a caller with a full dictionary passes its own.
VERB_LEMMAS = {
    "am": "be", "is": "be", "are": "be", "was": "be", "were": "be", "been": "be",
    "has": "have", "had": "have", "does": "do", "did": "do", "done": "do", "went": "go",
    "gone": "go", "said": "say", "made": "make", "took": "take", "taken": "take", "came": "come",
    "saw": "see", "seen": "see", "knew": "know", "known": "know", "got": "get", "gave": "give",
    "given": "give", "found": "find", "thought": "think", "told": "tell", "felt": "feel",
    "left": "leave", "kept": "keep", "began": "begin", "begun": "begin", "wrote": "write",
    "written": "write", "ran": "run", "brought": "bring", "held": "hold", "met": "meet",
    "spoke": "speak", "spoken": "speak", "lost": "lose", "bought": "buy", "fell": "fall",
    "loved": "love", "reads": "read", "reading": "read", "loves": "love",
}
NOUN_LEMMAS = {
    "children": "child", "men": "man", "women": "woman", "feet": "foot", "teeth": "tooth",
    "mice": "mouse", "geese": "goose", "lives": "life", "wives": "wife", "books": "book",
    "stories": "story", "characters": "character", "reviews": "review", "pages": "page",
    "authors": "author", "novels": "novel", "chapters": "chapter",
}


def has_text(c: Column) -> Column:
    """True when the text holds at least one character that is not white space."""
    return c.rlike(rf"(?U)[^{_SPACE}]")


def strip(c: Column) -> Column:
    """Text without white space at its ends; line breaks count as such."""
    return F.regexp_replace(c, rf"(?U)^[{_SPACE}]+|[{_SPACE}]+$", "")


def word_count(c: Column) -> Column:
    """Number of white-space separated words."""
    return F.size(F.filter(F.split(c, SPACE_RUN), lambda w: w != "")).cast("long")


def longer_than(c: Column, words: int) -> Column:
    """``word_count(c) > words``, reading only as far as the deciding word.

    The possessive quantifiers never back-track, so a 20,000-word text costs no
    more than its first ``words + 1`` words and no array is built.
    """
    one = rf"[^{_SPACE}]"
    gap = rf"[{_SPACE}]"
    return c.rlike(rf"(?U)^{gap}*+(?:{one}++{gap}++){{{words}}}{one}")


def truncate(c: Column, length: int) -> Column:
    """The first ``length`` characters."""
    return F.substring(c, 1, length)


def char_length(c: Column) -> Column:
    """Length in characters; a missing text counts 0."""
    return F.length(F.coalesce(c, F.lit(""))).cast("long")


@lru_cache(maxsize=1)
def accent_table() -> tuple[str, str]:
    """Accented characters and their base letters, derived from Unicode data."""
    accented, plain = [], []
    for code in range(0xC0, 0x2000):
        char = chr(code)
        base = "".join(
            p for p in unicodedata.normalize("NFD", char) if unicodedata.category(p) != "Mn"
        )
        if len(base) == 1 and base != char:
            accented.append(char)
            plain.append(base)
    return "".join(accented), "".join(plain)


def strip_accents(c: Column) -> Column:
    """Replace accented letters by their base letter and drop loose marks."""
    accented, plain = accent_table()
    bare = F.regexp_replace(F.translate(c, accented, plain), r"\p{Mn}+", "")
    return F.when(c.rlike(r"[^\x00-\x7F]"), bare).otherwise(c)


def tokens(c: Column, pattern: str = NO_LETTERS) -> Column:
    """Lower-case words; everything matching ``pattern`` separates."""
    return F.filter(F.split(F.lower(c), pattern), lambda w: w != "")


def _lookup(words: Column, table: dict[str, str]) -> Column:
    """Replace every word found in ``table``: one branch on membership, so the
    usual word (absent) costs a hash probe and no map scan."""
    if not table:
        return words
    flat = [F.lit(part) for pair in table.items() for part in pair]
    pairs = F.create_map(*flat)
    known = list(table)
    return F.transform(words, lambda w: F.when(w.isin(known), pairs[w]).otherwise(w))


def normalize_words(
    c: Column,
    accents: bool = False,
    stop_words: list[str] | None = None,
    verbs: dict[str, str] | None = None,
    nouns: dict[str, str] | None = None,
) -> Column:
    """Cleaned word array: lower case, no digits, no ASCII punctuation, words
    mapped to their verb form and then to their noun form."""
    text = F.lower(F.trim(c))
    if accents:
        text = strip_accents(text)
    text = F.regexp_replace(text, DIGITS_AND_PUNCTUATION, "")
    text = F.regexp_replace(text, SPLIT_WORDS, "$1 $2")
    words = F.filter(F.split(text, SPACE_RUN), lambda w: w != "")
    if stop_words:
        words = F.filter(words, lambda w: ~w.isin(stop_words))
    words = _lookup(words, VERB_LEMMAS if verbs is None else verbs)
    return _lookup(words, NOUN_LEMMAS if nouns is None else nouns)


def normalize_text(c: Column, **options) -> Column:
    """Text normalisation, first form."""
    return F.array_join(normalize_words(c, **options), " ")


def normalize_text_full(c: Column, **options) -> Column:
    """Second form: accents stripped and English stop words removed as well."""
    return normalize_text(c, accents=True, stop_words=STOP_WORDS, **options)


def joined_categories(columns: list[Column], sep: str = " ") -> Column:
    """Categories as one text; a missing one reads ``nan``."""
    return F.concat_ws(sep, *[F.coalesce(c.cast("string"), F.lit("nan")) for c in columns])


def json_block(c: Column) -> Column:
    """The JSON text inside a model reply: the whole reply without its code
    fence when that parses, else its outermost braces, else null."""
    text = F.regexp_replace(strip(c), r"^```(json)?", "")
    text = strip(F.regexp_replace(text, r"```$", ""))

    def usable(whole: Column) -> Column:
        inner = F.regexp_extract(whole, r"(?s)\{.*\}", 0)
        return F.when(F.try_parse_json(whole).isNotNull(), whole).when(F.try_parse_json(inner).isNotNull(), inner)

    return F.get(F.transform(F.array(text), usable), 0)  # the text is cleaned once


def parse_literal(c: Column, schema) -> Column:
    """Nested value from its text form, single or double quotes."""
    return F.from_json(c, schema, {"allowSingleQuotes": "true"})
