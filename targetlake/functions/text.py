"""Text forms as column expressions: comparison form, compact form, tokens, numbers and ids."""

from __future__ import annotations

import sys
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from .vocab import STOPWORDS

NON_WORD = r"[^\p{L}\p{N}_]+"
BLANKS = r"[\s\x{1c}-\x{1f}\x{85}\p{Z}]+"
ID_LIKE = r"\b(?=[A-Za-z0-9]*[A-Za-z])(?=[A-Za-z0-9]*\d)[A-Za-z0-9]{8,}\b"


#: Common characters that fold to several: replaced by themselves, as a text that has them is looked at once more otherwise.
_COMMON = ("ß", "ﬀ", "ﬁ", "ﬂ", "ﬃ", "ﬄ")


@cache
def _folds() -> tuple[str, str]:
    """All characters that case folding turns into one other character, and what they become, by rule."""
    one = [c for c in map(chr, range(sys.maxunicode + 1)) if c.casefold() != c and len(c.casefold()) == 1]
    return "".join(one), "".join(c.casefold() for c in one)


@cache
def _expansions() -> dict[str, str]:
    """The other characters, which fold to several, and these, by rule."""
    return {c: c.casefold() for c in map(chr, range(sys.maxunicode + 1)) if len(c.casefold()) > 1 and c not in _COMMON}


#: Characters up to U+012F, besides the micro sign, fold to their lower case, and ``ß`` to two letters; this finds all others.
_BEYOND = r"[\x{B5}\x{130}-\x{10FFFF}]"
_ASCII_WORDS = "0123456789abcdefghijklmnopqrstuvwxyz_"  # spelled out: a table lookup, not ranges


@cache
def _rare() -> str:
    """A class that holds all of :func:`_expansions`: few ranges, as each takes time for every character."""
    runs: list[list[int]] = []
    for c in sorted(map(ord, _expansions())):
        if runs and c - runs[-1][1] <= 48:
            runs[-1][1] = c
        else:
            runs.append([c, c])
    return "[" + "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in runs) + "]"


def _ascii(text: Column) -> Column:
    """Whether all characters of a text are ASCII."""
    return F.octet_length(text) == F.char_length(text)


def _folded(text: Column) -> Column:
    """:func:`casefold` of any text."""
    table = F.create_map(*[F.lit(x) for pair in _expansions().items() for x in pair])
    split = F.array_join(F.transform(F.split(text, ""), lambda c: F.coalesce(F.try_element_at(table, c), c)), "")
    out = F.translate(F.when(text.rlike(_rare()), split).otherwise(text), *_folds())
    for c in _COMMON:
        out = F.replace(out, F.lit(c), F.lit(c.casefold()))
    return out


def _folded_wide(text: Column) -> Column:
    """:func:`casefold` of a text that isn't ASCII."""
    return F.when(text.rlike(_BEYOND), _folded(text)).otherwise(F.replace(F.lower(text), F.lit("ß"), F.lit("ss")))


def casefold(text: Column) -> Column:
    """Unicode case folding of every character, as far as this Python's tables know it.

    Texts of characters up to U+012F alone are put in lower case. In others, characters that fold to one other are
    translated; the few texts with a rare character that folds to several are split into characters, which are looked up.
    """
    return F.when(_ascii(text), F.lower(text)).otherwise(_folded_wide(text))


def normalize_text(text: Column) -> Column:
    """Comparison form: case-folded runs of word characters with single blanks; null gives the empty string."""
    text = F.coalesce(text, F.lit(""))
    return F.trim(F.when(_ascii(text), F.regexp_replace(F.lower(text), f"[^{_ASCII_WORDS}]+", " ")).otherwise(F.regexp_replace(_folded_wide(text), NON_WORD, " ")))


def compact_text(text: Column, limit: int = 240) -> Column:
    """Blanks collapsed, cut to ``limit`` characters, without a blank at the end."""
    return F.rtrim(F.substring(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), BLANKS, " ")), 1, limit))


def tokens(text: Column) -> Column:
    """Distinct case-folded tokens of 3 or more letters or digits in order, without stopwords and numbers."""
    found = F.regexp_extract_all(casefold(F.coalesce(text, F.lit(""))), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))
    return F.array_distinct(F.filter(found, lambda t: (F.length(t) >= 3) & ~t.isin(STOPWORDS) & ~t.rlike(r"^\p{N}+$")))


def parse_number(text: Column) -> Column:
    """First number in a text, commas as thousands marks; null if there is none."""
    return F.regexp_replace(F.regexp_extract(text, r"(-?\d+(?:[,.]\d+)*)", 1), ",", "").try_cast("double")


def parse_int(text: Column) -> Column:
    """First number in a text, cut towards zero."""
    return parse_number(text).cast("bigint")


def number_text(value: Column) -> Column:
    """A double as text with a decimal part and no exponent, as it enters fact ids."""
    whole = F.concat(value.cast("decimal(38,0)").cast("string"), F.lit(".0"))
    return F.when((F.abs(value) >= 1e7) & (value == F.floor(value)), whole).otherwise(value.cast("string"))


def stable_id(*parts: Column) -> Column:
    """16 hex digits of the SHA-1 of the comparison forms of the parts."""
    return F.substring(F.sha1(F.concat_ws("\u001f", *[normalize_text(p) for p in parts]).cast("binary")), 1, 16)


def identifier_like(text: Column) -> Column:
    """Holds 8 or more letters and digits mixed, or an address."""
    text = F.coalesce(text, F.lit(""))
    return text.rlike(ID_LIKE) | text.rlike(r"(?i)(?:https?://|www\.)")


def contains_words(normal: Column, words: Column | str) -> Column:
    """Whether a comparison form holds the words as whole words."""
    inner = F.lit(f" {words} ") if isinstance(words, str) else F.concat(F.lit(" "), words, F.lit(" "))
    return F.contains(F.concat(F.lit(" "), normal, F.lit(" ")), inner)
