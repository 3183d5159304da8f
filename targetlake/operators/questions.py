"""What an agent's question asks for, as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import normalize_text
from ..functions.vocab import ASKED_FOR, ATTRIBUTE_ALIASES, ATTRIBUTES, BROAD, COMPATIBLE, QUESTION


def _rlike(text: Column, pattern: str) -> Column:
    return text.rlike(f"(?iu){pattern}")


_APART = re.compile(r"(\w+)\\s\+\.\*\\s\+(\w+)")


def _parts(patterns: tuple[str, ...]) -> list[str]:
    blanks = r"(?:[^\S\n]|\n\s*+)"
    at_end = lambda m: rf"{m[1]}[^\S\n]*+\n\s*+(?:(?<=\s\s)|[^\n]*{blanks}){m[2]}"
    found = [_APART.sub(at_end, re.sub(r"\(\?:([^()]*)\)\?\\s\*", r"(?:(?:\1)\\s*)?", p)) for p in patterns]
    # The words are compared before it is seen whether they begin one, which takes longer.
    first = [rf"(?>[^\n]*?{a}(?<=\b{a})[^\S\n])[^\n]*{blanks}{b}\b" for p in patterns for a, b in _APART.findall(p)]
    return found + ([f"(?md:^)(?:{'|'.join(first)})"] if first else [])


def linear(patterns: tuple[str, ...]) -> str:
    r"""The patterns as one that finds the same in steps that grow with the text alone.

    In ``first\s+.*\s+last`` each ``first`` looks through the rest of its line. If any of them reaches ``last``, the line's
    first one does, unless it is another at the line's end, whose blanks go on to the next line. In ``\s+(?:..)?\s*`` blanks are
    shared out in all ways.
    """
    return "(?:" + "|".join(_parts(patterns)) + ")"


def any_asked() -> str:
    """Finds something wherever one of :data:`ASKED_FOR` does; where words begin is seen once for all of them."""
    parts = _parts(tuple(p for a in ATTRIBUTES[:-1] for p in ASKED_FOR[a]))
    words = [p.removeprefix(r"\b") for p in parts if p.startswith(r"\b")]
    return "|".join([rf"\b(?=\p{{L}})(?:{'|'.join(words)})", *(p for p in parts if not p.startswith(r"\b"))])


def text_attributes(message: Column) -> Column:
    """Attributes that the text names, in their fixed order."""
    aliases = "|".join(a for x in ATTRIBUTES[:-1] for a in ATTRIBUTE_ALIASES[x])

    def named(x: Column) -> Column:
        found = []
        for attribute in ATTRIBUTES[:-1]:
            hit = F.lit(False)
            for alias in ATTRIBUTE_ALIASES[attribute]:
                hit = hit | F.contains(x["normal"], F.lit(f" {alias} "))
            found.append(F.when(hit | _rlike(x["text"], linear(ASKED_FOR[attribute])), F.lit(attribute)))
        # Most texts name none, which two patterns tell.
        some = x["normal"].rlike(f" (?:{aliases}) ") | _rlike(x["text"], any_asked())
        return F.when(some, F.array_compact(F.array(*found))).otherwise(F.array().cast("array<string>"))

    # An item of an array is made once, however often it is looked at.
    normal = F.concat(F.lit(" "), normalize_text(message), F.lit(" "))
    return F.element_at(F.transform(F.array(F.struct(normal.alias("normal"), message.alias("text"))), named), 1)


def interpreted(message: Column, ask_attribute: Column) -> Column:
    """struct<structured, text, resolved, broad, question, conflict, confidence, reason, signature>, of the whole message."""
    text = F.coalesce(message, F.lit(""))
    raw = F.trim(F.lower(F.coalesce(ask_attribute, F.lit(""))))
    known = F.struct(text_attributes(text).alias("text"), _rlike(text, BROAD).alias("broad"), _rlike(text, QUESTION).alias("asks"), F.when(raw.isin(*ATTRIBUTES), raw).alias("structured"), ((raw != "") & ~raw.isin(*ATTRIBUTES)).alias("invalid"))

    def resolve(k: Column) -> Column:
        structured, named, broad = k["structured"], k["text"], k["broad"]
        agrees = lambda a: (a == structured) | F.struct(structured, a).isin([F.struct(F.lit(x), F.lit(y)) for x, y in COMPATIBLE])
        fits = F.forall(named, agrees)
        some = F.size(named) > 0
        none = F.array().cast("array<string>")
        case = (
            F.when(k["invalid"], "invalid_structured_attribute")
            .when(structured == "other", F.when(some, "natural_language_over_other").when(broad, "broad_question").otherwise("unsupported"))
            .when(structured.isNotNull() & some, F.when(fits, "structured_text_agree").otherwise("structured_text_conflict"))
            .when(structured.isNotNull(), "structured_only").when(some, "natural_language").when(broad, "broad_question").otherwise("unsupported")
        )
        confidence = (
            F.when(case == "natural_language_over_other", 0.88).when((case == "broad_question") & structured.isNotNull(), 0.9).when(case == "broad_question", 0.82)
            .when(case == "structured_text_agree", 0.98).when(case == "structured_only", 0.78)
            .when(case == "natural_language", F.when(F.size(named) == 1, 0.86).otherwise(0.74)).otherwise(0.0)
        )
        resolved = (
            F.when(case.isin("natural_language_over_other", "natural_language"), named)
            .when(case == "structured_text_agree", F.array_distinct(F.concat(F.array(structured), named))).when(case == "structured_only", F.array(structured)).otherwise(none)
        )
        conflict = case == "structured_text_conflict"
        signature = (
            F.when(conflict, F.concat(F.lit("conflict:"), F.array_join(F.array_sort(F.concat(F.array(structured), named)), "+")))
            .when(F.size(resolved) > 0, F.concat(F.lit("ask:"), F.array_join(F.array_sort(resolved), "+"))).when(broad, "ask:broad").otherwise("unsupported")
        )
        return F.struct(
            structured.alias("structured"), named.alias("text"), resolved.alias("resolved"), broad.alias("broad"), (structured.isNotNull() | k["asks"]).alias("question"),
            conflict.alias("conflict"), confidence.alias("confidence"), case.alias("reason"), signature.alias("signature"),
        )

    return F.element_at(F.transform(F.array(known), resolve), 1)
