"""Tokens as column expressions.

A chunk is a run of letters and visible ASCII characters. Standard tokens are a
chunk's parts between ASCII punctuation. With patterns, a chunk is searched for the
first pattern in order that it has anywhere: what stands before the match gives
standard tokens, the match is one token, and what follows is searched anew."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

CHUNK = r"[\p{L}!-~]+"
WORD = r"[\p{L}0-9]+"
WORD_OR_MARK = r"[\p{L}0-9]+|[!-/:-@\[-`{-~]"

#: The default patterns, in order of precedence.
PATTERNS = (
    r"https?://[^\s$<>]+",
    r"\d+/\d+",
    r"[a-zA-Z0-9\_\.]+@[a-zA-Z0-9\_\.]+",
    r"[a-zA-Z0-9\_]+\.(ppt|doc|xlsx)",
    r"([0-9]+[,\-:.])+[0-9]+",
    r"[\w]+([\-][\w]+)+",
    r"[a-zA-Z]\.[a-zA-Z]\.",
    r"(\$|€|£|\+)[0-9]+([.,][0-9]+)*",
    r"^([a-zA-Z]+)?\'[a-zA-Z]*$",
)

#: What every match of the default patterns has in it; text without it needs no search.
HINT = r"[0-9@:'-]|\.[!-~\p{L}]"

#: Letters of U+00C0 to U+017E that have no base letter in Unicode.
_LETTERS = {"Æ": "E", "×": "*", "Ø": "O", "Ð": "D", "Þ": "T", "ß": "S", "æ": "e", "÷": "/", "ø": "o", "ð": "d", "þ": "t", "Đ": "D", "đ": "d", "Ħ": "H", "ħ": "h", "ı": "i", "Ĳ": "I", "ĳ": "i", "ĸ": "k", "Ŀ": "L", "ŀ": "l", "Ł": "L", "ł": "l", "ŉ": "n", "Ŋ": "N", "ŋ": "n", "Œ": "O", "œ": "o", "Ŧ": "T", "ŧ": "t"}


def diacritics() -> tuple[str, str]:
    """Characters with diacritics (U+00C0 to U+017E) and what they become."""
    marked = [chr(c) for c in range(0xC0, 0x17F)]
    return "".join(marked), "".join(_LETTERS.get(c) or unicodedata.normalize("NFD", c)[0] for c in marked)


def strip_diacritics(text: Column) -> Column:
    return F.translate(text, *diacritics())


def prepared(text: Column, case_folding: bool = True, remove_diacritics: bool = False) -> Column:
    t = F.coalesce(text, F.lit(""))
    t = strip_diacritics(t) if remove_diacritics else t
    return F.lower(t) if case_folding else t


def standard_tokens(text: Column, *, case_folding: bool = True, remove_diacritics: bool = False, remove_punctuation: bool = True) -> Column:
    """array<string> of a text's tokens without patterns."""
    return F.regexp_extract_all(prepared(text, case_folding, remove_diacritics), F.lit(WORD if remove_punctuation else WORD_OR_MARK), F.lit(0))


def chunks(text: Column, *, case_folding: bool = True, remove_diacritics: bool = False) -> Column:
    return F.regexp_extract_all(prepared(text, case_folding, remove_diacritics), F.lit(CHUNK), F.lit(0))


def has_pattern(chunk: Column, patterns: tuple[str, ...] = PATTERNS) -> Column:
    out = F.lit(False)
    for p in patterns:
        out = out | chunk.rlike(p)
    return may_match(chunk, patterns) & out


def may_match(column: Column, patterns: tuple[str, ...] = PATTERNS) -> Column:
    """A cheap condition that every chunk or text with a match meets."""
    return column.rlike(HINT) if patterns == PATTERNS else F.lit(True)


def chunk_tokens(chunk: Column, patterns: tuple[str, ...] = PATTERNS, *, remove_punctuation: bool = True) -> Column:
    """array<string> of one chunk's tokens. Interpreted: use it on distinct chunks."""
    plain = lambda c: F.regexp_extract_all(c, F.lit(WORD if remove_punctuation else WORD_OR_MARK), F.lit(0))

    def step(state, _):
        rest = state["rest"]
        match = F.coalesce(*(F.when(rest.rlike(p), F.regexp_extract(rest, p, 0)) for p in patterns), F.lit(""))
        at = F.when(match == "", F.length(rest) + 1).otherwise(F.instr(rest, match))
        before = plain(F.substring(rest, F.lit(1), at - 1))
        return F.struct(
            F.substring(rest, at + F.length(match), F.length(rest)).alias("rest"),
            F.when(rest == "", state["out"]).when(match == "", F.concat(state["out"], before)).otherwise(F.concat(state["out"], before, F.array(match))).alias("out"),
        )

    start = F.struct(chunk.alias("rest"), F.array().cast("array<string>").alias("out"))
    # every step takes a character or more, and two steps of a chunk's text take at least one separator between
    return F.aggregate(F.sequence(F.lit(1), F.greatest(F.length(chunk), F.lit(1))), start, step, lambda s: s["out"])
