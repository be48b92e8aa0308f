"""Column helpers for text, all evaluated inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unicode white space as Python's str.strip/split see it; the class forms are
# understood by both java.util.regex and RE2.
SPACE_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005"
    "\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
WS_BODY = "\\t-\\r\\x1c-\\x20\\x{85}\\p{Z}"
WS, NOT_WS = f"[{WS_BODY}]", f"[^{WS_BODY}]"
WORD_BODY = "\\p{L}\\p{N}_"
WORD, NOT_WORD = f"[{WORD_BODY}]", f"[^{WORD_BODY}]"


def as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def utrim(c: Column | str) -> Column:
    """strip() over Unicode white space, without a regex."""
    return F.btrim(as_col(c), F.lit(SPACE_CHARS))


def blank_or(first: Column | str, second: Column | str) -> Column:
    """`first or second`: an empty string counts as missing."""
    return F.coalesce(F.nullif(as_col(first), F.lit("")), as_col(second))


def word_count(c: Column | str) -> Column:
    """len(text.split())"""
    return F.regexp_count(as_col(c), F.lit(f"{NOT_WS}+"))


def collapse(c: Column | str) -> Column:
    """Runs of white space become one space; ends are cut."""
    # most runs are one space already
    return utrim(F.regexp_replace(as_col(c), f" {WS}+|(?! ){WS}+", " "))


def pattern_count(c: Column | str, pattern: str) -> Column:
    return F.regexp_count(as_col(c), F.lit(pattern))


def where_has(c: Column, needle: str, then: Column, otherwise: Column) -> Column:
    """`then` for texts that hold the needle at all: a byte search is far cheaper
    than the regex it keeps away from most texts."""
    return F.when(c.contains(needle), then).otherwise(otherwise)


def contains_any(c: Column, phrases: list[str]) -> Column:
    out = F.lit(False)
    for phrase in phrases:
        out = out | c.contains(phrase)
    return out


def fuzzy_hash(c: Column | str) -> Column:
    """md5 of the lower-cased text without punctuation, white space collapsed."""
    bare = F.regexp_replace(F.lower(as_col(c)), f"[^{WORD_BODY}{WS_BODY}]", "")
    return F.md5(collapse(bare).cast("binary"))


def exact_hash(c: Column | str) -> Column:
    """md5 of the stripped, lower-cased text."""
    return F.md5(F.lower(utrim(c)).cast("binary"))


def tokens(c: Column | str, extra: str = "") -> Column:
    """Word tokens of a text as an array."""
    return F.regexp_extract_all(as_col(c), F.lit(f"[{WORD_BODY}{extra}]+"), F.lit(0))


def half_even(c: Column, digits: int = 0) -> Column:
    return F.bround(c, digits)
