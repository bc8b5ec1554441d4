"""Text column helpers with Python's Unicode rules, all evaluated in the JVM."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# The code points str.isspace() accepts, and the four letters a case-insensitive
# match equates with i, i, s and k.
WHITESPACE = "".join(
    map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])
)
FOLDED_LETTERS = "\u0130\u0131\u017f\u212a"

_ESCAPES = re.compile(r"\\.|[\[\]]")


def java_regex(pattern: str, ignore_case: bool = True) -> str:
    """Spell a Python ``re`` pattern for Java: same case folding, classes and line terminators."""
    inside = False

    def spell(found: re.Match) -> str:
        nonlocal inside
        piece = found.group()
        if piece in "[]":
            inside = piece == "["
        elif piece == r"\s":
            return r"\s\x1c-\x1f" if inside else r"[\s\x1c-\x1f]"
        elif piece == r"\S" and not inside:
            return r"[^\s\x1c-\x1f]"
        elif piece == r"\w":
            return r"\p{L}\p{N}_" if inside else r"[\p{L}\p{N}_]"
        return piece

    return ("(?idU)" if ignore_case else "(?dU)") + _ESCAPES.sub(spell, pattern)


def matches(col: Column, pattern: str, ignore_case: bool = True) -> Column:
    return col.rlike(java_regex(pattern, ignore_case))


def strip(col: Column) -> Column:
    """``str.strip()``: both ends, every Unicode white space."""
    return F.btrim(col, F.lit(WHITESPACE))


def is_blank(col: Column) -> Column:
    return col.isNull() | (strip(col) == "")


def fold_case(col: Column) -> Column:
    """Lower case, plus the four letters a case-insensitive match also equates with ASCII ones."""
    ascii_only = F.octet_length(col) == F.length(col)
    return F.when(ascii_only, F.lower(col)).otherwise(F.lower(F.translate(col, FOLDED_LETTERS, "iisk")))


def sanitize(col: Column, max_length: int = 1000) -> Column:
    """Drop NUL characters, strip, and cut over-long text."""
    cleaned = strip(F.replace(F.coalesce(col, F.lit("")), F.lit("\0"), F.lit("")))
    return F.when(F.length(cleaned) > max_length, F.concat(F.left(cleaned, F.lit(max_length)), F.lit(" [TRUNCATED]"))).otherwise(cleaned)


def tokens(col: Column, limit: int | None = None) -> Column:
    """Lower-case word tokens of the whole text, or the first ``limit`` of them."""
    words = F.filter(F.split(F.lower(col), "[^\\p{L}\\p{N}]+"), lambda t: t != "")
    return words if limit is None else F.slice(words, 1, limit)
