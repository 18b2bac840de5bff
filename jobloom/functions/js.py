"""Building blocks whose results match those of a JavaScript runtime: white space, word boundaries, rounding."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as JavaScript defines it; \s of Java lacks the last ones.
SPACE = r"[\s\x0B\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF]"


def java(pattern: str) -> str:
    """A pattern with ASCII word boundaries, whatever the JVM takes \\b for.

    A boundary that opens a pattern, group or alternative stands before a word, any other one behind a word: one
    look-around each, where the general form would need four.
    """
    out, i = [], 0
    while i < len(pattern):
        if pattern.startswith(r"\b", i):
            before = "".join(out)
            opens = not before or before.endswith(("|", "(", "(?:", "^")) and not before.endswith((r"\|", r"\("))
            out.append("(?<![A-Za-z0-9_])" if opens else "(?![A-Za-z0-9_])")
            i += 2
        elif pattern[i] == "\\":
            out.append(pattern[i : i + 2])
            i += 2
        else:
            out.append(pattern[i])
            i += 1
    return "".join(out)


def matches(col: Column, pattern: str, flags: str = "i") -> Column:
    """Whether a pattern occurs. Null stays null. A pattern in lower case is sought in the lowered text, which is faster."""
    if flags == "i" and not re.search("[A-Z]", re.sub(r"\\[A-Za-z]", "", pattern)):
        col, flags = F.lower(col), ""
    return F.rlike(col, F.lit((f"(?{flags})" if flags else "") + java(pattern)))


def any_match(col: Column, patterns: Iterable[str], flags: str = "i") -> Column:
    return matches(col, "|".join(f"(?:{p})" for p in patterns), flags)


def contains_any(col: Column, words: Iterable[str]) -> Column:
    """Whether one of some strings occurs, taken literally."""
    return F.rlike(col, F.lit("|".join(re.escape(w) for w in words)))


def hits(col: Column, words: Iterable[str]) -> Column:
    """How many of some strings occur, taken literally."""
    total = F.lit(0)
    for w in words:
        total = total + F.contains(col, F.lit(w)).cast("int")
    return total


def trim(col: Column) -> Column:
    return F.regexp_replace(col, rf"^{SPACE}+|{SPACE}+\z", "")


def squeeze(col: Column) -> Column:
    """Runs of white space as single spaces, none at the ends."""
    return F.btrim(F.regexp_replace(col, f"{SPACE}+", " "))


def blank_to_null(col: Column) -> Column:
    return F.when(F.length(col) > 0, col)


def rounded(col: Column, digits: int = 0) -> Column:
    """Half up, towards positive infinity."""
    return F.floor(col * F.lit(10.0**digits) + F.lit(0.5)) / F.lit(10.0**digits)


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value computed once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))
