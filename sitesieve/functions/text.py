"""Text helpers as column expressions.

Patterns follow the dialect of Python's ``re`` on ``str``: ``\\w \\s \\b \\d`` and ignore-case are Unicode-aware and only
``\\n`` ends a line. Java needs flags for that, which :func:`dialect` adds.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters str.strip() removes.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


def dialect(pattern: str, ignore_case: bool = False) -> str:
    """Prefix ``pattern`` with the Java flags that give it Python's meaning.

    The Unicode character classes are slower than the ASCII ones, so they are requested only where the pattern uses a
    class that differs.
    """
    flags = "d"
    if re.search(r"\\[wWsSdDbB]", pattern):
        flags += "U"
    elif ignore_case:
        flags += "u"
    if ignore_case:
        flags += "i"
    return f"(?{flags}){pattern}"


def starting(characters: str, pattern: str) -> str:
    """The pattern, with a test of its first character in front.

    A pattern that begins with alternatives tries each of them at every position; one character class tells at most
    positions that none can match. ``characters`` are those the alternatives begin with.
    """
    return f"(?=[{characters}]){pattern}"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` to a name inside an expression, so that it is evaluated once however often ``body`` uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def matches(text: Column, pattern: str, ignore_case: bool = False) -> Column:
    return F.rlike(text, F.lit(dialect(pattern, ignore_case)))


def find_all(text: Column, pattern: str, group: int = 0, ignore_case: bool = False) -> Column:
    """All non-overlapping matches, as ``array<string>`` of one group."""
    return F.regexp_extract_all(text, F.lit(dialect(pattern, ignore_case)), F.lit(group))


def find_groups(text: Column, pattern: str, groups: int = 1, ignore_case: bool = False) -> Column:
    """All matches as ``array<struct<g0, g1, ..>>``.

    The text is searched once; the groups are then read from the (short) match itself. That is exact only for patterns
    whose match does not depend on what follows or precedes it, i.e. without lookaround and ``$``, which is why
    patterns with those use :func:`find_all` instead.
    """
    flagged = dialect(pattern, ignore_case)
    return F.transform(
        F.regexp_extract_all(text, F.lit(flagged), F.lit(0)),
        lambda m: F.struct(
            m.alias("g0"), *[F.regexp_extract(m, flagged, g).alias(f"g{g}") for g in range(1, groups + 1)]
        ),
    )


def first_group(text: Column, pattern: str, group: int = 1, ignore_case: bool = False) -> Column:
    return F.regexp_extract(text, dialect(pattern, ignore_case), group)


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITESPACE))


def cut(text: Column, length: int) -> Column:
    return F.substring(text, 1, length)


def starts_with_any(text: Column, *prefixes: str) -> Column:
    condition = text.startswith(prefixes[0])
    for prefix in prefixes[1:]:
        condition = condition | text.startswith(prefix)
    return condition


def contains_any(text: Column, *needles: str) -> Column:
    condition = F.contains(text, F.lit(needles[0]))
    for needle in needles[1:]:
        condition = condition | F.contains(text, F.lit(needle))
    return condition


def has_scheme(text: Column) -> Column:
    return starts_with_any(text, "http://", "https://")


def case_fold(text: Column, lowered: Column) -> Column:
    """Fold as ignore-case matching does, given the lower-cased text.

    It differs from lower case only where long s or a dotted or dotless i occurs; almost no page has one, so the slow
    character-wise translation is skipped for the rest.
    """
    odd = contains_any(lowered, "\u017f", "\u0131", "\u0307")
    return F.when(odd, F.lower(F.translate(text, "\u017f\u0131\u0130", "sii"))).otherwise(lowered)


def any_literal(words: list[str] | tuple[str, ...]) -> str:
    """One alternation that finds any of the words, taken literally."""
    return "|".join(re.escape(w) for w in words)


def longest_literal(words: Iterable[str]) -> str:
    """A pattern for the longest of the words at a position; words that begin alike share their beginning in it."""
    tails: dict[str, list[str]] = {}
    for word in words:
        if word:
            tails.setdefault(word[0], []).append(word[1:])

    def branch(first: str, rest: list[str]) -> str:
        longer = longest_literal(rest)
        ends = "?" if "" in rest and longer else ""
        return re.escape(first) + (f"(?:{longer}){ends}" if longer else "")

    return "|".join(branch(first, rest) for first, rest in tails.items())


def literals_in(text: Column, words: Iterable[str]) -> Column:
    """The words that a text holds, each once, by one search; where one begins another at a place, the longer only."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?=({longest_literal(words)}))"), F.lit(1)))


def count_of(text: Column, needle: str) -> Column:
    """Occurrences of a non-empty literal."""
    removed = F.length(text) - F.length(F.replace(text, F.lit(needle), F.lit("")))
    return (removed / F.lit(len(needle))).cast("int")
