"""Text columns with the whitespace and word rules of ECMAScript regexes."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Java's \s lacks the Unicode spaces that the matched texts treat as blanks.
WS = r"[\s   -     　﻿]"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


# The same characters, told from letters and digits by a look at two ranges.
_BLANK = rf"[\x00-\x20\xa0-\uffff&&{WS}]"
# Runs of blanks that are not one plain space; that one would be replaced by itself.
_BLANKS = f"{_BLANK}(?:(?<! ){_BLANK}*|{_BLANK}+)"


def clean(c: Column | str) -> Column:
    """Collapse whitespace and trim; NULL becomes the empty string."""
    return F.trim(F.regexp_replace(F.coalesce(col(c), F.lit("")), _BLANKS, " "))


def norm(c: Column | str) -> Column:
    return F.lower(clean(c))


def blank(c: Column | str) -> Column:
    return F.coalesce(F.trim(col(c)), F.lit("")) == ""


def nonblank(c: Column | str) -> Column:
    """The value, or NULL when it is empty."""
    return F.nullif(F.coalesce(col(c), F.lit("")), F.lit(""))


_BOUNDARY = re.compile(r"\\b")


def ascii_words(pattern: str) -> str:
    """Rewrite ``\\b`` to ASCII look-arounds (Java 17's ``\\b`` is Unicode aware)."""

    def repl(m: re.Match) -> str:
        rest = pattern[m.end():]
        if rest.startswith("(") and not rest.startswith(("(?!", "(?<")):
            return r"(?<!\w)"
        if rest[:1].isalnum() or rest.startswith((r"\d", "[A-Z", "[a-z")):
            return r"(?<!\w)"
        return r"(?!\w)"

    return _BOUNDARY.sub(repl, pattern)


def has(c: Column | str, pattern: str, ignore_case: bool = True) -> Column:
    """NULL-safe regex test; ``\\b`` means an ASCII word edge."""
    flag = "(?i)" if ignore_case else ""
    return F.coalesce(col(c), F.lit("")).rlike(flag + ascii_words(pattern))


def find(c: Column | str, pattern: str, group: int = 1) -> Column:
    """First match of a group, or the empty string."""
    return F.regexp_extract(F.coalesce(col(c), F.lit("")), "(?i)" + ascii_words(pattern), group)


def find_all(c: Column | str, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(
        F.coalesce(col(c), F.lit("")), F.lit("(?i)" + ascii_words(pattern)), F.lit(group)
    )


def first_items(items: Column, n: int | None) -> Column:
    """First ``n`` items of an array; all without an ``n``."""
    return items if n is None else F.slice(items, 1, n)


def clip(c: Column | str, n: int) -> Column:
    """Cut a snippet to ``n`` characters, marking the cut with three dots."""
    return let(
        clean(c),
        lambda t: F.when(F.length(t) <= n, t).otherwise(
            F.concat(F.trim(F.substring(t, 1, max(0, n - 3))), F.lit("..."))
        ),
    )


def tokens(c: Column | str) -> Column:
    """Distinct lower-case ASCII alphanumeric tokens of a text."""
    words = F.split(F.regexp_replace(F.lower(F.coalesce(col(c), F.lit(""))), "[^a-z0-9]+", " "), " ")
    return F.array_distinct(F.filter(words, lambda t: t != ""))


def contains_either_way(a: Column, b: Column) -> Column:
    """Substring match in both directions, blanks included."""
    return a.contains(b) | b.contains(a)


def flag(c: Column) -> Column:
    """Boolean with NULL read as false."""
    return F.coalesce(c, F.lit(False))


def num(c: Column, weight: float) -> Column:
    """``weight`` where the flag holds, else zero."""
    return F.when(c, F.lit(float(weight))).otherwise(F.lit(0.0))


def listed(*pairs: tuple[Column, Column | str]) -> Column:
    """Array of the labels whose condition holds, in the order given."""
    return F.array_compact(
        F.array(*[F.when(c, F.lit(v) if isinstance(v, str) else v) for c, v in pairs])
    )


def distinct_ci(values: Column, is_clean: bool = False) -> Column:
    """Distinct strings ignoring case; the first spelling stays, blanks go."""


    def pick(vs: Column) -> Column:
        return let(
            F.transform(vs, F.lower),
            lambda keys: F.filter(vs, lambda v, i: F.array_position(keys, F.lower(v)) == i + 1),
        )

    return let(values if is_clean else F.filter(F.transform(values, clean), lambda v: v != ""), pick)


def let(value: Column, body) -> Column:
    """Bind a costly value once: ``body`` gets it as a variable.

    Spark does not share sub-expressions inside lambdas or across conditional
    branches, so a value used many times there would be computed as often.
    """
    return F.element_at(F.transform(F.array(value), body), 1)
