"""Rule lists compiled to column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vocab
from .text import ascii_words, col, has, let, norm


def tag_values(
    text: Column | str, rules: list[tuple[str, list[str]]], scan_once: bool = True
) -> Column:
    """Distinct values of every rule whose pattern occurs in the text.

    With ``scan_once`` the (wide) text is read by one combined regex that yields
    the short list of words found (zero-width, so overlapping words all count);
    the single rules then look at that list only.  This needs rules of which no
    two match at the same word start; for other rule sets pass ``scan_once=False``
    and each rule reads the text.
    """
    text = F.coalesce(col(text), F.lit(""))
    none = F.array().cast("array<string>")

    def pick(t: Column) -> Column:
        values = [F.when(has(t, p), F.array(*[F.lit(v) for v in vs])).otherwise(none) for p, vs in rules]
        return F.array_distinct(F.flatten(F.array(*values)))

    if not scan_once:
        return pick(text)
    union = "|".join(f"(?:{p})" for p, _ in rules)
    found = F.regexp_extract_all(
        text, F.lit("(?i)" + _first_letters(rules) + r"(?<!\w)(?=" + ascii_words(f"({union})") + ")"), F.lit(1)
    )
    return let(
        found,
        lambda f: F.when(F.size(f) == 0, none).otherwise(
            let(F.array_join(F.array_distinct(f), "\n"), pick)
        ),
    )


def _first_letters(rules: list[tuple[str, list[str]]]) -> str:
    """A look at the first letter of every pattern, which most places of a text fail; nothing for other patterns."""
    starts = [re.match(r"(?:\\b)?([a-z])(?![?*{])", p) for pattern, _ in rules for p in pattern.split("|")]
    if any(m is None for m in starts) or any("(" in pattern for pattern, _ in rules):
        return ""
    return f"(?=[{''.join(sorted({m[1] for m in starts}))}])"


def tag_states(text: Column | str) -> Column:
    """Postal codes of the states named or abbreviated in a text, in table order.

    Codes and one-word names are looked up among the text's distinct words; only
    names of several words read the text, and only where their words occur.
    """
    text = F.coalesce(col(text), F.lit(""))
    starts: dict[str, set[str]] = {}
    for part in (p for c, n in vocab.STATES.items() for p in (c.lower(), *n.lower().split())):
        starts.setdefault(part[0], set()).add(part[1:])
    some = "|".join(f"{first}(?:{'|'.join(sorted(rest))})" for first, rest in sorted(starts.items()))
    found = F.regexp_extract_all(text, F.lit(rf"(?i)(?=[{''.join(sorted(starts))}])(?<!\w)((?:{some})(?!\w))"), F.lit(1))
    words = F.array_distinct(F.transform(found, F.lower))

    def pick(w: Column) -> Column:
        tests = []
        for code, name in vocab.STATES.items():
            parts = name.lower().split()
            named = F.array_contains(w, parts[0])
            if len(parts) > 1:
                named = (
                    named & F.array_contains(w, parts[-1])
                    & has(text, r"\b" + r"\s+".join(parts) + r"\b")
                )
            tests.append(F.when(F.array_contains(w, code.lower()) | named, F.lit(code)))
        return F.array_compact(F.array(*tests))

    return let(words, lambda w: F.when(F.size(w) == 0, F.array().cast("array<string>")).otherwise(pick(w)))


def state_code(value: Column | str) -> Column:
    """Postal code of a state given by name or code; other text as it is."""
    raw = F.trim(F.coalesce(col(value), F.lit("")))
    lookup = F.create_map(
        *[F.lit(x) for code, name in vocab.STATES.items() for x in (name.lower(), code)]
    )
    return F.coalesce(
        F.try_element_at(lookup, F.lower(raw)),
        F.when(F.length(raw) == 2, F.upper(raw)).otherwise(raw),
    )


def student_stage(stage: Column | str, grade: Column | str) -> Column:
    """Stage as given, else derived from the grade level."""
    stage, grade = norm(stage), norm(grade)
    out = F.when(stage != "", stage).when(grade == "", F.lit(""))
    for pattern, value in vocab.GRADE_STAGES:
        out = out.when(has(grade, pattern), F.lit(value))
    return out.otherwise("")


def stage_terms(stage: Column | str, grade: Column | str) -> Column:
    """Phrases that speak for a student's stage."""
    stage, grade = norm(stage), norm(grade)

    def arr(key: str) -> Column:
        return F.array(*[F.lit(t) for t in vocab.STAGE_TERMS[key]])

    return (
        F.when((stage == "starting_college") | grade.contains("12"), arr("starting_college"))
        .when(stage == "in_college", arr("in_college"))
        .when(stage.isin("transfering_college", "transferring_college"), arr("transferring_college"))
        .otherwise(arr(""))
    )


def term_hits(terms: Column, text: Column | str) -> Column:
    """Number of stage phrases in a text; "freshman" also finds "freshmen"."""

    def count(x: Column) -> Column:
        return F.size(
            F.filter(
                terms,
                lambda t: x.contains(t) | x.contains(F.replace(t, F.lit("freshman"), F.lit("freshmen"))),
            )
        )

    return let(norm(text), count)


def rule_matches(rules: Column, value: Column | str) -> Column:
    """Some rule equals, holds or is held by the value; blanks never match."""
    return let(
        norm(value),
        lambda v: (v != "")
        & F.exists(
            F.transform(rules, norm), lambda r: (r != "") & (v.contains(r) | r.contains(v))
        ),
    )


def stage_fits(stages: Column, stage: Column) -> Column:
    """Does the set of required stages suit a student's stage?"""

    def need(s: str) -> Column:
        return F.array_contains(stages, s)

    starting = (
        need("incoming_freshman")
        | need("high_school")
        | (need("undergraduate") & ~need("continuing_college") & ~need("graduate"))
    )
    enrolled = need("continuing_college") | need("undergraduate") | need("incoming_freshman")
    return (
        F.when(F.size(stages) == 0, False)
        .when(stage == "starting_college", starting)
        .when(stage == "in_college", enrolled)
        .otherwise(False)
    )


def stage_conflicts(stages: Column, stage: Column) -> Column:
    """Do the required stages exclude a student's stage outright?"""

    def need(s: str) -> Column:
        return F.array_contains(stages, s)

    return (
        F.when((F.size(stages) == 0) | stage_fits(stages, stage), False)
        .when(stage == "starting_college", need("graduate") | need("continuing_college"))
        .when(
            stage == "in_college",
            need("graduate")
            | (need("high_school") & ~need("incoming_freshman") & ~need("undergraduate")),
        )
        .otherwise(False)
    )
