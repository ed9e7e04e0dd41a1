"""Secrets in texts: fixed patterns, and values in credential contexts that are hard to guess."""

from __future__ import annotations

import re
from bisect import bisect_left
from functools import lru_cache
from itertools import accumulate
from math import log2

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Patterns of the base kinds, in the order that breaks ties of spans.
KINDS = ("assign", "access", "hex", "guess")
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A
)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
ASSIGN_LEAST = 6

# Stems of which every credential context holds one, and the contexts themselves.
STEMS = ("pass", "pwd", "pin", "secret", "token", "key", "credential", "auth", "bearer", "login")
CONTEXT = re.compile(
    r"""\b(?:pass(?:word|wd|phrase|code)?|pwd|pin|(?:client[ _-]?)?secret|token|(?:api|access|private|secret)[ _-]?key"""
    r"""|credentials?|auth(?:orization)?|bearer|login)["']?\s{0,4}(?:[:=]>?|\bis\b|\s)\s{0,4}["']?(?=[^\s"'<>,;]{6})""",
    re.I | re.A,
)
VALUE = re.compile(r"""[^\s"'<>,;]+""", re.A)  # follows a context
TRAILING = ".,;:!?)]}*#&%$"

# Words and keyboard rows that guessers try first, the most common first.
COMMON = (
    "password passwd secret token login admin root user guest test letmein welcome master dragon monkey football "
    "baseball shadow sunshine princess iloveyou trustno hello freedom whatever qazwsx superman batman michael "
    "jordan harley ranger hunter buster soccer hockey killer george charlie andrew thomas robert jessica "
    "changeme default example sample demo temp none null true false your here xxxx value string key api"
).split()
ROWS = ("`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./")
SHIFTED = dict(zip('~!@#$%^&*()_+{}|:"<>?', "`1234567890-=[]\\;',./"))
LEET = str.maketrans({"4": "a", "@": "a", "3": "e", "1": "i", "0": "o", "5": "s", "$": "s", "7": "t"})
DATES = re.compile(
    r"(?=((?:19|20)\d\d(?:[-/._]?(?:0[1-9]|1[0-2])[-/._]?(?:0[1-9]|[12]\d|3[01]))?))"
    r"|(?=((?:0[1-9]|[12]\d|3[01])[-/._]?(?:0[1-9]|1[0-2])[-/._]?(?:19|20)\d\d))"
)

MIN_BITS = 26.6  # about 10^8 guesses
PER_CHARACTER = log2(10)  # a character of a brute-force span
LONGEST_UNIT = 8  # characters of a repeated unit


@lru_cache(1)
def _neighbours() -> dict[str, set[str]]:
    near: dict[str, set[str]] = {}
    place = {c: (r, k) for r, row in enumerate(ROWS) for k, c in enumerate(row)}
    for a, (r, k) in place.items():
        near[a] = {b for b, (q, m) in place.items() if (q == r and abs(m - k) == 1) or (abs(q - r) == 1 and abs(m - k) <= 1)}
    return near


def _walks(text: str) -> list[tuple[int, int, float]]:
    """Longest runs of neighbouring keys or of equal steps in the character code, three characters or more."""
    near, out, n = _neighbours(), [], len(text)
    keys = [SHIFTED.get(c, c.lower()) for c in text]
    start = 0
    for i in range(1, n + 1):
        if i == n or keys[i] not in near.get(keys[i - 1], ()):
            if i - start >= 3:
                turns = sum(keys[k + 1] != keys[k - 1] and ord(keys[k + 1]) - ord(keys[k]) != ord(keys[k]) - ord(keys[k - 1]) for k in range(start + 1, i - 1))
                out.append((start, i, log2(47) + log2(i - start) + 2 * turns))
            start = i
    start = 0
    for i in range(1, n + 1):
        step = ord(text[i]) - ord(text[i - 1]) if i < n else None
        if i == n or abs(step) != 1 or (i - start >= 2 and step != ord(text[i - 1]) - ord(text[i - 2])):
            if i - start >= 3:
                out.append((start, i, log2(26) + 1 + log2(i - start)))
            start = i - 1 if i < n and abs(step) == 1 else i
    return out


def _words(text: str, ranks: dict[str, int]) -> list[tuple[int, int, float]]:
    low, plain = text.lower(), text.lower().translate(LEET)
    out, longest = [], max(map(len, ranks), default=0)
    for i in range(len(text)):
        for j in range(i + 3, min(len(text), i + longest) + 1):
            rank = ranks.get(plain[i:j])
            if rank is not None:
                case = 0 if text[i:j].islower() else 1 if text[i:j].istitle() or text[i:j].isupper() else 3
                swapped = sum(a != b for a, b in zip(low[i:j], plain[i:j]))
                out.append((i, j, log2(rank + 2) + case + swapped))
    return out


def guess_bits(value: str, words: tuple[str, ...] = tuple(COMMON)) -> float:
    """Bits of the guesses that a guesser needs who knows the best segmentation of a value.

    Dynamic programming over the value's prefixes: the cheapest segmentation of a prefix
    ends in a word, a date, a repeat of what stands before it, a keyboard walk, or one
    more brute-force character. A segment costs one bit more than its guesses. Words and
    dates are short, walks and repeats are found as longest runs, so the time grows with
    the value's length.
    """
    n = len(value)
    ends: list[list[tuple[int, float]]] = [[] for _ in range(n + 1)]
    for i, j, bits in _words(value, _ranks(words)) + _walks(value):
        ends[j].append((i, bits))
    for m in DATES.finditer(value):
        found = m[1] or m[2]
        ends[m.start() + len(found)].append((m.start(), log2(150) if len(found) == 4 else log2(150 * 365)))
    run = [0] * (LONGEST_UNIT + 1)
    best = [0.0] * (n + 1)
    brute = [False] * (n + 1)
    for j in range(1, n + 1):
        best[j], brute[j] = best[j - 1] + PER_CHARACTER + (0 if brute[j - 1] else 1), True
        for i, bits in ends[j]:
            if best[i] + bits + 1 < best[j]:
                best[j], brute[j] = best[i] + bits + 1, False
        for unit in range(1, LONGEST_UNIT + 1):
            run[unit] = run[unit] + 1 if j > unit and value[j - 1] == value[j - 1 - unit] else 0
            if run[unit] >= unit:  # the unit stands before its repeats and is paid for there
                times = run[unit] // unit
                i = j - times * unit
                if best[i] + log2(times + 1) + 1 < best[j]:
                    best[j], brute[j] = best[i] + log2(times + 1) + 1, False
    return best[n]


@lru_cache(4)
def _ranks(words: tuple[str, ...]) -> dict[str, int]:
    return {w: k for k, w in reversed(list(enumerate(words)))}


def _hard(value: str, assigned: bool, min_bits: float) -> bool:
    letters, digits = any(map(str.isalpha, value)), any(map(str.isdigit, value))
    if not assigned and not (letters and digits):
        return False  # prose goes on after the key word
    return guess_bits(value) >= min_bits


def find(text: str, min_bits: float = MIN_BITS) -> list[tuple[int, int, str]]:
    """Spans of secrets: start, end (code points, end exclusive) and kind, by start and then kind.

    ``assign``, ``access`` and ``hex`` are the leftmost matches, of each kind apart, of the
    fixed patterns. ``guess`` are values in credential contexts whose guess cost is
    ``min_bits`` or more and that no base span meets. A value may be or hold a context word
    and opens a context of its own then; within a guess span there is no other.
    """
    spans = [(*m.span(), "hex") for m in HEX.finditer(text)]
    if "AKIA" in text:
        spans += [(*m.span(), "access") for m in ACCESS.finditer(text)]
    low = text.lower()
    if any(s in low for s in STEMS):
        spans += [(*m.span(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
        taken = sorted(spans)
        starts, reach = [a for a, _, _ in taken], list(accumulate((b for _, b, _ in taken), max))
        run = tail = guessed = 0
        soft = None  # the last value that is no secret: its start, its run and whether it is assigned
        for m in CONTEXT.finditer(text):
            start = m.end()
            if start >= run:
                run = tail = VALUE.match(text, start).end()
                while tail > start and text[tail - 1] in TRAILING:
                    tail -= 1
            met = bisect_left(starts, tail)
            if tail - start < ASSIGN_LEAST or start < guessed or (met and reach[met - 1] > start):
                continue
            assigned = any(c in ":=" for c in text[m.start() : start])
            # A value that only repeats the start of a weak one has a repeat less and is weak, too.
            again = soft and soft[1] == run and soft[2] >= assigned and text.startswith(text[soft[0] : start], start)
            if not again and _hard(text[start:tail], assigned, min_bits):
                spans.append((start, tail, "guess"))
                guessed = tail
            else:
                soft = start, run, assigned
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def scan(docs: DataFrame, text: str = "text", spans: str = "secret_spans", min_bits: float = MIN_BITS) -> DataFrame:
    """``docs`` with an array of (kind, start, end) of the secrets of each whole text, see :func:`find`.

    Nulls and empty texts have an empty array. Other columns pass through, a column named
    ``spans`` is replaced; rows are not moved.
    """

    @F.arrow_udf("array<struct<kind:string,start:long,end:long>>")
    def run(texts: pa.Array) -> pa.Array:
        found = [find(t or "", min_bits) for t in texts.to_pylist()]
        return pa.array([[{"kind": k, "start": a, "end": b} for a, b, k in f] for f in found], _SPANS)

    return docs.withColumn(spans, run(F.col(text)))


def count(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s.kind == kind)).cast("long")


def written(spans: Column) -> Column:
    """Spans as ``kind:start:end``, joined by commas in their order."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")


def redact(docs: DataFrame, text: str = "text", mask: str = "[secret]", min_bits: float = MIN_BITS) -> DataFrame:
    """``docs`` with every secret, overlapping spans as one, replaced by ``mask``; null texts stay null."""

    def clean(value: str | None) -> str | None:
        if not value:
            return value
        out, at = [], 0
        for start, end, _ in find(value, min_bits):
            if start >= at:
                out += [value[at:start], mask]
            at = max(at, end)
        return "".join(out) + value[at:]

    @F.arrow_udf("string")
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([clean(t) for t in texts.to_pylist()], pa.string())

    return docs.withColumn(text, run(F.col(text)))
