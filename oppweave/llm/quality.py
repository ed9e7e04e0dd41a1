"""Quality rules: fixed counts of a text, and a conditional random field over its lines."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import word_blocks

SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"
CONTENT, BOILERPLATE = 1, 0

# Parameters of the rules and the fit.
MIN_WORDS = 10
MAX_REPEATED_PERCENT = 20
WINDOW = 5
MIN_CONTENT = 0.5  # share of a text's words in content lines
FIT_DOCUMENTS = 1500  # labelled documents that the fit reads at most
FIT_LINES = 64  # lines of one training sequence; longer texts give several
FIT_ROUNDS = 60
FIT_PENALTY = 0.01


# ------------------------------------------------------------------ features of a line


def _bucket(share: float) -> int:
    return 0 if share == 0 else 1 if share < 0.05 else 2 if share < 0.15 else 3 if share < 0.35 else 4


#: Number of values of each feature, in the order of :func:`features`.
SIZES = (6, 5, 5, 5, 4, 2, 2, 5)


def features(line: str, seen: bool) -> tuple[int, ...]:
    """Values of a line: words, symbols, capitals, digits, word length, sentence end, repeat, other marks."""
    words = line.split()
    n = len(words)
    inked = sum(map(len, words))
    if not n:
        return (0,) * len(SIZES)
    symbols = sum(map(line.count, SYMBOLS))
    upper = sum(map(str.isupper, words))
    digits = sum(map(line.count, "0123456789"))
    marks = sum(map(line.count, "!?=_~^{}[]()\\/"))
    mean = inked / n
    return (
        1 if n < 4 else 2 if n < 10 else 3 if n < 25 else 4 if n < 80 else 5,
        _bucket(symbols / inked),
        _bucket(upper / n),
        _bucket(digits / inked),
        0 if mean < 3 else 1 if mean < 8 else 2 if mean < 14 else 3,
        int(words[-1][-1] in ".!?"),
        int(seen),
        _bucket(marks / inked),
    )


def line_features(text: str) -> tuple[list[tuple[int, ...]], list[int]]:
    """Features and word counts of the lines that have a word."""
    seen, found, sizes = set(), [], []
    for line in text.split("\n"):
        n = len(line.split())
        if n:
            found.append(features(line, line in seen))
            seen.add(line)
            sizes.append(n)
    return found, sizes


# ------------------------------------------------------------------ the random field


@dataclass
class LineField:
    """A linear chain over lines with two states. ``weights``: of each feature value, per state;
    ``steps``: from state to state; ``begin``: of the first line's state."""

    weights: list[list[list[float]]]
    steps: list[list[float]]
    begin: list[float]

    def __post_init__(self):
        self._scores: dict[tuple[int, ...], tuple[float, float]] = {}

    def score(self, values: tuple[int, ...]) -> tuple[float, float]:
        got = self._scores.get(values)
        if got is None:
            got = tuple(sum(self.weights[k][v][s] for k, v in enumerate(values)) for s in (0, 1))
            self._scores[values] = got
        return got

    def decode(self, lines: list[tuple[int, ...]]) -> list[int]:
        """The most likely states, by Viterbi's recursion; ties go to content."""
        if not lines:
            return []
        (aa, ab), (ba, bb) = self.steps
        a, b = (x + y for x, y in zip(self.begin, self.score(lines[0])))
        back = []
        for values in lines[1:]:
            x, y = self.score(values)
            to_a, to_b = a + aa > b + ba, a + ab > b + bb
            back.append((BOILERPLATE if to_a else CONTENT, BOILERPLATE if to_b else CONTENT))
            a, b = (a + aa if to_a else b + ba) + x, (a + ab if to_b else b + bb) + y
        state = BOILERPLATE if a > b else CONTENT
        out = [state]
        for pair in reversed(back):
            state = pair[state]
            out.append(state)
        return out[::-1]


def fit_field(texts: list[tuple[str, int]]) -> LineField:
    """Fit by gradient ascent on the conditional likelihood; every line has its text's label.

    Expected counts come from the forward and backward sums, over all sequences at once. A step that
    would lower the likelihood is not taken but made anew with a quarter of the rate. The fit has no random part, so the same texts give the same field.
    """
    rows, labels = [], []
    for text, label in texts:
        lines, _ = line_features(text)
        for k in range(0, len(lines), FIT_LINES):
            rows.append(lines[k : k + FIT_LINES])
            labels.append(label)
    offsets = np.concatenate([[0], np.cumsum(SIZES)])
    total, n = int(offsets[-1]), len(rows)
    if not n:
        zero = [[[0.0, 0.0] for _ in range(s)] for s in SIZES]
        return LineField(zero, [[0.0, 0.0], [0.0, 0.0]], [0.0, 0.0])
    longest = max(map(len, rows))
    value = np.full((n, longest, len(SIZES)), total)  # the last row of the weights stays zero
    for i, lines in enumerate(rows):
        value[i, : len(lines)] = np.array(lines) + offsets[:-1]
    there = np.arange(longest) < np.array([len(r) for r in rows])[:, None]
    y = np.array(labels)
    # Each class counts the same, or the rarer one would give way.
    share = np.bincount(y, weights=there.sum(1), minlength=2)
    weight = (1 / np.maximum(share, 1))[y]

    def climb(w: np.ndarray, steps: np.ndarray, begin: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Penalised log-likelihood and its gradient."""
        emit = w[value].sum(2)
        forward, backward = np.zeros((n, longest, 2)), np.zeros((n, longest, 2))
        forward[:, 0] = begin + emit[:, 0]
        for t in range(1, longest):
            step = np.logaddexp.reduce(forward[:, t - 1, :, None] + steps, axis=1) + emit[:, t]
            forward[:, t] = np.where(there[:, t, None], step, forward[:, t - 1])
        for t in range(longest - 2, -1, -1):
            step = np.logaddexp.reduce(steps + (emit[:, t + 1] + backward[:, t + 1])[:, None, :], axis=2)
            backward[:, t] = np.where(there[:, t + 1, None], step, 0)
        norm = np.logaddexp.reduce(forward[:, -1], axis=1)
        gap = -np.exp(forward + backward - norm[:, None, None]) * there[:, :, None]
        gap[np.arange(n), :, y] += there
        gap *= weight[:, None, None]
        g_w = np.zeros_like(w)
        for k in range(len(SIZES)):
            for s in (0, 1):
                g_w[:, s] += np.bincount(value[:, :, k].ravel(), weights=gap[:, :, s].ravel(), minlength=total + 1)
        g_w[total] = 0
        both = there[:, 1:]
        pair = forward[:, :-1, :, None] + steps + (emit + backward)[:, 1:, None, :] - norm[:, None, None, None]
        pair = np.where(both[:, :, None, None], pair, -np.inf)
        g_steps = -(np.exp(pair) * weight[:, None, None, None]).sum((0, 1))
        for s in (0, 1):
            g_steps[s, s] += (both.sum(1) * weight)[y == s].sum()
        at_label = (emit[np.arange(n), :, y] * there).sum(1) + steps[y, y] * both.sum(1) + begin[y]
        penalty = FIT_PENALTY / 2 * sum((x * x).sum() for x in (w, steps, begin))
        grads = [g - FIT_PENALTY * x for g, x in zip((g_w, g_steps, gap[:, 0].sum(0)), (w, steps, begin))]
        return float(((at_label - norm) * weight).sum() - penalty), grads

    now = [np.zeros((total + 1, 2)), np.zeros((2, 2)), np.zeros(2)]
    pace, rate = [np.zeros_like(x) for x in now], 1.0
    height, grads = climb(*now)
    for _ in range(FIT_ROUNDS):
        move = [0.8 * p + rate * g for p, g in zip(pace, grads)]
        ahead = [x + m for x, m in zip(now, move)]
        new_height, new_grads = climb(*ahead)
        if new_height >= height:
            now, height, grads, pace, rate = ahead, new_height, new_grads, move, rate * 1.2
        else:  # too far: the likelihood has one peak, so shorter steps reach it
            pace, rate = [np.zeros_like(x) for x in now], rate / 4
    w, steps, begin = now
    parts = [w[offsets[k] : offsets[k + 1]].tolist() for k in range(len(SIZES))]
    return LineField(parts, steps.tolist(), begin.tolist())


def fit_lines(docs: DataFrame, labels: DataFrame, most: int = FIT_DOCUMENTS) -> LineField:
    """Fit the field on at most ``most`` labelled documents, those whose hashed ids come first.

    Only these few rows reach the driver. ``labels`` has doc_id and quality (1: content); null
    ids, labels and texts are left out.
    """
    marked = labels.filter("doc_id is not null and quality is not null")
    some = marked.select("doc_id", "quality").orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(most)
    rows = (
        docs.select("doc_id", "text").join(F.broadcast(some), "doc_id").filter("text is not null")
        .orderBy(F.xxhash64("doc_id"), F.xxhash64("text"), "quality").limit(most)
    )
    return fit_field([(r["text"], int(r["quality"] > 0)) for r in rows.collect()])


# ------------------------------------------------------------------ the rules over documents


def repeated_words(words, rows: int) -> np.ndarray:
    """Words of each text that stand in a window found twice or more in the text."""
    value, at = words.windows(WINDOW)
    out = np.zeros(rows, dtype=np.int64)
    if not len(at):
        return out
    doc = words.doc[at]
    order = np.lexsort((value, doc))
    v, d = value[order], doc[order]
    same = (v[1:] == v[:-1]) & (d[1:] == d[:-1])
    twice = np.zeros(len(at), dtype=bool)
    twice[1:] |= same
    twice[:-1] |= same
    cover = np.zeros(len(words) + 1, dtype=np.int64)
    starts = at[order][twice]
    np.add.at(cover, starts, 1)
    np.add.at(cover, starts + WINDOW, -1)
    inside = np.cumsum(cover[:-1]) > 0
    return np.bincount(words.doc[inside], minlength=rows).astype(np.int64)


def _lines(text: str, field: LineField) -> tuple[int, float]:
    """Repeated lines, and the share of words that stand in content lines."""
    lines, sizes, repeats, seen = [], [], 0, set()
    for line in text.split("\n"):
        if not line.strip(BLANKS):
            continue
        again = line in seen
        repeats += again
        seen.add(line)
        lines.append(features(line, again))
        sizes.append(len(line.split()))
    total = sum(sizes)
    if not total:
        return repeats, 0.0
    states = field.decode(lines)
    return repeats, sum(n for n, s in zip(sizes, states) if s == CONTENT) / total


_OUT = pa.struct(
    [(c, pa.int64()) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    + [("content_share", pa.float64())]
)


def judge(docs: DataFrame, field: LineField, text: str = "text", min_content: float = MIN_CONTENT) -> DataFrame:
    """``docs`` with the counts of each whole text, ``base_failed``, ``content_share`` and ``kept``.

    A text fails at once with fewer than ``MIN_WORDS`` words or when more than
    ``MAX_REPEATED_PERCENT`` of its words stand in five-word windows that it repeats.
    Any other is kept if at least ``min_content`` of its words stand in lines that the
    field marks as content. Null and empty texts have zeros and fail. Columns of
    ``docs`` with the names of results are replaced; rows are not moved. A worker holds
    one Arrow batch, and arrays for about a megabyte of its text.
    """
    schema = (
        "struct<n_words:long,word_chars:long,n_symbols:long,n_dup_lines:long,n_repeat_words:long,content_share:double>"
    )

    @F.arrow_udf(schema)
    def run(texts: pa.Array) -> pa.Array:
        parts = []
        for row, end, words in word_blocks(texts):
            rows = end - row
            n_words = np.diff(words.first)
            repeats = repeated_words(words, rows)
            block = [t or "" for t in texts.slice(row, rows).to_pylist()]
            inked = [len(t) - sum(map(t.count, BLANKS)) for t in block]
            symbols = [sum(map(t.count, SYMBOLS)) for t in block]
            lines = [_lines(t, field) for t in block]
            columns = [n_words, inked, symbols, [x[0] for x in lines], repeats]
            arrays = [pa.array(c, pa.int64()) for c in columns] + [pa.array([x[1] for x in lines], pa.float64())]
            parts.append(pa.StructArray.from_arrays(arrays, fields=list(_OUT)))
        return pa.concat_arrays(parts) if parts else pa.array([], _OUT)

    # The row travels as one struct, so that no column of it can have the name of a result on the way.
    names = [f.name for f in _OUT]
    others = [F.col(f"row.`{c}`") for c in docs.columns if c not in (*names, "base_failed", "kept")]
    judged = docs.select(F.struct("*").alias("row"), run(F.col(text).cast("string")).alias("judged"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words"))
    kept = ~F.col("base_failed") & (F.col("content_share") >= min_content)
    measured = judged.select("row", "judged.*").withColumn("base_failed", failed).withColumn("kept", kept)
    return measured.select(*others, *names, "base_failed", "kept")
