"""Quality scores of documents by gradient-boosted trees over statistics of the text.

The statistics of every text are counted where the rows are. The trees are grown on the driver, on histograms of the
statistics of a bounded sample of labelled rows, and then laid out in flat arrays that all documents of a batch walk
through together.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .quality import repeated_words
from .words import Words, text_blocks

# Parameters of the fit.
FIT_DOCUMENTS = 20_000  # labelled documents that the fit reads at most, those whose hashed ids come first
BINS = 64  # of a statistic's histogram
TREES = 120
DEPTH = 5
RATE = 0.1
PENALTY = 1.0  # on a leaf's value
LEAST_WEIGHT = 2.0  # sum of second derivatives in a leaf

#: Statistics of a text, in the order of the columns of :func:`statistics`.
STATISTICS = (
    "log_words", "bytes_per_word", "distinct_words", "doubled_words", "repeated_words", "top_word",
    "longest_word", "log_lines", "words_per_line", "repeated_lines",
    "upper", "lower", "digits", "symbols", "bars", "exclaims", "stops", "brackets", "beyond_ascii",
)

_CLASSES = 9
_CLASS = np.full(256, _CLASSES, dtype=np.int64)  # of other bytes, not counted
for _k, _chars in enumerate((
    "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789", "#*$%&<>@^~=+_", "|", "!?", ".,;:", "()[]{}/\\\"'`",
)):
    _CLASS[[ord(c) for c in _chars]] = _k
_CLASS[0x80:] = _CLASSES - 1


def statistics(texts: pa.Array) -> np.ndarray:
    """One row of statistics per text; zeros for nulls and texts without words."""
    out = np.zeros((len(texts), len(STATISTICS)))
    for row, end, data, offsets in text_blocks(texts):
        rows = end - row
        words = Words(data, offsets, lower=False)
        n = np.diff(words.first)
        some = np.maximum(n, 1)
        sizes = np.diff(offsets)
        inked = np.bincount(words.doc, weights=words.end - words.start, minlength=rows)
        found = out[row:end]
        found[:, 0] = np.log1p(n)
        found[:, 1] = inked / some
        if len(words):
            order = np.lexsort((words.hash, words.doc))
            doc, value = words.doc[order], words.hash[order]
            new = np.ones(len(doc), dtype=bool)
            new[1:] = (doc[1:] != doc[:-1]) | (value[1:] != value[:-1])
            found[:, 2] = np.bincount(doc[new], minlength=rows) / some
            starts = np.flatnonzero(new)
            times = np.diff(np.append(starts, len(doc)))
            top = np.zeros(rows)
            np.maximum.at(top, doc[starts], times)
            found[:, 5] = top / some
            twice = (words.doc[1:] == words.doc[:-1]) & (words.hash[1:] == words.hash[:-1])
            found[:, 3] = np.bincount(words.doc[1:][twice], minlength=rows) / some
            longest = np.zeros(rows)
            np.maximum.at(longest, words.doc, words.end - words.start)
            found[:, 6] = np.log1p(longest)
        found[:, 4] = repeated_words(words, rows) / some
        for k in range(rows):
            text = texts[row + k].as_py()
            lines = [line for line in text.split("\n") if line.strip()] if text else []
            if lines:
                found[k, 7] = np.log1p(len(lines))
                found[k, 8] = n[k] / len(lines)
                found[k, 9] = 1 - len(set(lines)) / len(lines)
        body = _CLASS[data[int(offsets[0]) : int(offsets[-1])]]
        owner = np.repeat(np.arange(rows) * (_CLASSES + 1), sizes)
        counts = np.bincount(owner + body, minlength=rows * (_CLASSES + 1)).reshape(rows, _CLASSES + 1)[:, :_CLASSES]
        found[:, 10:] = counts / np.maximum(inked, 1)[:, None]
        found[n == 0] = 0
    return out


# ------------------------------------------------------------------ trees


@dataclass
class Trees:
    """All trees in flat arrays: an inner node sends values up to its threshold left; a leaf leads to itself."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    base: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        """Log odds of rows of statistics: all rows go down all trees together, one level at a time."""
        if not len(self.roots):
            return np.full(len(x), self.base)
        at = np.tile(self.roots, (len(x), 1))
        row = np.arange(len(x))[:, None]
        for _ in range(DEPTH):
            at = np.where(x[row, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
        return self.base + self.value[at].sum(axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.raw(x)))


def bin_edges(x: np.ndarray) -> list[np.ndarray]:
    """Upper edges of each statistic's bins but the last: quantiles of the sample, each once."""
    return [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1], method="lower")) for c in x.T]


def grow(x: np.ndarray, y: np.ndarray, trees: int = TREES) -> Trees:
    """Boost trees for the log loss of labels 0 and 1. The fit has no random part.

    With labels of one kind only every score is that kind's smoothed share; without any it is one half.
    """
    share = (y.sum() + 1) / (len(y) + 2)
    base = float(np.log(share / (1 - share)))
    nodes: dict[str, list] = {c: [] for c in ("feature", "threshold", "left", "right", "value")}
    roots: list[int] = []
    if len(y) and 0 < y.sum() < len(y):
        edges = bin_edges(x)
        binned = np.stack([np.searchsorted(e, c, "left") for e, c in zip(edges, x.T)], axis=1)
        raw = np.full(len(y), base)
        for _ in range(trees):
            p = 1 / (1 + np.exp(-raw))
            roots.append(len(nodes["value"]))
            raw += _grow_tree(binned, edges, p - y, p * (1 - p), nodes)
    kinds = {"feature": np.int64, "left": np.int64, "right": np.int64}
    arrays = {c: np.array(v, dtype=kinds.get(c, np.float64)) for c, v in nodes.items()}
    return Trees(**arrays, roots=np.array(roots, dtype=np.int64), base=base)


def _grow_tree(binned: np.ndarray, edges: list[np.ndarray], g: np.ndarray, h: np.ndarray, nodes: dict) -> np.ndarray:
    """Add one tree to the arrays, level by level; returns what it adds to each row's log odds."""
    n, width = binned.shape
    cells = np.arange(width) * BINS + binned  # histogram cell of each row and statistic
    at = np.zeros(n, dtype=np.int64)  # node of each row, within the level; -1: in a leaf
    first = _new_nodes(nodes, 1)
    added = np.zeros(n)
    for depth in range(DEPTH + 1):
        count = len(nodes["value"]) - first
        inside = at >= 0
        total_g = np.bincount(at[inside], weights=g[inside], minlength=count)
        total_h = np.bincount(at[inside], weights=h[inside], minlength=count)
        best = np.full(count, -1)
        if depth < DEPTH:
            place = (at[inside, None] * width * BINS + cells[inside]).ravel()
            shape = (count, width, BINS)

            def histogram(v: np.ndarray) -> np.ndarray:
                filled = np.bincount(place, weights=np.repeat(v[inside], width), minlength=count * width * BINS)
                return filled.reshape(shape).cumsum(axis=2)

            lg, lh = histogram(g), histogram(h)
            rg, rh = total_g[:, None, None] - lg, total_h[:, None, None] - lh
            gain = lg**2 / (lh + PENALTY) + rg**2 / (rh + PENALTY) - (total_g**2 / (total_h + PENALTY))[:, None, None]
            for k, e in enumerate(edges):
                gain[:, k, len(e) :] = -np.inf  # behind the last edge nothing is on the right
            gain[(lh < LEAST_WEIGHT) | (rh < LEAST_WEIGHT)] = -np.inf
            flat = gain.reshape(count, -1)
            top = flat.argmax(axis=1)
            best = np.where(flat[np.arange(count), top] > 1e-9, top, -1)
        value = -RATE * total_g / (total_h + PENALTY)
        split = np.flatnonzero(best >= 0)
        children = _new_nodes(nodes, 2 * len(split))
        child_of = np.full(count, -1)
        child_of[split] = 2 * np.arange(len(split))
        for k in range(count):
            if best[k] < 0:
                nodes["value"][first + k] = float(value[k])
            else:
                feature, b = divmod(int(best[k]), BINS)
                nodes["feature"][first + k] = feature
                nodes["threshold"][first + k] = float(edges[feature][b])
                nodes["left"][first + k] = children + int(child_of[k])
                nodes["right"][first + k] = children + int(child_of[k]) + 1
        rows = np.flatnonzero(inside)
        node = at[rows]
        leaf = best[node] < 0
        added[rows[leaf]] = value[node[leaf]]
        at[rows[leaf]] = -1
        rows, node = rows[~leaf], node[~leaf]
        feature, b = np.divmod(best[node], BINS)
        at[rows] = child_of[node] + (binned[rows, feature] > b)
        if not len(rows):
            break
        first = children
    return added


def _new_nodes(nodes: dict, n: int) -> int:
    """Room for ``n`` nodes, leaves at first; returns the place of the first one."""
    at = len(nodes["value"])
    nodes["feature"] += [0] * n
    nodes["threshold"] += [0.0] * n
    nodes["left"] += range(at, at + n)
    nodes["right"] += range(at, at + n)
    nodes["value"] += [0.0] * n
    return at


# ------------------------------------------------------------------ on tables


def _statistics_of(text: str) -> Column:
    @F.arrow_udf("array<double>")
    def run(texts: pa.Array) -> pa.Array:
        values = statistics(texts)
        starts = np.arange(len(values) + 1, dtype=np.int32) * len(STATISTICS)
        return pa.ListArray.from_arrays(pa.array(starts), pa.array(values.ravel()))

    return run(F.col(text).cast("string"))


def fit_trees(
    docs: DataFrame, labels: DataFrame, label: str = "quality", most: int = FIT_DOCUMENTS, trees: int = TREES, text: str = "text",
    doc_id: str = "doc_id",
) -> Trees:
    """Grow trees on at most ``most`` labelled documents, those whose hashed ids come first.

    ``labels`` has the id and the label (positive: 1). Null ids, labels and texts take no part. Repeated rows of
    an id count as often as they stand, within the bound. Only the statistics of these rows reach the driver.
    """
    known = labels.select(F.col(doc_id).alias("id"), F.col(label).cast("double").alias("label"))
    some = known.filter("id is not null and label is not null").orderBy(F.xxhash64("id"), "id", "label").limit(most)
    joined = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).filter("text is not null").join(F.broadcast(some), "id")
    measured = joined.select("id", (F.col("label") > 0).cast("int").alias("label"), _statistics_of("text").alias("x"))
    rows = measured.orderBy(F.xxhash64("id"), "id", "label", "x").limit(most).select("label", "x").toArrow()
    if not len(rows):
        return grow(np.zeros((0, len(STATISTICS))), np.zeros(0), trees)
    x = rows["x"].combine_chunks().flatten().to_numpy().reshape(len(rows), len(STATISTICS))
    return grow(x, rows["label"].to_numpy().astype(float), trees)


def with_scores(docs: DataFrame, model: Trees, text: str = "text", score: str = "score") -> DataFrame:
    """``docs`` with the score of each whole text, 0 to 1; a column of that name is replaced.

    Null and empty texts and texts without words have statistics of zero and the score of these. Rows are not
    moved, and no other column is read. The trees are a broadcast of fixed size.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def run(texts: pa.Array) -> pa.Array:
        x = statistics(texts)
        parts = [shared.value.score(x[k : k + 2000]) for k in range(0, len(x), 2000)]
        return pa.array(np.concatenate(parts) if parts else np.zeros(0), pa.float64())

    return docs.withColumn(score, run(F.col(text).cast("string")))
