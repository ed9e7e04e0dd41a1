"""Hard negatives of anchor vectors, searched exactly in an inverted multi-index.

A vector is cut in two halves, each with a codebook of its own; a pair of codes is a cell. For an anchor, a half's code
bounds the half's share of any inner product: that with the centre, plus the anchor's length times the code's radius,
the largest distance of any vector from its centre. A heap visits the cells by falling sum of the two bounds, without
making all sums first. A search ends as soon as what it has found is at least as good as the next cell's bound, so
the results are those of a full comparison.

On a cluster, cells are cut into slices of bounded size. Anchors are sent to the slices of the cells that they
visit, first those with the best bounds, then all that their first finds do not rule out, and meet the slice's rows in one
matrix product per batch.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .files import stored

CODES = 8  # of each half
FIT_ROWS = 4096  # vectors that the codebooks are fitted on, those whose hashed ids come first
FIT_ROUNDS = 12
SLICE_VALUES = 1 << 22  # components of a slice's vectors, about
FIRST_ROWS = 4096  # rows of the cells that an anchor visits first
LARGEST = 1 << 25  # of a scaled component's size
ANCHORS = 64  # that are compared at once


# ------------------------------------------------------------------ the index


def centres(x: np.ndarray, k: int) -> np.ndarray:
    """Centres of at most ``k`` clusters by Lloyd's rounds; starts far from each other, so nothing is random."""
    if not len(x):
        return np.zeros((1, x.shape[1]))
    found = [x.mean(axis=0)]
    gap = ((x - found[0]) ** 2).sum(axis=1)
    while len(found) < k and gap.max() > 0:
        found.append(x[gap.argmax()])
        gap = np.minimum(gap, ((x - found[-1]) ** 2).sum(axis=1))
    at = np.stack(found)
    for _ in range(FIT_ROUNDS):
        own = nearest(x, at)
        sums = np.zeros_like(at)
        np.add.at(sums, own, x)
        n = np.bincount(own, minlength=len(at))
        at = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], at)
    return at


def nearest(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    return ((at**2).sum(axis=1) - 2 * x @ at.T).argmin(axis=1)


@dataclass
class Index:
    """Codebooks of both halves with the radius of each code, and the slices and rows of each cell."""

    books: tuple[np.ndarray, np.ndarray]
    radii: tuple[np.ndarray, np.ndarray]
    slices: np.ndarray
    rows: np.ndarray

    def bounds(self, vector: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Per half and code: the largest and the least share of an inner product with the vector."""
        cut, high, low = self.books[0].shape[1], [], []
        for half, book, radius in zip((vector[:cut], vector[cut:]), self.books, self.radii):
            middle, reach = book @ half, np.linalg.norm(half) * radius
            slack = 1e-6 + 1e-9 * (np.abs(middle) + reach)  # beyond any rounding
            high.append(middle + reach + slack)
            low.append(middle - reach - slack)
        return high, low

    def visits(self, vector: np.ndarray, least: float | None, ceiling: float = np.inf) -> Iterator[tuple[int, int]]:
        """Cells and slices to search: the first ones without ``least``, else the rest with bounds of ``least`` or more.

        Cells whose every row is above ``ceiling`` are left out.
        """
        high, low = self.bounds(vector)
        seen, done = 0, False
        for bound, i, j in by_sum(*high):
            if done and (least is None or bound < least):
                return
            cell = i * len(high[1]) + j
            if not self.rows[cell] or low[0][i] + low[1][j] > ceiling:
                continue
            if done or least is None:
                for s in range(self.slices[cell]):
                    yield cell, s
            seen += self.rows[cell]
            done = seen >= FIRST_ROWS


def by_sum(a: np.ndarray, b: np.ndarray) -> Iterator[tuple[float, int, int]]:
    """All pairs of entries by falling sum, with their places: a heap of the pairs next to those given out."""
    first, second = np.argsort(-a, kind="stable"), np.argsort(-b, kind="stable")

    def entry(i: int, j: int) -> tuple[float, int, int]:
        return -(a[first[i]] + b[second[j]]), i, j

    heap, seen = [entry(0, 0)], {(0, 0)}
    while heap:
        minus, i, j = heapq.heappop(heap)
        yield -float(minus), int(first[i]), int(second[j])
        for x, y in ((i + 1, j), (i, j + 1)):
            if x < len(a) and y < len(b) and (x, y) not in seen:
                seen.add((x, y))
                heapq.heappush(heap, entry(x, y))


def scaled(rows: DataFrame, scale: float, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """``id, label, q`` of the rows that take part: components times ``scale``, rounded down.

    Left out are rows with a null id or label, a null or empty vector, a null or non-finite component or one of
    2^25 or more after scaling, and vectors of another length than most (of equal counts, the longest). Of several rows
    with one id the one with the smallest label and vector stays. Other columns are not read.
    """
    x = F.col(vector).cast("array<double>")
    kept = rows.select(F.col(vec_id).cast("long").alias("id"), F.col(label).cast("long").alias("label"), x.alias("x"))
    kept = kept.filter("id is not null and label is not null and size(x) > 0").filter(
        F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v * F.lit(scale)) < LARGEST))
    )
    whole = kept.select("id", "label", F.transform("x", lambda v: F.floor(v * F.lit(scale)).cast("int")).alias("q"))
    return whole.groupBy("id").agg(F.min(F.struct("label", "q")).alias("r")).select("id", "r.label", "r.q")


def _matrix(column: pa.Array) -> np.ndarray:
    """A column of equally long lists of integers as a matrix."""
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(n, -1) if n else np.zeros((0, 0))


def build_index(rows: DataFrame, codes: int = CODES) -> tuple[Index, DataFrame]:
    """The index over ``rows`` (id, label, q) and the rows with their cell and slice.

    The codebooks are fitted on ``FIT_ROWS`` rows at most. Every row is given its cell, and radii and counts are
    taken over all rows; two times ``codes`` radii and ``codes`` squared counts come to the driver.
    """
    spark = rows.sparkSession
    sizes = rows.groupBy(F.size("q").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    width = sizes["d"] if sizes else 1
    rows = rows.filter(F.size("q") == width)
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(FIT_ROWS).select("q").toArrow()["q"].combine_chunks()
    x = _matrix(sample).astype(float).reshape(-1, width)
    cut = (width + 1) // 2
    books = centres(x[:, :cut], codes), centres(x[:, cut:], codes)
    shared = spark.sparkContext.broadcast(books)

    @F.arrow_udf("struct<c0:int,c1:int,r0:double,r1:double>")
    def place(q: pa.Array) -> pa.Array:
        values, out = _matrix(q).astype(float).reshape(-1, width), []
        for half, book in zip((values[:, :cut], values[:, cut:]), shared.value):
            own = nearest(half, book)
            out.append((own, np.sqrt(((half - book[own]) ** 2).sum(axis=1))))
        (c0, r0), (c1, r1) = out
        arrays = [pa.array(c0, pa.int32()), pa.array(c1, pa.int32()), pa.array(r0), pa.array(r1)]
        return pa.StructArray.from_arrays(arrays, names=["c0", "c1", "r0", "r1"])

    coded = stored(rows.withColumn("p", place("q")).select("id", "label", "q", "p.*"), "coded")
    radii = [np.zeros(len(b)) for b in books]
    n_rows = np.zeros(len(books[0]) * len(books[1]), dtype=np.int64)
    found = coded.groupBy("c0", "c1").agg(F.count("*").alias("n"), F.max("r0").alias("r0"), F.max("r1").alias("r1"))
    for r in found.collect():  # a row per cell
        n_rows[r["c0"] * len(books[1]) + r["c1"]] = r["n"]
        radii[0][r["c0"]] = max(radii[0][r["c0"]], r["r0"])
        radii[1][r["c1"]] = max(radii[1][r["c1"]], r["r1"])
    slices = np.maximum(1, -(-n_rows // max(1, SLICE_VALUES // width)))
    cell = F.col("c0") * len(books[1]) + F.col("c1")
    of = F.element_at(F.array(*[F.lit(int(s)) for s in slices]), cell + 1)
    placed = coded.select("id", "label", "q", cell.alias("cell"), F.pmod(F.xxhash64("id"), of).cast("int").alias("slice"))
    return Index(books, tuple(radii), slices, n_rows), placed


# ------------------------------------------------------------------ search


def _best(scores: np.ndarray, ids: np.ndarray, among: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` highest scores; ids rise, so that equal scores come by their ids."""
    places = np.flatnonzero(among)
    if len(places) > k:
        own = scores[places]
        places = places[own >= np.partition(own, -k)[-k]]
    return places[np.argsort(-scores[places], kind="stable")][:k]


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of integer rows."""
    top = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if top < 2**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


def _window_hits(score: np.ndarray, ids: np.ndarray, labels: np.ndarray, label, own: int, windows, k: int) -> Iterator[tuple[int, int, int]]:
    """(window, id, score) of one anchor among a slice's rows; without windows the positives, as window 0."""
    if windows is None:
        for p in _best(score, ids, (labels == label) & (ids != own), k):
            yield 0, int(ids[p]), int(score[p])
        return
    other = (labels != label) & (score <= max(windows))
    for w, top in enumerate(windows):
        for p in _best(score, ids, other & (score <= top) & (100 * score >= 80 * top), k):
            yield w, int(ids[p]), int(score[p])


def _search(placed: DataFrame, visiting: DataFrame, k: int) -> DataFrame:
    """``anchor, w, id, score``: per window the best ``k`` rows of each slice.

    ``visiting`` has cell, slice, id, label, q and windows (null: positives are wanted) of the anchors. A slice's rows come first and are held, its anchors
    pass by.
    """
    held = placed.select("cell", "slice", F.lit(0).alias("role"), "id", "label", "q", F.lit(None).cast("array<long>").alias("windows"))
    coming = visiting.select("cell", "slice", F.lit(1).alias("role"), "id", "label", "q", "windows")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, parts, slice_rows = None, [], None
        for batch in batches:
            columns = [batch[c].to_numpy(zero_copy_only=False) for c in ("cell", "slice", "role", "id", "label")]
            keys = np.stack(columns[:3], axis=1)
            starts = np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]).any(axis=1)))
            out: list[tuple[int, int, int, int]] = []
            for a, b in zip(starts, np.append(starts[1:], len(keys))):
                if at != (keys[a, 0], keys[a, 1]):
                    at, parts, slice_rows = (keys[a, 0], keys[a, 1]), [], None
                q = _matrix(batch["q"].slice(a, b - a))
                if keys[a, 2] == 0:
                    parts.append((columns[3][a:b], columns[4][a:b], q))
                    continue
                if not parts:
                    continue
                if slice_rows is None:
                    slice_rows = [np.concatenate(x) for x in zip(*parts)]
                    parts = [tuple(slice_rows)]
                ids, labels, values = slice_rows
                windows = batch["windows"].slice(a, b - a).to_pylist()
                for m in range(0, b - a, ANCHORS):
                    scores = _products(q[m : m + ANCHORS], values)
                    for n, score in enumerate(scores, m):
                        own, label = int(columns[3][a + n]), columns[4][a + n]
                        out += [(own, *hit) for hit in _window_hits(score, ids, labels, label, own, windows[n], k)]
            if out:
                arrays = [pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int32(), pa.int64(), pa.int64()))]
                yield pa.RecordBatch.from_arrays(arrays, names=["anchor", "w", "id", "score"])

    dealt = held.unionByName(coming).repartition("cell", "slice").sortWithinPartitions("cell", "slice", "role", "id")
    return dealt.mapInArrow(run, "anchor long, w int, id long, score long")


def _top(found: DataFrame, k: int) -> DataFrame:
    """The best ``k`` of each anchor and window, with their rank from 1."""
    order = Window.partitionBy("anchor", "w").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _visiting(anchors: DataFrame, index: Index, least: Column, ceiling: Column) -> DataFrame:
    """Anchors with every cell and slice they visit; a null ``least`` asks for the first visits."""
    shared = anchors.sparkSession.sparkContext.broadcast(index)

    @F.arrow_udf("array<struct<cell:int,slice:int>>")
    def visits(q: pa.Array, least: pa.Array, ceiling: pa.Array) -> pa.Array:
        kind = pa.list_(pa.struct([("cell", pa.int32()), ("slice", pa.int32())]))
        rows = zip(_matrix(q).astype(float) if len(q) else [], least.to_pylist(), ceiling.to_pylist())
        found = [
            [{"cell": c, "slice": s} for c, s in shared.value.visits(v, low, np.inf if top is None else top)] for v, low, top in rows
        ]
        return pa.array(found, kind)

    listed = anchors.withColumn("to", visits("q", least.cast("double"), ceiling.cast("double")))
    return listed.select("id", "label", "q", "windows", F.explode("to").alias("v")).select("id", "label", "q", "windows", "v.*")


def _rounds(placed: DataFrame, anchors: DataFrame, index: Index, floor: Column, ceiling: Column, k: int, name: str) -> DataFrame:
    """The best ``k`` per anchor and window, certified. ``anchors``: id, label, q, windows.

    The first round gives each window a least score that any further row must reach: that of its k-th find, or
    ``floor`` (an array with an entry per window) where it has fewer. Cells below the least of these are never visited.
    """
    nothing = F.lit(None).cast("double")
    first = stored(_top(_search(placed, _visiting(anchors, index, nothing, ceiling), k), k).drop("rank"), f"{name}-first")
    full = first.groupBy("anchor", "w").agg(F.count("*").alias("n"), F.min("score").alias("s")).filter(F.col("n") >= k)
    reached = full.groupBy("anchor").agg(F.map_from_entries(F.collect_list(F.struct("w", "s"))).alias("reached"))
    asked = anchors.join(reached.withColumnRenamed("anchor", "id"), "id", "left").withColumn(
        "least",
        F.array_min(
            F.transform(floor, lambda f, w: F.greatest(f, F.coalesce(F.element_at("reached", w.cast("int")).cast("double"), f)))
        ),
    )
    more = _search(placed, _visiting(asked, index, F.col("least"), ceiling), k)
    return _top(first.unionByName(more), k)


def hard_negatives(rows: DataFrame, anchors: Column, n_positives: int = 5, n_negatives: int = 5, codes: int = CODES) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    ``rows`` has id, label and q (integers, see :func:`scaled`); ``anchors`` is a condition on them. Scores are
    integer inner products; higher ones come first, then smaller ids. An anchor's positives are its first
    ``n_positives`` other rows of its label. Of each positive, the first ``n_negatives`` rows of other labels with scores
    from four fifths of the positive's up to it are returned; a positive without any has no row. Equal vectors under several ids
    are rows of their own. An empty table gives an empty result.
    """
    rows = stored(rows, "vectors")
    index, placed = build_index(rows, codes)
    placed = stored(placed, "placed")
    none = F.lit(None).cast("array<long>")
    asking = placed.filter(anchors).select("id", "label", "q", none.alias("windows"))
    lowest = F.array(F.lit(float("-inf")))
    positives = stored(_rounds(placed, asking, index, lowest, F.lit(None), n_positives, "positives"), "positives")

    # Windows in the order of the positives; a negative score has none, as four fifths of it are above it.
    order = F.array_sort(F.collect_list(F.struct("rank", "score")))
    windows = (
        positives.filter("score >= 0").groupBy("anchor").agg(F.transform(order, lambda p: p["score"]).alias("windows"))
        .withColumnRenamed("anchor", "id")
    )
    seeking = asking.drop("windows").join(windows, "id")
    floor = F.transform("windows", lambda s: s * F.lit(0.8))
    found = _rounds(placed, seeking, index, floor, F.array_max("windows"), n_negatives, "negatives")
    named = positives.select("anchor", (F.col("rank") - 1).alias("w"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    return named.join(found, ["anchor", "w"]).select(
        F.col("anchor").alias("anchor_id"), "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score",
        F.col("score").alias("negative_score"),
    )
