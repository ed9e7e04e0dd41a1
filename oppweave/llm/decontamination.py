"""Benchmark decontamination: n-gram seeds find passages, Smith-Waterman alignment scores them."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import Words, text_blocks, word_blocks

SHAPES = ((0, 1, 2), (0, 1, 3), (0, 1, 4), (0, 2, 3), (0, 2, 4), (0, 3, 4))  # places of a seed's words: any three of five
ITEM_BLOCK = 4 << 20  # bytes of benchmark texts that are held against the documents at once
MATCH, CLOSE, MISMATCH, GAP = 2.0, 1.0, -1.0, -1.0
WIDTH = 64  # bytes of words that are compared many at once
TABLE = 1 << 22  # bytes that are compared at once
MIN_SCORE = 0.5  # share of the best possible score of an item

MATCHES = "array<struct<item_id:long,score:double,start:long,end:long>>"


@dataclass
class Items:
    """Benchmark texts of one block: their ids, their words, and their seeds in order of hashes."""

    ids: list[int]
    words: list[list[bytes]]
    seeds: np.ndarray  # sorted hashes
    owner: np.ndarray  # item of each seed
    place: np.ndarray  # word of the item at which the seed starts

    @classmethod
    def of(cls, rows: list[tuple[int, str]]) -> Items:
        words, seeds, owner, place = [], [], [], []
        for k, (_, text) in enumerate(rows):
            for _, _, w in word_blocks(pa.array([text]), lower=True):
                for shape in SHAPES:
                    value, at = w.shaped(shape)
                    seeds.append(value)
                    owner.append(np.full(len(at), k))
                    place.append(at)
            words.append(_lowered(text.encode()).split())
        value = np.concatenate(seeds) if seeds else np.zeros(0, dtype=np.uint64)
        order = np.argsort(value, kind="stable")
        owner = np.concatenate(owner) if owner else np.zeros(0, dtype=np.int64)
        place = np.concatenate(place) if place else np.zeros(0, dtype=np.int64)
        return cls([i for i, _ in rows], words, value[order], owner[order], place[order])


def _lowered(text: bytes) -> bytes:
    return text.lower()  # of bytes: A to Z only


class Probe:
    """Finds which words of a block of texts begin seeds: a bit table first, then a binary search."""

    BITS = 20

    def __init__(self, seeds: np.ndarray):
        self.seeds = seeds
        self._bits = np.zeros(1 << self.BITS, dtype=bool)
        self._bits[(seeds & np.uint64((1 << self.BITS) - 1)).astype(np.int64)] = True

    def hits(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """First words of the seeds in the texts, of all shapes, and the first place of each in the sorted seeds."""
        ats, places = [], []
        for shape in SHAPES:
            value, at = words.shaped(shape)
            maybe = np.flatnonzero(self._bits[(value & np.uint64((1 << self.BITS) - 1)).astype(np.int64)])
            value, at = value[maybe], at[maybe]
            place = np.searchsorted(self.seeds, value)
            found = (place < len(self.seeds)) & (self.seeds[np.minimum(place, len(self.seeds) - 1)] == value)
            ats.append(at[found])
            places.append(place[found])
        return np.concatenate(ats), np.concatenate(places)


# ------------------------------------------------------------------ alignment


def _close(a: bytes, b: bytes) -> bool:
    """Words that an edit tells apart: their common start and end make up two thirds of the longer one."""
    size = max(len(a), len(b))
    if min(len(a), len(b)) * 3 < size * 2:
        return False
    start = 0
    for x, y in zip(a, b):
        if x != y:
            break
        start += 1
    end = 0
    for x, y in zip(reversed(a[start:]), reversed(b[start:])):
        if x != y:
            break
        end += 1
    return (start + end) * 3 >= size * 2


def _close_table(item: list[bytes], passage: list[bytes]) -> np.ndarray:
    """:func:`_close` of all pairs of a word of the item and one of the passage."""
    sizes, lengths = np.array([len(w) for w in item]), np.array([len(w) for w in passage])
    longer, shorter = np.maximum.outer(sizes, lengths), np.minimum.outer(sizes, lengths)
    near = shorter * 3 >= longer * 2
    wide = near & (longer > WIDTH)
    width = min(WIDTH, int(sizes.max()) * 3 // 2)

    def letters(words: list[bytes], step: int) -> np.ndarray:
        return np.array([w[::step][:width] for w in words], dtype=f"S{width}").view(np.uint8).reshape(len(words), width)

    def common(step: int, a: int, b: int) -> np.ndarray:
        same = np.zeros((b - a, len(passage), width + 1), dtype=bool)
        np.equal(letters(item[a:b], step)[:, None], letters(passage, step), out=same[:, :, :width])
        return np.minimum(same.argmin(axis=2), shorter[a:b])

    rows = max(1, TABLE // (len(passage) * (width + 1)))
    for a in range(0, len(item), rows):
        b = min(len(item), a + rows)
        start = common(1, a, b)
        end = np.minimum(common(-1, a, b), shorter[a:b] - start)
        near[a:b] &= (start + end) * 3 >= longer[a:b] * 2
    for i, j in zip(*np.nonzero(wide)):
        near[i, j] = _close(item[i], passage[j])
    return near


def align(passage: list[bytes], item: list[bytes], least: float = 0.0) -> tuple[float, int]:
    """Smith-Waterman local alignment of words: best score as a share of the item's full score, and where it ends.

    One row of the table per word of the item. Gaps in the passage's direction cost the same each, so
    they come from a running maximum. The score is 0 if the best fits of the item's words, in any order,
    add up to less than ``least``, as no alignment can have more.
    """
    n = len(passage)
    if not n or not item:
        return 0.0, 0
    distinct, wanted = list(dict.fromkeys(passage)), list(dict.fromkeys(item))
    place, row = {w: k for k, w in enumerate(distinct)}, {w: k for k, w in enumerate(wanted)}
    table = np.where(_close_table(wanted, distinct), CLOSE, MISMATCH).astype(np.float32)
    for w in wanted:
        if w in place:
            table[row[w], place[w]] = MATCH
    lines = [row[w] for w in item]
    if float(np.maximum(table.max(axis=1), 0)[lines].sum()) / (MATCH * len(item)) < least:
        return 0.0, 0
    of = np.array([place[w] for w in passage])
    slope = np.arange(1, n + 1) * -GAP
    before, best, end = np.zeros(n + 1), 0.0, 0
    for line in lines:
        fits = table[line][of]
        down = np.maximum(np.maximum(before[:-1] + fits, before[1:] + GAP), 0)
        across = np.maximum.accumulate(down + slope) - slope
        before[1:] = np.maximum(down, across)
        top = int(before.argmax())
        if before[top] > best:
            best, end = float(before[top]), top
    return best / (MATCH * len(item)), end


class Matcher:
    """Matches of one block of items in texts."""

    def __init__(self, items: Items):
        self.items, self._probe = items, Probe(items.seeds)

    def block(self, texts: list[bytes], words: Words, min_score: float) -> list[list[dict]]:
        found: list[list[dict]] = [[] for _ in texts]
        if not len(self.items.seeds):
            return found
        at, place = self._probe.hits(words)
        if not len(at):
            return found
        # A seed may stand in several items: go through all its entries.
        last = np.searchsorted(self.items.seeds, self.items.seeds[place], "right")
        count = last - place
        entry = np.repeat(place, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        at = np.repeat(at, count)
        doc, item = words.doc[at], self.items.owner[entry]
        begin = at - words.first[doc] - self.items.place[entry]  # where the item would start in the text
        order = np.lexsort((begin, item, doc))
        doc, item, begin = doc[order], item[order], begin[order]
        starts = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (item[1:] != item[:-1])])
        for a, b in zip(starts, [*starts[1:], len(doc)]):
            d, k = int(doc[a]), int(item[a])
            best = self._best(texts[d], words, d, k, begin[a:b], min_score)
            if best:
                found[d].append(best)
        return found

    def _best(self, text: bytes, words: Words, d: int, k: int, begin: np.ndarray, min_score: float) -> dict | None:
        item = self.items.words[k]
        size, slack = len(item), len(item) // 4 + 2
        first, end = int(words.first[d]), int(words.first[d + 1])
        best = None
        groups = np.flatnonzero(np.r_[True, np.diff(begin) > size])
        for a, b in zip(groups, [*groups[1:], len(begin)]):
            low = max(first, first + int(begin[a]) - slack)
            high = min(end, first + int(begin[b - 1]) + size + slack)
            passage = _lowered(text[words.start[low] : words.end[high - 1]]).split() if low < high else []
            score, stop = align(passage, item, min_score)
            if score >= min_score and (best is None or score > best["score"]):
                best = {"item_id": self.items.ids[k], "score": score, "start": low - first, "end": low - first + stop}
        return best


_MATCHES = pa.list_(
    pa.struct([("item_id", pa.int64()), ("score", pa.float64()), ("start", pa.int64()), ("end", pa.int64())])
)


def item_blocks(items: DataFrame, item_id: str = "item_id", text: str = "text") -> Iterator[list[tuple[int, str]]]:
    """Benchmark rows in blocks of bounded size, each held against all documents in turn."""
    block, size = [], 0
    rows = items.select(F.col(item_id).cast("long").alias("i"), F.col(text).alias("t"))
    for row in rows.filter("i is not null and t is not null").distinct().orderBy("i", "t").toLocalIterator():
        if block and size + len(row["t"]) > ITEM_BLOCK:
            yield block
            block, size = [], 0
        block.append((row["i"], row["t"]))
        size += len(row["t"])
    if block:
        yield block


def match_items(
    docs: DataFrame, items: DataFrame, text: str = "text", matches: str = "matches", min_score: float = MIN_SCORE
) -> DataFrame:
    """``docs`` with the benchmark items that stand in each whole text: item_id, score, first and last word.

    One pass over the texts looks up the seeds of the items, any three of five words in
    a row, cuts out the passage around them and aligns it with the item. Every text with a seed is aligned, however many texts hold that seed; only
    those are skipped whose words cannot add up to ``min_score``. The score is the best alignment's as a share of the item's full score, of the best
    passage; one entry per text and item. Items travel to the tasks in broadcasts of ``ITEM_BLOCK`` bytes, all held
    against a text in the same pass, so memory grows with the benchmark, not with the documents. Null texts, and items with fewer than three words, match
    nothing. Other columns pass through, a column named ``matches`` is replaced; rows are not moved.
    """
    parts = []
    for number, rows in enumerate(item_blocks(items)):
        block = Items.of(rows)
        shared = docs.sparkSession.sparkContext.broadcast(block)

        parts.append(_lookup(shared, min_score)(F.col(text).cast("string")).alias(f"block{number}"))
    if not parts:
        return docs.withColumn(matches, F.array().cast(MATCHES))
    # The row travels as one struct, so that no column of it can have the name of a block's result.
    found = docs.select(F.struct("*").alias("row"), *parts)
    others = [F.col(f"row.`{c}`") for c in docs.columns if c != matches]
    blocks = [F.col(f"block{k}") for k in range(len(parts))]
    return found.select(*others, (F.concat(*blocks) if len(blocks) > 1 else blocks[0]).alias(matches))


def _lookup(shared: Broadcast, min_score: float):
    @F.arrow_udf(MATCHES)
    def run(texts: pa.Array) -> pa.Array:
        matcher, out = Matcher(shared.value), []
        for row, end, data, offsets in text_blocks(texts):
            words = Words(data, offsets, True)
            raw = [data[a:b].tobytes() for a, b in zip(offsets, offsets[1:])]
            out += matcher.block(raw, words, min_score)
        return pa.array(out, _MATCHES)

    return run
