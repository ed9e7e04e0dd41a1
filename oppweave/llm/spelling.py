"""Words that differ by one code point, found level by level in a trie kept as tables, and the forms they vary.

Two words with one inserted, deleted or replaced code point share everything before or after it, and one of the
two parts is at least half of the longer word. So there are two tries, of the words and of the words reversed, and
in each the search for a word starts behind its first half: the trie below every half is small. A trie node is
the 64-bit hash of its path, an edge is a row (node, label); labels are one code point long near the start and longer
further on, so that the number of levels grows with the logarithm of the longest word.

The frontier holds states (word, position, node, edits). At each level the states without an edit are joined with
the edges on the node and on the label behind the next one, which must match again after an edit inside the next one;
states that had their edit are joined with the nodes that their next label leads to. A state at the end of a word is a
neighbour. Words are compared once more at the end, so equal hashes of different paths add nothing.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .files import stored

LETTERS = "A-Za-zÀ-ÿ"
END = "."  # behind every word of the trie; no letter
SHORTEST = 5  # code points of a word
RAREST = 3  # occurrences of a word
FORM_TIMES = 2  # a form has at least so many times the occurrences
HELD = 200_000  # distinct words that a task holds before it gives their counts on

_LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))


# ------------------------------------------------------------------ words and counts


def document_words(text: str, doc_id: int | None, damage: int | None, shortest: int) -> Iterator[tuple[str, int]]:
    """Words of a text and how often they stand there; with ``damage``, some without one code point."""
    low = text.encode().translate(_LOWER).decode()
    runs = Counter(re.findall(f"[{LETTERS}]{{{shortest},}}", low))
    if not damage:
        yield from runs.items()
        return
    begin = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    for run, n in runs.items():
        h = zlib.crc32(run.encode(), begin)
        if h % damage == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1 :]
            if len(run) < shortest:
                continue
        yield run, n


def count_words(
    docs: DataFrame,
    text: str = "text",
    doc_id: str = "doc_id",
    shortest: int = SHORTEST,
    rarest: int = RAREST,
    damage: int | None = None,
) -> DataFrame:
    """``word, n``: maximal runs of letters (A-Z lower-cased) of whole texts, with at least ``rarest`` occurrences.

    Letters are A to Z and U+00C0 to U+00FF. With ``damage``, a run whose CRC-32 of "id:run" it divides loses the code
    point at that number modulo its length; a null id is the empty string there. Null and empty texts have no words,
    repeated rows count each time, other columns are not read.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def given() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays(
                [pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], names=["word", "n"]
            )
            held.clear()
            return out

        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            for k, one in enumerate(ids):
                value = texts[k].as_py()
                if not value:
                    continue
                for word, n in document_words(value, one, damage, shortest):
                    held[word] += n
                if len(held) >= HELD:
                    yield given()
        if held:
            yield given()

    rows = docs.select(F.col(doc_id).cast("string"), F.col(text).cast("string"))
    parts = rows.mapInArrow(count, "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= rarest)


# ------------------------------------------------------------------ the trie


def border(level: int) -> int:
    """Code points below the root at which a level begins: 0, 1, 2, 3, 4, 6, 8, 12, 16, 24 and so on."""
    if level < 4:
        return level
    return (4 if level % 2 == 0 else 6) << (level - 4) // 2


def _piece(level: int, shift: Column | int = 0, longer: int = 0) -> Column:
    """The word's part on a level, ``shift`` code points further on, and the ``longer`` code points behind it."""
    start, end = border(level), border(level + 1)
    return F.substr(F.concat("t", F.lit(END)), F.col("h") + start + shift + F.lit(1), F.lit(end - start + longer))


def _rest() -> Column:
    return F.char_length("t") - F.col("h") + 1


def _path(level: int) -> Column:
    """The node at which a word comes to a level: its path hashed label by label."""
    node = F.xxhash64("side", "h", F.substr("t", F.lit(1), F.col("h")))
    for k in range(level):
        node = F.xxhash64(node, _piece(k))
    return node


def one_edit_pairs(words: DataFrame) -> DataFrame:
    """``a, b``: words (column word, distinct) that differ by one inserted, deleted or replaced code point.

    Both orders of each pair.
    """
    both = words.select(F.explode(F.array(F.lit(0), F.lit(1))).alias("side"), "word")
    sided = both.select("side", F.when(F.col("side") == 0, F.col("word")).otherwise(F.reverse("word")).alias("t"))
    half = F.floor(F.char_length("t") / 2).cast("int")
    searching = sided.withColumn("h", half)
    # A word of odd length is also found from words that are one code point longer, whose half is longer.
    halves = F.array_distinct(F.array(half, F.floor((F.char_length("t") + 1) / 2).cast("int")))
    targets = sided.select("side", "t", F.explode(halves).alias("h"))
    longest = words.agg(F.max(F.char_length("word"))).first()[0] or 0

    level, rounds = 0, []  # per level, the states that it led to
    while border(level) <= longest - longest // 2 + 1:
        found = _edits(searching, targets, level)
        if level:
            waiting = rounds[-1].filter(f"v is null and level = {level}")
            if level > 1:
                waiting = waiting.unionByName(rounds[-2].filter(f"v is null and level = {level}"))
            found = found.unionByName(_exact(waiting, targets, level))
        rounds.append(stored(found, f"trie-{level}"))
        level += 1
    if not rounds:
        return words.select(F.col("word").alias("a"), F.col("word").alias("b")).limit(0)

    ends = rounds[0]
    for more in rounds[1:]:
        ends = ends.unionByName(more)
    ends = ends.filter("v is not null").filter(F.levenshtein("t", "v", 1) == 1)
    turned = [F.when(F.col("side") == 0, F.col(c)).otherwise(F.reverse(c)).alias(c) for c in ("t", "v")]
    once = ends.select(*turned).distinct()
    pairs = F.array(F.struct(F.col("t").alias("a"), F.col("v").alias("b")), F.struct(F.col("v").alias("a"), F.col("t").alias("b")))
    return once.select(F.inline(pairs))


def _edits(searching: DataFrame, targets: DataFrame, level: int) -> DataFrame:
    """States that have their edit on this level: two levels further, or at the end of a word.

    Of two words with one code point replaced, the larger one finds the smaller; of two with one inserted, the
    longer one finds the shorter.
    """
    shift = F.col("shift")
    states = (
        searching.filter(_rest() > border(level))
        .withColumn("node", _path(level))
        .withColumn("shift", F.explode(F.array(F.lit(0), F.lit(1))))
        .select(
            "side", "t", "h", "shift", "node",
            _piece(level).alias("own"),
            F.when(shift == 1, _piece(level, longer=1)).otherwise(_piece(level)).alias("piece"),
            _piece(level + 1, shift).alias("key"),
        )
    )
    ended = _rest() <= border(level + 2)
    edges = (
        targets.filter(_rest() > border(level))
        .select(
            _path(level).alias("node"), _piece(level).alias("label"), _piece(level + 1).alias("key"),
            F.when(ended, F.col("t")).alias("v"),
        )
        .distinct()
    )
    hit = (
        (F.col("label") != F.col("own"))
        & (F.char_length("label") == F.char_length("piece") - shift)
        & ((shift == 1) | (F.col("label") < F.col("piece")))
        & (F.levenshtein("label", "piece", 1) == 1)
    )
    return (
        states.join(edges, ["node", "key"]).filter(hit)
        .select(
            F.lit(level + 2).alias("level"), "side", "t", "h", "shift",
            F.xxhash64(F.xxhash64("node", "label"), "key").alias("node"), "v",
        )
        .distinct()
    )


def _exact(states: DataFrame, targets: DataFrame, level: int) -> DataFrame:
    """States with their edit behind them go along the edge that their next part names, if there is one."""
    ahead = F.xxhash64("node", _piece(level, F.col("shift")))
    nodes = (
        targets.filter(_rest() > border(level))
        .select(_path(level + 1).alias("node"), F.when(_rest() <= border(level + 1), F.col("t")).alias("v"))
        .distinct()
    )
    moved = states.select(F.lit(level + 1).alias("level"), "side", "t", "h", "shift", ahead.alias("node"))
    return moved.join(nodes, "node").select("level", "side", "t", "h", "shift", "node", "v")


# ------------------------------------------------------------------ forms


def variant_groups(words: DataFrame, times: int = FORM_TIMES) -> DataFrame:
    """``words`` (word, n) with ``n_near``, ``form``, ``form_n`` and ``root``.

    Near words differ by exactly one code point; their number is 0 where there are none. A word's form is its near
    word of largest n, the smallest in code-point order among equals, if that n is at least ``times`` the word's own;
    else form and form_n are null. Following forms to the last gives the root, the word itself without a form. An
    empty table gives an empty one. ``times`` of 2 or more ends every chain after log2 of the largest n steps.
    """
    if times < 2:
        raise ValueError("times must be 2 at least, or forms could turn in a circle")
    words = stored(words.select("word", F.col("n").cast("long").alias("n")), "words")
    pairs = one_edit_pairs(words.select("word"))
    counted = pairs.join(words.select(F.col("word").alias("b"), F.col("n").alias("m")), "b")
    # Struct order: larger n last, then the larger word, so the least of (-n, word) is wanted.
    best = counted.groupBy("a").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("minus"), F.col("b").alias("b"))).alias("top")
    )
    joined = words.join(best.withColumnRenamed("a", "word"), "word", "left")
    has = -F.col("top.minus") >= times * F.col("n")
    formed = stored(
        joined.select(
            "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(has, F.col("top.b")).alias("form"), F.when(has, -F.col("top.minus")).alias("form_n"),
        ),
        "forms",
    )
    return formed.join(_roots(formed), "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )


def _roots(formed: DataFrame) -> DataFrame:
    """``word, root`` of the words with a form; every round doubles the way that has been followed."""
    at = stored(formed.filter("form is not null").select("word", F.col("form").alias("root")), "roots")
    while True:
        further = at.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        moved = at.join(further, "root", "left")
        ahead = stored(moved.select("word", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("went")), "roots")
        if ahead.filter("went").isEmpty():
            return ahead.select("word", "root")
        at = ahead.select("word", "root")
