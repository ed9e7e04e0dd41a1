"""Exact token counts of every prefix of a text, without re-encoding."""

from __future__ import annotations

from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .vocabulary import MARKS, Memo, Vocabulary, load, plain_word, share

KEPT = 600_000  # words whose counts a worker remembers


class PrefixCounter:
    """Token counts by dynamic programming over the prefixes of each word.

    An encoding is the text's own exactly if each two neighbouring tokens are the
    encoding of their joined string. So the last token of a prefix is the one token
    that ends there and fits the last token of the prefix before it, and the count is
    one more than the count there. Each prefix is looked at in two forms: open (more
    of the word follows) and closed (the text ends there, with the word end if the
    vocabulary has one).
    """

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        end = vocabulary.word_end
        ids = vocabulary.ids
        special = set(vocabulary.special.values())
        self._open: dict[str, int] = {}
        self._closed: dict[str, int] = {}
        self._parts: dict[int, list[int]] = {}
        for string, i in ids.items():
            if i in special:
                continue
            closed = bool(end) and string.endswith(end) and string != end
            word = string.removesuffix(end) if closed else string
            try:
                symbols = [ids[c] for c in word[:-1]] + [ids[word[-1] + end * closed]]
            except KeyError:  # a symbol that no text has
                continue
            if vocabulary.merged(symbols) == [i]:
                (self._closed if closed else self._open)[word] = i
                self._parts[i] = symbols
        if not end:
            self._closed = self._open
        #: length of the longest token that ends with a character
        self._reach: dict[str, int] = {}
        for w in (*self._open, *self._closed):
            self._reach[w[-1]] = max(len(w), self._reach.get(w[-1], 0))
        self._fits = Memo(self._fit, 300_000)
        self._counts = Memo(self._count_word, KEPT // 6)
        self._pieces = Memo(self._piece, KEPT)
        probe = "Aa É"
        self._lowers = bool(end) and vocabulary.words(probe) == vocabulary.words(probe.lower())

    def _fit(self, pair: tuple[int, int]) -> bool:
        left, right = pair
        return self.vocabulary.merged(self._parts[left] + self._parts[right]) == [left, right]

    def word(self, word: str, all_prefixes: bool = True) -> list[int]:
        """Tokens of each closed prefix of a word, from one character to all, or of the whole word alone."""
        opened, closed, reach, fits = self._open.get, self._closed.get, self._reach, self._fits
        same = self._open is self._closed
        last, count, out = [-1], [0], []
        n = len(word)
        for i in range(1, n + 1):
            first = i - reach.get(word[i - 1], 0)
            if first < 0:
                first = 0
            if i < n or same:
                for start in range(first, i):
                    token = opened(word[start:i])
                    if token is not None and (not start or fits[last[start], token]):
                        last.append(token)
                        count.append(count[start] + 1)
                        break
                else:
                    raise ValueError(f"the vocabulary cannot write {word!r}")
            if same:
                out.append(count[i])
            elif all_prefixes or i == n:
                for start in range(first, i):
                    token = closed(word[start:i])
                    if token is not None and (not start or fits[last[start], token]):
                        out.append(count[start] + 1)
                        break
                else:
                    raise ValueError(f"the vocabulary cannot write {word!r}")
        return out

    def _count_word(self, word: str) -> int:
        return self.word(word, all_prefixes=False)[-1]

    def _piece(self, piece: str) -> int:
        counts = self._counts
        if self._lowers and (word := plain_word(piece.lower())) is not None:
            return self._count_word(word)
        head = piece.rstrip(MARKS)
        if self._lowers and head and len(head) < len(piece) and plain_word(head) is not None:
            return self._pieces[head] + counts[piece[len(head) :]]
        return sum(counts[w] for w in self.vocabulary.words(piece))

    def count(self, text: str) -> int:
        """Tokens of a whole text; special strings inside it are one token each."""
        if self.vocabulary.word_end:
            return sum(
                1 if k % 2 else sum(map(self._pieces.__getitem__, s.split(" ")))
                for k, s in enumerate(self.vocabulary.sections(text))
            )
        return sum(1 if k % 2 else self._piece(s) for k, s in enumerate(self.vocabulary.sections(text)) if s)

    def prefixes(self, text: str) -> list[int]:
        """Tokens of every prefix of the text's words, a word's characters one by one; special strings are one step.

        The last item is the whole text's count. Steps are characters of the words as
        the library writes them (normalized, bytes as characters).
        """
        out, before = [], 0
        for k, section in enumerate(self.vocabulary.sections(text)):
            if k % 2:
                before += 1
                out.append(before)
                continue
            for w in self.vocabulary.words(section):
                out += [before + n for n in self.word(w)]
                before = out[-1]
        return out

    def fit(self, text: str, budget: int) -> tuple[int, int]:
        """Whole words and tokens of the longest run of words from the start with at most ``budget`` tokens.

        Every cut is answered from the stored counts: they never fall from one word end to the next.
        """
        ends, before = [], 0
        for k, section in enumerate(self.vocabulary.sections(text)):
            for n in [1] if k % 2 else map(self._counts.__getitem__, self.vocabulary.words(section)):
                before += n
                ends.append(before)
        words = bisect_right(ends, budget)
        return words, ends[words - 1] if words else 0


def count_tokens(docs: DataFrame, path: str, text: str = "text", count: str = "n_tokens") -> DataFrame:
    """``docs`` with the exact token count of each whole text.

    Nulls count as empty texts (0 tokens). Other columns pass through, a column named
    ``count`` is replaced. Rows are not moved.
    """
    shared = share(docs.sparkSession, path)

    @F.arrow_udf("long")
    def run(texts: pa.Array) -> pa.Array:
        counter = load(PrefixCounter, shared.value)
        return pa.array([counter.count(t or "") for t in texts.to_pylist()], pa.int64())

    return docs.withColumn(count, run(F.col(text)))


def prefix_counts(docs: DataFrame, path: str, text: str = "text", counts: str = "prefix_tokens") -> DataFrame:
    """``docs`` with the counts of all prefixes, see :meth:`PrefixCounter.prefixes`; an empty array for no words."""
    shared = share(docs.sparkSession, path)

    @F.arrow_udf("array<int>")
    def run(texts: pa.Array) -> pa.Array:
        counter = load(PrefixCounter, shared.value)
        return pa.array([counter.prefixes(t or "") for t in texts.to_pylist()], pa.list_(pa.int32()))

    return docs.withColumn(counts, run(F.col(text)))


def cut_at(counts: Column, budget: int) -> Column:
    """Longest prefix within a budget, from stored counts. Closed prefixes may shrink by a step, so all are looked at."""
    steps = F.filter(F.sequence(F.lit(1), F.size(counts)), lambda i: F.get(counts, i - 1) <= budget)
    return F.when(F.size(counts) > 0, F.coalesce(F.array_max(steps), F.lit(0))).otherwise(F.lit(0))
