"""Words of many texts at once: positions and 64-bit hashes by numpy over the bytes of a batch.

Words are runs of characters other than blank and the five ASCII controls from tab to
carriage return. These are single bytes in UTF-8, so bytes can be looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK = 1 << 20  # bytes of text that are worked on together; a longer text is a block of its own

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_MIX = tuple(np.uint64(v) for v in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads all bits."""
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


_CODES = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))


class _Powers:
    """Powers of the base and of its inverse, as many as the longest block so far needs."""

    up = down = np.ones(1, dtype=np.uint64)

    @classmethod
    def get(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            def powers(v: int) -> np.ndarray:
                steps = np.full(n, np.uint64(v))
                steps[0] = 1
                return np.cumprod(steps, dtype=np.uint64)

            cls.up, cls.down = powers(_BASE), powers(_BASE_INVERSE)
        return cls.up, cls.down


class Words:
    """Words of a block of texts.

    ``doc``: the text of each word; ``start`` and ``end``: its bytes, counted from the
    text's first; ``hash``: of its bytes; ``first``: the first word of each text, with
    one more item for the end.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool):
        base = int(offsets[0])
        data, at = data[base : int(offsets[-1])], (offsets - base).astype(np.int64)
        if lower:
            data = _LOWER[data]
        word = ~_SPACE[data]
        begins, ends = word.copy(), word.copy()
        begins[1:] &= ~word[:-1]
        ends[:-1] &= ~word[1:]
        borders = at[1:-1]
        inner = borders[(borders > 0) & (borders < len(data))]
        begins[inner] = word[inner]
        ends[inner - 1] = word[inner - 1]
        start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        up, down = _Powers.get(len(data) + 1)
        sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(_CODES[data] * up[: len(data)], out=sums[1:])
        self.hash = mixed((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))
        self.first = np.searchsorted(start, at)
        self.doc = np.repeat(np.arange(len(at) - 1), np.diff(self.first))
        self.start, self.end = start - at[self.doc], end - at[self.doc]

    def __len__(self) -> int:
        return len(self.hash)

    def windows(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all runs of ``n`` words inside a text, and the first word of each."""
        if len(self) < n:
            return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
        at = np.flatnonzero(self.doc[: len(self) - n + 1] == self.doc[n - 1 :])
        return self.runs(at, n), at

    def shaped(self, shape: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the words at the places of a shape, counted from each word on, and that first word; all in one text."""
        size = shape[-1] + 1
        if len(self) < size:
            return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
        at = np.flatnonzero(self.doc[: len(self) - size + 1] == self.doc[size - 1 :])
        value = np.full(len(at), np.uint64(sum(1 << k for k in shape)))
        for k in shape:
            value = mixed(value * np.uint64(_BASE) + self.hash[at + k])
        return value, at

    def runs(self, at: np.ndarray, n: int) -> np.ndarray:
        """Hashes of the runs of ``n`` words from the given words on."""
        value = np.full(len(at), np.uint64(n))
        for k in range(n):
            value = mixed(value * np.uint64(_BASE) + self.hash[at + k])
        return value


def text_blocks(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut a string column into runs of rows of about ``BLOCK`` bytes: first row, end row, bytes, offsets."""
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    n = len(texts)
    if not n:
        return
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + n + 1]
    body = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    row = 0
    while row < n:
        end = max(row + 1, int(np.searchsorted(at, at[row] + BLOCK, "right")) - 1)
        end = min(end, n)
        yield row, end, body, at[row : end + 1]
        row = end


def word_blocks(texts: pa.Array, lower: bool = False) -> Iterator[tuple[int, int, Words]]:
    """The words of a string column, block by block: first row, end row, words. Nulls have none."""
    for row, end, data, offsets in text_blocks(texts):
        yield row, end, Words(data, offsets, lower)
