"""Byte-pair merges of one word."""

from __future__ import annotations

from heapq import heapify, heappop, heappush

_COUNT = list(range(-1, 1 << 14))


def merge(
    symbols: list[int], ranks: list[int | None], merges: dict[int, int], made: list[int]
) -> list[int]:
    """Apply merges by rank, leftmost first: a heap of (rank, place) over a doubly linked symbol list.

    ``ranks`` are those of the neighbouring pairs, None where there is no merge. ``merges`` has the rank of a
    pair under ``left << 20 | right``, ``made`` the symbol that each rank makes. A heap entry is the rank
    followed by the place's bits. It is stale when its left symbol is gone or the pair that now starts there has
    another rank; such entries are skipped. The list is changed and returned.
    """
    n = len(symbols)
    bits = 14 if n < 1 << 14 else 40  # short numbers are faster
    heap = [rank << bits | i for i, rank in enumerate(ranks) if rank is not None]
    if not heap:
        return symbols
    get = merges.get
    heapify(heap)
    after = _COUNT[2 : n + 2] if bits == 14 else list(range(1, n + 1))
    before = _COUNT[:n] if bits == 14 else list(range(-1, n - 1))
    places = (1 << bits) - 1
    while heap:
        entry = heappop(heap)
        i = entry & places
        j = after[i]
        left = symbols[i]
        if left < 0 or j == n:
            continue
        rank = entry >> bits
        if get(left << 20 | symbols[j]) != rank:
            continue
        symbols[i] = new = made[rank]
        symbols[j] = -1
        after[i] = k = after[j]
        if k < n:
            before[k] = i
            rank = get(new << 20 | symbols[k])
            if rank is not None:
                heappush(heap, rank << bits | i)
        h = before[i]
        if h >= 0:
            rank = get(symbols[h] << 20 | new)
            if rank is not None:
                heappush(heap, rank << bits | h)
    return [s for s in symbols if s >= 0]
