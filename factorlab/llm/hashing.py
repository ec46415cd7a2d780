"""Vectorised words and hashes over Arrow string columns.

A sequence's hash is a polynomial of random 64-bit values per symbol, taken modulo 2^64 from prefix sums:
the hash of any span costs two subtractions and a product, and a mixer follows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are worked on at once.
SLICE = 1 << 19
_BLANK = np.zeros(256, bool)
_BLANK[[32, 9, 10, 11, 12, 13]] = True
_NOT_ALNUM = np.ones(256, bool)
_NOT_ALNUM[[*range(48, 58), *range(97, 123), *range(128, 256)]] = False
#: Which bytes part words: ASCII blanks; or all ASCII but digits and small letters.
SEPARATORS = {"blank": _BLANK, "alnum": _NOT_ALNUM}
#: Bytes with A-Z lowered.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def flat(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all rows in sequence, and where each row starts (one more entry ends the last). Null: empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8)[off[0] : off[-1]] if column.buffers()[2] and off[-1] > off[0] else np.zeros(0, np.uint8)
    return data, off - off[0]


def slices(off: np.ndarray, limit: int = SLICE) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about `limit` bytes, one row at least."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
        yield i, j
        i = j


def words(data: np.ndarray, off: np.ndarray, separators: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and the index of each row's first word (one more entry ends the last)."""
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = ~separators[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[off] = True
    left, right = inside[:-1], inside[1:]
    starts = np.flatnonzero(right & (~left | cut))
    ends = np.flatnonzero(left & (~right | cut))
    return starts, ends, np.searchsorted(starts, off)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective mixer of 64-bit values (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Hash:
    """One of many independent hashes of byte and word spans."""

    def __init__(self, seed: int):
        random = np.random.default_rng(seed)
        self.table = random.integers(0, 1 << 64, 256, np.uint64, endpoint=False)
        self.base = int(random.integers(0, 1 << 62)) * 4 + 3
        self.up = self.down = np.ones(1, np.uint64)

    def of(self, values: np.ndarray) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
        """A function that gives the hashes of spans of the values, from their starts and ends."""
        n = len(values)
        if len(self.up) <= n:
            size = n + n // 4 + 1  # workers keep these arrays
            for name, by in (("up", self.base), ("down", pow(self.base, -1, 1 << 64))):
                powers = np.full(size, by, np.uint64)
                powers[0] = 1
                setattr(self, name, np.multiply.accumulate(powers))
        sums, down = np.zeros(n + 1, np.uint64), self.down
        np.cumsum(values * self.up[:n], out=sums[1:])
        return lambda starts, ends: mixed((sums[ends] - sums[starts]) * down[starts])

    def spans(self, values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return self.of(values)(starts, ends)

    def words(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return self.spans(self.table[data], starts, ends)

    def windows(self, values: np.ndarray, size: int) -> np.ndarray:
        """Of each run of `size` values."""
        i = np.arange(max(0, len(values) - size + 1))
        return self.spans(values, i, i + size)


def in_sorted(x: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each x is in the sorted table, and where."""
    if not len(table):
        return np.zeros(len(x), bool), np.zeros(len(x), np.int64)
    at = np.minimum(np.searchsorted(table, x), len(table) - 1)
    return table[at] == x, at


def spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[i], starts[i] + 1, ... counts[i] values each, in sequence."""
    total = int(counts.sum())
    first = np.cumsum(counts) - counts
    return np.arange(total) - np.repeat(first - starts, counts)


def covered(n: int, starts: np.ndarray, size: np.ndarray | int) -> np.ndarray:
    """Which of n places lie in a span [start, start + size)."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + size, -1)
    return np.cumsum(edge[:-1]) > 0
