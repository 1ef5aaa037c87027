"""Words and hashes of many texts at once, on the UTF-8 bytes of an Arrow column.

A word is a run of bytes other than space and 0x09 to 0x0D. Texts are worked on in
slices of about 256 KB, so that memory does not depend on the size of a batch; a
longer text is a slice of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 18
#: Base of the rolling hash (odd, so that it has an inverse modulo 2^64).
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, and where each begins (one more entry than texts).

    Nulls count as empty texts.
    """
    column = pc.fill_null(column.cast(pa.large_string()), "")
    raw = column.buffers()
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(raw[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(raw[2], np.uint8) if raw[2] else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most ``limit`` bytes, or of one row."""
    first, rows = 0, len(offsets) - 1
    while first < rows:
        last = int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1
        last = min(max(last, first + 1), rows)
        yield first, last
        first = last


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values over all bits, one to one."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int, base: int) -> np.ndarray:
    """base^0 to base^(n-1) modulo 2^64."""
    kept = _powers.get(base)
    if kept is None or len(kept) < n:
        kept = np.full(max(n, 1), base, np.uint64)
        kept[0] = 1
        np.cumprod(kept, out=kept)
        if n <= 2 * SLICE_BYTES:
            _powers[base] = kept
    return kept[:n]


def lowered(data: np.ndarray) -> np.ndarray:
    """The bytes with A to Z in lower case."""
    return np.where((data >= 65) & (data <= 90), data | 32, data)


def spans_of_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin and end (bytes) of each word, and the row it is in."""
    space = (data == 32) | ((data >= 9) & (data <= 13))
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.empty(len(data), bool)
    before[:1], before[1:] = True, space[:-1]
    after = np.empty(len(data), bool)
    after[-1:], after[:-1] = True, space[1:]
    begin = np.flatnonzero(~space & (before | edge[:-1]))
    end = np.flatnonzero(~space & (after | edge[1:])) + 1
    return begin, end, np.searchsorted(offsets, begin, "right") - 1


class Hasher:
    """Hashes of any stretches of one slice, from sums of its bytes times powers."""

    def __init__(self, data: np.ndarray) -> None:
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(len(data), BASE),
                  out=self.sums[1:])
        self.back = powers(len(data) + 1, INVERSE)

    def __call__(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[begin]) * self.back[begin])
