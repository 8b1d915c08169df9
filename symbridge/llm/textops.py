"""Word and n-gram fingerprints of Arrow text columns, vectorised over the UTF-8 bytes.

Words are `[^\\x20\\x09-\\x0D]+`. A fingerprint is a 64-bit polynomial of the bytes, finalised by a bit mixer; equal words have
equal fingerprints everywhere.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes that end a word, and A-Z to a-z.
BREAKS = np.zeros(256, bool)
BREAKS[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 2**64)
SLICE_BYTES = 1 << 21
#: Bytes that are hashed at once.
PIECE = 1 << 16

_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, n up to PIECE."""
    if base not in _powers:
        each = np.full(PIECE, base, np.uint64)
        each[0] = 1
        _powers[base] = np.cumprod(each, dtype=np.uint64)
    return _powers[base][:n]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective mixer of 64-bit values (shift, multiply, shift)."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def unmixed(x: np.ndarray) -> np.ndarray:
    """What mixed() gives x for."""
    back = np.uint64(pow(0xD6E8FEB86659FD93, -1, 2**64))
    x = x ^ (x >> np.uint64(32))
    x = x * back
    x = x ^ (x >> np.uint64(32))
    x = x * back
    return x ^ (x >> np.uint64(32))


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a text column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    return raw, at - at[0]


def slices(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows of about SLICE_BYTES; a longer text is a run of its own."""
    raw, at = utf8(column)
    row, rows = 0, len(at) - 1
    while row < rows:
        end = max(row + 1, int(np.searchsorted(at, at[row] + SLICE_BYTES, "right")) - 1)
        yield row, end, raw[at[row] : at[end]], at[row : end + 1] - at[row]
        row = end


class Words:
    """The words of a run of rows: start and end (bytes), row, and first[r]:first[r+1] the words of row r."""

    def __init__(self, raw: np.ndarray, at: np.ndarray):
        inside = ~BREAKS[raw]
        before = np.empty_like(inside)
        before[:1] = False
        before[1:] = inside[:-1]
        after = np.empty_like(inside)
        after[-1:] = False
        after[:-1] = inside[1:]
        cut = at[(at > 0) & (at < len(raw))]
        before[cut] = False
        after[cut - 1] = False
        self.raw = raw
        self.start = np.flatnonzero(inside & ~before)
        self.end = np.flatnonzero(inside & ~after) + 1
        self.first = np.searchsorted(self.start, at)
        self.row = np.repeat(np.arange(len(at) - 1), np.diff(self.first))

    def __len__(self) -> int:
        return len(self.start)

    def prints(self) -> np.ndarray:
        """A fingerprint (uint64) of each word. Bytes are taken PIECE at a time, so a very long text needs little beside its words."""
        n = len(self.raw)
        begins, ends = np.zeros(len(self), np.uint64), np.zeros(len(self), np.uint64)
        from_, to, before = 0, 0, np.uint64(0)
        for low in range(0, n, PIECE):
            high = min(n, low + PIECE)
            total = np.empty(high - low + 1, np.uint64)
            total[0] = before
            total[1:] = self.raw[low:high]
            total[1:] += np.uint64(1)
            total[1:] *= powers(BASE, high - low) * np.uint64(pow(BASE, low, 2**64))
            np.cumsum(total, out=total)
            a, b = np.searchsorted(self.start, high, "left"), np.searchsorted(self.end, high, "right")
            start = self.start[from_:a] - low
            # the sum from a word's start to its end, moved to the start of the text
            begins[from_:a], ends[to:b] = total[start], total[self.end[to:b] - low]
            from_, to, before = a, b, total[-1]
        return mixed((ends - begins) * self._inverse())

    def _inverse(self) -> np.ndarray:
        """INVERSE to the power of each word's start."""
        high, low = np.divmod(self.start, PIECE)
        piece = np.full(int(high[-1]) + 1 if len(high) else 1, pow(INVERSE, PIECE, 2**64), np.uint64)
        piece[0] = 1
        return powers(INVERSE, PIECE)[low] * np.cumprod(piece, dtype=np.uint64)[high]

    def grams(self, prints: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(fingerprints, first words) of the n-word runs that lie in one row, in order."""
        m = len(prints) - n + 1
        if m <= 0:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        h = np.zeros(m, np.uint64)
        for j in range(n):
            h *= np.uint64(BASE)
            h += prints[j : j + m]
        whole = np.flatnonzero(self.row[:m] == self.row[n - 1 :])
        return mixed(h[whole]), whole
