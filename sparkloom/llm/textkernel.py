"""Vectorised text primitives over Arrow string columns (numpy only).

A column is handled as one byte buffer plus row offsets; words, word hashes
and n-gram hashes are computed for a whole chunk of rows with array
operations, never one word at a time.  Every function works on bytes, which is
safe because all separators used here are ASCII and UTF-8 never reuses ASCII
bytes inside a longer character.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once; a longer row is a chunk of its own.
CHUNK_BYTES = 1 << 20

_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (the public splitmix64 constants)."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _stream(seed: int, n: int) -> np.ndarray:
    return _mix(np.arange(1, n + 1, dtype=np.uint64) * _U(0x9E3779B97F4A7C15) + _U(seed * 0x51ED2701 + 7))


class _Powers:
    """Powers of an odd number and of its inverse modulo 2**64, grown on demand."""

    def __init__(self, base: int) -> None:
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def __call__(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up))
            with np.errstate(over="ignore"):
                self.up = np.cumprod(np.r_[_U(1), np.full(size - 1, self.base, np.uint64)], dtype=np.uint64)
                self.down = np.cumprod(np.r_[_U(1), np.full(size - 1, self.inverse, np.uint64)], dtype=np.uint64)
        return self.up[:n], self.down[:n]


_POWERS = [_Powers(0x9E3779B97F4A7C15), _Powers(0xD1342543DE82EF95)]
_BYTES = [_stream(11, 256), _stream(29, 256)]

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Words are runs of anything but space and \t \n \v \f \r.
BLANK = np.zeros(256, bool)
BLANK[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Words are runs of 0-9, a-z (after lower-casing) and everything beyond ASCII.
NOT_ALNUM = np.ones(256, bool)
NOT_ALNUM[0x30:0x3A] = NOT_ALNUM[0x61:0x7B] = NOT_ALNUM[0x80:] = False


def row_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(offsets: np.ndarray, size: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``size`` bytes; every row is in exactly one."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + size, "right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi
        lo = hi


class Words:
    """The words of a chunk of rows.

    ``start``/``end``: byte spans in ``raw``; ``first``: for each row, the index
    of its first word, with a closing entry.
    """

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, lower: bool = False, blank: np.ndarray = BLANK) -> None:
        self.raw = LOWER[raw] if lower else raw
        self.offsets = offsets
        n = len(raw)
        word = ~blank[self.raw]
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True
        before = np.r_[False, word[:-1]] if n else word
        after = np.r_[word[1:], False] if n else word
        self.start = np.flatnonzero(word & (~before | edge[:-1]))
        self.end = np.flatnonzero(word & (~after | edge[1:])) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.count = np.diff(self.first)

    def hashes(self, seed: int = 0) -> np.ndarray:
        """A 64-bit hash of every word."""
        return span_hashes(self.raw, self.start, self.end, seed)

    def row_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.count)), self.count)


def span_hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hashes of byte spans of ``raw``."""
    up, down = _POWERS[seed](len(raw) + 1)
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTES[seed][raw] * up[: len(raw)], out=total[1:])
    h = (total[end] - total[start]) * down[start]
    return _mix(h + (end - start).astype(np.uint64))


def byte_grams(raw: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """Hash of every k-byte string of ``raw``, by its start."""
    n = len(raw) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    up, down = _POWERS[seed](len(raw) + 1)
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTES[seed][raw] * up[: len(raw)], out=total[1:])
    return _mix((total[k:] - total[:n]) * down[:n])


def grams(values: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """Hash of every run of k consecutive values (row borders are the caller's concern)."""
    n = len(values) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    up, down = _POWERS[seed](len(values) + 1)
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=total[1:])
    return _mix((total[k:] - total[:n]) * down[:n] + _U(k))


def window_argmin(values: np.ndarray, width: int) -> np.ndarray:
    """For each window of ``width`` consecutive values, the index of its leftmost minimum.

    Compares the upper 40 bits only, which still is a fixed order of values.
    """
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    if len(values) >= 1 << 24:  # the packed index has 24 bits
        half = (1 << 24) - 1
        parts = [window_argmin(values[i : i + half], width) + i for i in range(0, n, half - width + 1)]
        return np.concatenate(parts)[:n]
    low = _U((1 << 24) - 1)
    best = (values & ~low) | np.arange(len(values), dtype=np.uint64)
    done = 1
    while done < width:
        step = min(done, width - done)
        best = np.minimum(best[:-step], best[step:])
        done += step
    return (best & low).astype(np.int64)


def covered(starts: np.ndarray, length: int, size: int) -> np.ndarray:
    """Mask of ``size`` places covered by spans [s, s+length)."""
    mark = np.zeros(size + 1, np.int32)
    np.add.at(mark, starts, 1)
    np.subtract.at(mark, np.minimum(starts + length, size), 1)
    return np.cumsum(mark[:-1]) > 0


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


class Units:
    """A chunk of rows as 64-bit values (bytes or words) with O(1) span hashes.

    ``offsets`` has the rows' borders in ``values``; two seeds give independent
    hashes, so a pair of spans or seeds is a 128-bit name.
    """

    def __init__(self, values: np.ndarray, offsets: np.ndarray) -> None:
        self.values, self.offsets = values, offsets
        self._total: dict[int, np.ndarray] = {}

    def _sums(self, seed: int) -> tuple[np.ndarray, np.ndarray]:
        up, down = _POWERS[seed](len(self.values) + 1)
        if seed not in self._total:
            total = np.zeros(len(self.values) + 1, np.uint64)
            np.cumsum(self.values * up[: len(self.values)], out=total[1:])
            self._total[seed] = total
        return self._total[seed], down

    def grams(self, k: int, seed: int = 0) -> np.ndarray:
        n = len(self.values) - k + 1
        if n <= 0:
            return np.zeros(0, np.uint64)
        total, down = self._sums(seed)
        return _mix((total[k:] - total[:n]) * down[:n])

    def spans(self, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
        total, down = self._sums(seed)
        return _mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))

    def runs(self, window: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Windows of each row, gathered by the k-gram that is their leftmost minimum.

        Returns for each run of windows: first start, last start, row, hash of
        the gram, start of the gram.  Equal windows have equal grams wherever they stand, so a
        window whose gram occurs nowhere else is itself unique.
        """
        none = np.zeros(0, np.int64)
        g = self.grams(k)
        at = window_argmin(g, window - k + 1)
        if len(at) == 0:
            return none, none, none, np.zeros(0, np.uint64), none
        row = np.repeat(np.arange(len(self.offsets) - 1), np.diff(self.offsets))[: len(at)]
        ok = np.arange(len(at)) + window <= self.offsets[1:][row]
        s = np.flatnonzero(ok)
        if len(s) == 0:
            return none, none, none, np.zeros(0, np.uint64), none
        q = at[s]
        cut = np.flatnonzero((q[1:] != q[:-1]) | (s[1:] != s[:-1] + 1)) + 1
        lo, hi = np.r_[0, cut], np.r_[cut, len(s)] - 1
        return s[lo], s[hi], row[s[lo]], g[q[lo]], q[lo]


def byte_units(raw: np.ndarray, offsets: np.ndarray) -> Units:
    return Units(_BYTES[0][raw], offsets)


def word_units(words: Words) -> Units:
    return Units(words.hashes(), words.first)
