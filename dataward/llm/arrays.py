"""Whole-column text kernels for Arrow batches: words, hashes and windows of many rows at once.

They run inside tasks, on slices of about a megabyte, so that memory follows the longest single text and
not the size of a batch. A null text counts as an empty one everywhere.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE = np.random.default_rng(20240611).integers(1, 1 << 63, 256, dtype=np.uint64) | _U(1)
_powers: dict[str, np.ndarray] = {}


def byte_class(*spans: tuple[int, int]) -> np.ndarray:
    """A truth table over bytes: True inside the given inclusive spans."""
    table = np.zeros(256, dtype=bool)
    for low, high in spans:
        table[low:high + 1] = True
    return table


#: Words between blanks: everything but 0x20 and 0x09-0x0D.
BLANK_WORDS = ~byte_class((0x20, 0x20), (0x09, 0x0D))
#: Words of ASCII digits and letters and of all bytes above ASCII.
PLAIN_WORDS = byte_class((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF))


def text_slices(column: pa.Array, size: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, row bounds in them) of runs of rows of about ``size`` bytes."""
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    n = len(column)
    if n == 0:
        return
    bounds = np.frombuffer(offsets, np.int64)[column.offset:column.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    low = 0
    while low < n:
        high = min(n, max(low + 1, int(np.searchsorted(bounds, bounds[low] + size, "right")) - 1))
        yield low, high, data[bounds[low]:bounds[high]], bounds[low:high + 1] - bounds[low]
        low = high


def lower(data: np.ndarray) -> np.ndarray:
    """A-Z lower-cased, all other bytes as they are."""
    return _LOWER[data]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "up" not in _powers or len(_powers["up"]) < n:
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            steps = np.full(max(n, 2 * SLICE_BYTES), base, dtype=np.uint64)
            steps[0] = 1
            _powers[name] = np.cumprod(steps, dtype=np.uint64)
    return _powers["up"], _powers["down"]


class Words:
    """The words of some rows: byte places, row of each word, first word of each row, and lazily their codes."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray, table: np.ndarray):
        inside = table[data]
        start, end = inside.copy(), inside.copy()
        start[1:] &= ~inside[:-1]
        end[:-1] &= ~inside[1:]
        edge = bounds[:-1][bounds[:-1] < len(data)]
        start[edge] = inside[edge]
        edge = edge[edge > 0] - 1
        end[edge] = inside[edge]
        self.data = data
        self.start = np.flatnonzero(start)
        self.end = np.flatnonzero(end) + 1
        self.first = np.searchsorted(self.start, bounds)
        self.counts = np.diff(self.first)
        self.row = np.repeat(np.arange(len(self.counts)), self.counts)
        self._sums: np.ndarray | None = None

    def _spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        up, down = _power(len(self.data) + 1)
        if self._sums is None:
            self._sums = np.zeros(len(self.data) + 1, dtype=np.uint64)
            np.cumsum(_BYTE[self.data] * up[:len(self.data)], out=self._sums[1:])
        return mix((self._sums[end] - self._sums[start]) * down[start])

    def codes(self) -> np.ndarray:
        """A 64-bit hash of each word."""
        return self._spans(self.start, self.end)

    def prefixes(self, n: int) -> np.ndarray:
        """A 64-bit hash of the first ``n`` bytes of each word, shorter words whole."""
        return self._spans(self.start, np.minimum(self.start + n, self.end))


def windows(codes: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(first word, hash) of all runs of ``n`` words inside one row."""
    m = len(codes) - n + 1
    if m <= 0:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    total = np.zeros(m, dtype=np.uint64)
    weight = 1
    for j in range(n):
        weight = weight * _BASE % (1 << 64)
        total += codes[j:j + m] * _U(weight)
    whole = row[:m] == row[n - 1:]
    return np.flatnonzero(whole), mix(total[whole] + _U(n))


def sequence_hash(codes: np.ndarray) -> np.uint64:
    """The hash that ``windows`` gives to a run of exactly these words."""
    return windows(codes, np.zeros(len(codes), np.int64), len(codes))[1][0]


def shingle_sets(data: np.ndarray, bounds: np.ndarray, table: np.ndarray, n: int) -> list[np.ndarray]:
    """Sorted distinct hashes of the ``n``-word shingles of each row.

    A row with fewer words has its whole sequence as the one shingle; a row without words has none.
    """
    words = Words(lower(data), bounds, table)
    codes = words.codes()
    at, hashes = windows(codes, words.row, n)
    cut = np.searchsorted(at, words.first)
    out = []
    for i, count in enumerate(words.counts):
        if count >= n:
            out.append(np.unique(hashes[cut[i]:cut[i + 1]]))
        elif count:
            out.append(np.array([sequence_hash(codes[words.first[i]:words.first[i + 1]])], dtype=np.uint64))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def signed(x: np.ndarray) -> pa.Array:
    """Unsigned hashes as the long column that Spark knows."""
    return pa.array(x.view(np.int64))


def list_array(values: np.ndarray, counts) -> pa.Array:
    """Rows of a list column from flat values and row lengths."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(values))
