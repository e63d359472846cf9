"""Words, hashes and byte classes of whole Arrow batches, without one Python object per word."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

MASK = (1 << 64) - 1
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
SLICE_BYTES = 1 << 20


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base & MASK, dtype=np.uint64)
    if n:
        out[0] = 1
        np.multiply.accumulate(out, out=out)
    return out


def mix(h: np.ndarray) -> np.ndarray:
    """The finaliser of a 64-bit hash."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and where each row begins and ends; null counts as empty."""
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def slices(at: np.ndarray, most: int = SLICE_BYTES):
    """Ranges of rows of about ``most`` bytes, so that work space stays bounded."""
    first, n = 0, len(at) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(at, at[first] + most, "right")) - 1)
        yield first, last
        first = last


class Runs:
    """Maximal runs of bytes of a kind, cut at row ends, with a 64-bit hash of each run.

    ``kind`` maps a byte to its class; class 0 separates. Neighbours of different classes are
    different runs. ``fold`` maps bytes before they are hashed (for instance to lower case).
    """

    def __init__(self, data: np.ndarray, at: np.ndarray, kind: np.ndarray, fold: np.ndarray | None = None):
        n = len(data)
        self.kinds = kind[data]
        new = np.empty(n + 1, bool)
        new[1:n] = self.kinds[1:] != self.kinds[:-1]
        new[0] = new[n] = True
        new[at[:-1][at[:-1] < n]] = True
        edges = np.flatnonzero(new) if n else np.zeros(1, np.int64)
        begin, end = edges[:-1], edges[1:]
        keep = self.kinds[begin] != 0 if n else np.zeros(0, bool)
        self.begin, self.end = begin[keep], end[keep]
        self.kind = self.kinds[self.begin] if n else np.zeros(0, np.uint8)
        # where the runs of each row begin
        self.rows = np.searchsorted(self.begin, at)
        folded = (fold[data] if fold is not None else data).astype(np.uint64)
        folded += np.uint64(1)
        folded *= powers(BASE, n)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(folded, out=total[1:])
        inverse = powers(INVERSE, n)
        h = (total[self.end] - total[self.begin]) * (inverse[self.begin] if n else np.zeros(0, np.uint64))
        self.hash = mix(h + (self.end - self.begin).astype(np.uint64))




SPACES = bytes([0x20, *range(0x09, 0x0E)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
WORD = np.ones(256, np.uint8)
WORD[list(SPACES)] = 0


def hash_words(words: list[str]) -> np.ndarray:
    """The hashes that ``Runs`` gives to these words alone."""
    raw = [w.encode() for w in words]
    at = np.cumsum([0, *map(len, raw)])
    whole = Runs(np.frombuffer(b"".join(raw), np.uint8), at, np.ones(256, np.uint8))
    return whole.hash


def row_sums(values: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Sum of ``values`` of each row, zero for rows without any."""
    total = np.zeros((len(values) + 1, *values.shape[1:]), np.float64)
    np.cumsum(values, axis=0, out=total[1:])
    return total[rows[1:]] - total[rows[:-1]]
