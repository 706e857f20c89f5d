"""Vectorised word hashing over Arrow text columns.

Words are ``[^\\x20\\x09-\\x0D]+``. All hashes are deterministic across processes and
machines. Texts are read straight from the Arrow buffers, in slices of bounded size;
a single text longer than a slice makes a slice of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa

SLICE_BYTES = 2 << 20
_U = np.uint64
_BYTE_BASE = _U(0x9E3779B97F4A7C15)
_WORD_BASE = _U(0xD6E8FEB86659FD93)


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of splitmix64."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def inverse(a: np.uint64) -> np.uint64:
    return _U(pow(int(a), -1, 1 << 64))


_BYTE_INVERSE, _WORD_INVERSE = inverse(_BYTE_BASE), inverse(_WORD_BASE)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Everything but ASCII letters and bytes of longer characters.
NOT_LETTER = ~np.array([chr(b).isalpha() if b < 128 else True for b in range(256)])
_VALUE = mix(np.arange(1, 257, dtype=np.uint64))
_VALUE_LOWER = _VALUE.copy()
_VALUE_LOWER[65:91] = _VALUE[97:123]


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base**0 .. base**(n-1), modulo 2**64."""
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


@dataclass
class Words:
    """The words of a slice of rows. ``first[i]:first[i+1]`` are the words of row i."""

    rows: slice
    data: np.ndarray
    text_at: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    hashes: np.ndarray
    prefixes: list[np.ndarray] = field(default_factory=list)
    without_last: np.ndarray | None = None

    def __len__(self) -> int:
        return len(self.first) - 1

    def row_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self)), np.diff(self.first))


def byte_column(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a text column, end to end, and each row's offset (n + 1 of them); null: empty."""
    column = column.fill_null("") if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else column
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def byte_slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """Rows in slices of at most ``most`` bytes (or one row): rows, bytes, offsets."""
    if not len(column):
        return
    data, at = byte_column(column)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + most, "right")) - 1)
        yield slice(lo, hi), data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
        lo = hi


def words(column: pa.Array, lower: bool = False, most: int = SLICE_BYTES, between: np.ndarray = _SPACE, prefixes: tuple[int, ...] = (), without_last: bool = False) -> Iterator[Words]:
    """The words of each slice of a text column, with a 64-bit hash of each word's bytes.

    between: which bytes part words. prefixes: lengths in bytes; for each, hashes of the words'
    beginnings (0 for a word that is not longer). without_last: also hash each word less its last byte.
    """
    for rows, data, at in byte_slices(column, most):
        n = len(data)
        if not n:
            none = np.zeros(0, np.int64)
            yield Words(rows, data, at, none, none, np.zeros(len(at), np.int64), none.astype(np.uint64), [none.astype(np.uint64) for _ in prefixes])
            continue
        space = between[data]
        edge = at[:-1][at[:-1] < n]
        before = np.empty(n, bool)
        before[0], before[1:] = True, space[:-1]
        before[edge] = True
        after = np.empty(n, bool)
        after[-1], after[:-1] = True, space[1:]
        after[edge[edge > 0] - 1] = True
        start = np.flatnonzero(~space & before)
        end = np.flatnonzero(~space & after) + 1
        value = (_VALUE_LOWER if lower else _VALUE)[data]
        value *= powers(_BYTE_BASE, n)
        total = np.empty(n + 1, np.uint64)
        total[0] = 0
        np.cumsum(value, out=total[1:])
        back = powers(_BYTE_INVERSE, n)[start]
        hashes = mix((total[end] - total[start]) * back ^ (end - start).astype(np.uint64))
        short = [np.where(start + k < end, mix((total[np.minimum(start + k, n)] - total[start]) * back + _U(k)), _U(0)) for k in prefixes]
        less = mix((total[end - 1] - total[start]) * back ^ (end - 1 - start).astype(np.uint64)) if without_last else None
        yield Words(rows, data, at, start, end, np.searchsorted(start, at), hashes, short, less)


def rolling(hashes: np.ndarray, k: int) -> np.ndarray:
    """A hash of hashes[i:i+k] for each i; windows may run over row ends, which callers leave out."""
    n = len(hashes)
    if n < k:
        return np.zeros(0, np.uint64)
    total = np.empty(n + 1, np.uint64)
    total[0] = 0
    np.cumsum(hashes * powers(_WORD_BASE, n), out=total[1:])
    return mix((total[k:] - total[:-k]) * powers(_WORD_INVERSE, n - k + 1))


def inside(first: np.ndarray, k: int) -> np.ndarray:
    """For rolling(): which windows of k lie in one row."""
    n = int(first[-1])
    if n < k:
        return np.zeros(0, bool)
    size = np.diff(first)
    last = np.repeat(first[1:], size)[: n - k + 1]
    return np.arange(n - k + 1) + k <= last
