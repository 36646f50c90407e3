"""Vectorised text kernels shared by the operators of this subpackage.

All of them work on Arrow string columns in slices of bounded size, straight
on the UTF-8 bytes; nothing here loops over words in Python.

A *word* is a maximal run of ASCII letters, ASCII digits and bytes of
non-ASCII characters of the lower-cased text.  A null text counts as an empty
one and has no words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

SLICE_BYTES = 2_000_000
_LONG_WORD = 64
_K1, _K2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
_MASKS = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [2**64 - 1], dtype=np.uint64)

_NONE, _LINE = pa.scalar("", pa.large_string()), pa.scalar("\n", pa.large_string())

WORD_BYTE = np.zeros(256, dtype=bool)
WORD_BYTE[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * _K2
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def mix_int(x: int) -> int:
    """``mix`` of one Python integer."""
    return int(mix(np.array([x & (2**64 - 1)], dtype=np.uint64))[0])


def as_strings(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """One contiguous large_string array without nulls."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.fill_null(column.cast(pa.large_string()), "")


def buffers(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (one more than rows; the first may exceed 0)."""
    n = len(strings)
    _, offs, data = strings.buffers()
    offsets = np.frombuffer(offs, dtype=np.int64, count=strings.offset + n + 1)[strings.offset :] if offs is not None and n else np.zeros(n + 1, dtype=np.int64)
    return (np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)), offsets


def slices(strings: pa.Array, size: int = SLICE_BYTES) -> Iterator[tuple[int, pa.Array]]:
    """(first row, rows) of at most ``size`` bytes each; a longer text stands alone."""
    _, offsets = buffers(strings)
    at, n = 0, len(strings)
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + size, side="right")) - 1
        to = min(n, max(at + 1, to))
        yield at, strings.slice(at, to - at)
        at = to


@dataclass(slots=True)
class Words:
    """Words of a slice: hash, row and byte range in ``data`` of each."""

    hash: np.ndarray
    row: np.ndarray
    start: np.ndarray
    end: np.ndarray
    data: np.ndarray
    bounds: np.ndarray  #: words of row i are bounds[i]:bounds[i + 1]


def _hash_ranges(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    padded = np.concatenate([data, np.zeros(8, dtype=np.uint8)])
    eight = np.ndarray((len(data) + 1,), dtype="<u8", buffer=padded.data, strides=(1,))
    h = length.astype(np.uint64) * _K1
    short = np.flatnonzero(length <= _LONG_WORD)
    k, active = 0, short if len(short) < len(length) else None
    while True:
        if active is None:
            at, left = start, length
        else:
            at, left = start[active] + k, length[active] - k
        value = eight[at] & _MASKS[np.minimum(left, 8)]
        if active is None:
            h = (h ^ value) * _K2
            h ^= h >> np.uint64(29)
        else:
            x = (h[active] ^ value) * _K2
            h[active] = x ^ (x >> np.uint64(29))
        k += 8
        active = np.flatnonzero((length > k) & (length <= _LONG_WORD)) if active is None else active[left > 8]
        if not len(active):
            break
    for i in np.flatnonzero(length > _LONG_WORD):
        h[i] = xxhash.xxh3_64_intdigest(data[start[i] : start[i] + length[i]].tobytes())
    return mix(h)


def words(strings: pa.Array, lower: bool = True) -> Words:
    """Words of all rows of a slice."""
    text = pc.utf8_lower(strings) if lower else strings
    text = pc.binary_join_element_wise(text, _NONE, _LINE)  # so that no word crosses rows
    data, offsets = buffers(text)
    base = int(offsets[0])
    data, offsets = data[base : int(offsets[-1])], offsets - base
    inside = np.zeros(len(data) + 1, dtype=np.int8)
    inside[1:] = WORD_BYTE[data]
    step = np.diff(inside)
    start, end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    if not len(start):
        none = np.zeros(0, dtype=np.int64)
        return Words(np.zeros(0, dtype=np.uint64), none, none, none, data, np.zeros(len(strings) + 1, dtype=np.int64))
    bounds = np.searchsorted(start, offsets)
    row = np.repeat(np.arange(len(strings)), np.diff(bounds))
    return Words(_hash_ranges(data, start, end - start), row, start, end, data, bounds)


def rolled(hashes: np.ndarray, offsets: tuple[int, ...]) -> np.ndarray:
    """Hash at i of the words at i + offsets (ascending); shorter than the input by the last of them."""
    n = len(hashes) - offsets[-1]
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = np.zeros(n, dtype=np.uint64)
    for o in offsets:
        out = (out + hashes[o : o + n]) * _K1
        out ^= out >> np.uint64(32)
    return out


def same_row(row: np.ndarray, span: int) -> np.ndarray:
    """Whether the words i and i + span are of one row, for each i that has both."""
    n = len(row) - span
    return row[:n] == row[span:] if n > 0 else np.zeros(0, dtype=bool)


def word_set(hashes: list[str]) -> np.ndarray:
    """Hashes that ``words`` gives to these single words."""
    return words(as_strings(pa.array(hashes))).hash
