"""Bulk text kernels over Arrow string columns.

Words are the runs of bytes other than ``\\x20 \\x09-\\x0D``, with A-Z lower-cased. All words of a
block are found and hashed by whole-array numpy steps, so the cost is a few nanoseconds a byte and
no Python object is made per word. A word's 64-bit hash is a polynomial in its bytes, taken from one
running sum over the block, then mixed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
BLOCK_BYTES = 1 << 20
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Separators of words without punctuation: every ASCII character but letters and digits.
PUNCTUATION = np.array([i < 128 and not chr(i).isalnum() for i in range(256)])
_powers: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _power(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, by doubling; the longest table up to one block is kept."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, BLOCK_BYTES)
        have = np.ones(1, dtype=U64)
        while len(have) < size:
            have = np.concatenate([have, have * U64(pow(base, len(have), 1 << 64))])
        have = have[:size]
        if size <= 4 * BLOCK_BYTES:
            _powers[base] = have
    return have[:n]


def blocks(table: pa.RecordBatch, column: str, most: int = BLOCK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of at most ``most`` bytes of text (one row at least): the slice, its bytes, its n + 1 offsets. Null counts as empty."""
    text = pc.fill_null(table.column(table.schema.get_field_index(column)).cast(pa.large_string()), "")
    if not len(text):
        return
    offsets = np.frombuffer(text.buffers()[1], dtype=np.int64)[text.offset : text.offset + len(text) + 1]
    data = np.frombuffer(text.buffers()[2], dtype=np.uint8) if text.buffers()[2] else np.zeros(0, np.uint8)
    at = 0
    while at < len(text):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield table.slice(at, to - at), data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


@dataclass
class Words:
    """The words of a block: byte range, row and hash of each; row i has words first[i] to first[i + 1]."""

    start: np.ndarray
    end: np.ndarray
    row: np.ndarray
    hash: np.ndarray
    first: np.ndarray


def words(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray = _SPACE) -> Words:
    n, rows = len(data), len(offsets) - 1
    if not n:
        none = np.zeros(0, np.int64)
        return Words(none, none, none, np.zeros(0, U64), np.zeros(rows + 1, np.int64))
    solid = ~separators[data]
    before, after = np.empty(n, bool), np.empty(n, bool)
    before[0], before[1:] = True, ~solid[:-1]
    after[-1], after[:-1] = True, ~solid[1:]
    inner = offsets[(offsets > 0) & (offsets < n)]
    before[inner] = True
    after[inner - 1] = True
    start = np.flatnonzero(solid & before)
    end = np.flatnonzero(solid & after) + 1
    run = np.zeros(n + 1, dtype=U64)
    np.cumsum((_LOWER[data].astype(U64) + U64(1)) * _power(_BASE, n), out=run[1:])
    hashed = mix((run[end] - run[start]) * _power(_INVERSE, n)[start])
    first = np.searchsorted(start, offsets)
    row = np.repeat(np.arange(rows), np.diff(first))
    return Words(start, end, row, hashed, first)


def weights(k: int, seed: int = 1) -> np.ndarray:
    """k odd 64-bit multipliers."""
    return mix(np.arange(1, k + 1, dtype=U64) * U64(_BASE) + U64(seed)) | U64(1)


def grams(hashes: np.ndarray, shifts: tuple[int, ...], seed: int = 1) -> np.ndarray:
    """For each position with room for all shifts, a hash of the words at position + shift, in order."""
    n = len(hashes) - max(shifts)
    if n <= 0:
        return np.zeros(0, U64)
    total = np.zeros(n, U64)
    for by, weight in zip(shifts, weights(len(shifts), seed), strict=True):
        total += hashes[by : by + n] * weight
    return mix(total)


def whole(at: np.ndarray, w: Words, span: int) -> np.ndarray:
    """Which gram positions lie in one row from their first to their last word."""
    return w.row[at] == w.row[at + span - 1]
