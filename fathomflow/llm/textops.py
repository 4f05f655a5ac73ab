"""Vectorised text kernels shared by the operators: Arrow string columns are read as one byte buffer and
cut into words with NumPy, so that no Python object is made per word.

A word is a maximal run of bytes other than ``\\x20`` and ``\\x09-\\x0D``; case folding touches A-Z alone.
Nulls are empty texts. A chunk holds whole documents and about ``limit`` bytes, or one longer document.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

from .workers import cached

CHUNK_BYTES = 1 << 19

SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32

_BASE = 0x9E3779B97F4A7C15 | 1


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words with good avalanche (the splitmix64 finaliser)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE_VALUE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))
_POWERS: dict[str, np.ndarray] = {}
cached("powers", _POWERS.clear)


def _powers(n: int, inverse: bool) -> np.ndarray:
    """The first n powers of the hash base (or of its inverse) modulo 2**64."""
    key = "inverse" if inverse else "plain"
    have = _POWERS.get(key)
    if have is None or len(have) < n:
        base = pow(_BASE, -1, 1 << 64) if inverse else _BASE
        steps = np.full(max(n, CHUNK_BYTES + 1), base, dtype=np.uint64)
        steps[0] = 1
        with np.errstate(over="ignore"):
            have = np.cumprod(steps, dtype=np.uint64)
        if len(have) <= 2 * CHUNK_BYTES + 1:
            _POWERS[key] = have
    return have[:n]


class Chunk(NamedTuple):
    """Rows lo..hi of a batch: their bytes, and where each row's bytes begin (one entry more than rows)."""

    lo: int
    hi: int
    data: np.ndarray
    offsets: np.ndarray

    def row(self, i: int) -> np.ndarray:
        return self.data[self.offsets[i] : self.offsets[i + 1]]


def text_chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """Cuts a string column into chunks of whole rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, raw_offsets, raw = column.buffers()
    offsets = np.frombuffer(raw_offsets, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1)
        yield Chunk(lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
        lo = hi


def word_spans(chunk: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and ``first``: the index of each row's first word (one entry more)."""
    solid = ~SPACE[chunk.data]
    n = len(solid)
    begins, ends = solid.copy(), solid.copy()
    if n:
        begins[1:] &= ~solid[:-1]
        ends[:-1] &= ~solid[1:]
        cuts = chunk.offsets[1:-1]
        inner = cuts[(cuts > 0) & (cuts < n)]
        begins[inner] = solid[inner]
        ends[inner - 1] = solid[inner - 1]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(ends) + 1, np.searchsorted(starts, chunk.offsets)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool = True) -> np.ndarray:
    """64-bit hashes of the given byte spans, equal for equal (case-folded) spans wherever they stand."""
    n = len(data)
    with np.errstate(over="ignore"):
        prefix = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(_BYTE_VALUE[FOLD[data] if fold else data] * _powers(n, False), out=prefix[1:])
        return mix64((prefix[ends] - prefix[starts]) * _powers(n + 1, True)[starts])


def pair_hashes(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Hashes of ordered pairs of hashes."""
    with np.errstate(over="ignore"):
        return mix64(left * np.uint64(0x9FB21C651E98DF25) + (right ^ (right >> np.uint64(29))))


def code_points(data: np.ndarray) -> np.ndarray:
    """Marks the bytes that begin a UTF-8 code point."""
    return (data & 0xC0) != 0x80
