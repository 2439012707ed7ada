"""Vectorised words, lines and hashes over Arrow text columns.

A text is cut into words at the bytes 0x20 and 0x09-0x0D.  Word and line hashes
are differences of one running polynomial sum (64-bit wrap-around), so a batch
needs a handful of numpy passes and no Python object per word; spans of more than
LONG_SPAN bytes, which are rare, are hashed one by one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes handled at once; a longer text is a block of its own.
BLOCK_BYTES = 1 << 20
#: Bytes of a span beyond which its hash is a cryptographic one.
LONG_SPAN = 512

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers: list[np.ndarray] = []


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift-multiply)."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The base's first ``n`` powers and inverse powers, kept up to twice the block size."""
    if _powers and len(_powers[0]) >= n:
        return _powers[0][:n], _powers[1][:n]
    made = []
    for base in (_BASE, _INVERSE):
        p = np.full(n, base, dtype=np.uint64)
        p[0] = 1
        made.append(np.multiply.accumulate(p))
    if n <= 2 * BLOCK_BYTES:
        _powers[:] = made
    return made[0], made[1]


def blocks(column: pa.Array | pa.ChunkedArray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of runs of rows with about BLOCK_BYTES of text; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_large_string(column.type):
        width = np.int64
    else:
        column, width = column.cast(pa.string()), np.int32
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=width)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + BLOCK_BYTES, side="right")) - 1
        to = min(n, max(at + 1, to))
        yield at, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z as a-z, all other bytes as they are."""
    return _LOWER[data]


class Words:
    """Words of a block: ``start``, ``end`` (bytes), ``doc`` (row in the block), ``first`` (by row)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        inner = ~_SPACE[data]
        begins = np.zeros(len(data) + 1, dtype=bool)  # a text begins here, or the data end
        begins[offsets] = True
        begins[-1] = True
        before, after = begins[:-1].copy(), begins[1:].copy()
        before[1:] |= ~inner[:-1]
        after[:-1] |= ~inner[1:]
        self.start = np.flatnonzero(inner & before)
        self.end = np.flatnonzero(inner & after) + 1
        self.inner = inner
        self.doc = np.searchsorted(offsets, self.start, side="right") - 1
        self.first = np.searchsorted(self.start, offsets)
        self.count = np.diff(self.first)


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span; equal spans have equal hashes wherever they stand."""
    if not len(start):
        return np.zeros(0, np.uint64)
    power, inverse = powers(len(data) + 1)
    run = np.empty(len(data) + 1, dtype=np.uint64)
    run[0] = 0
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[:-1], out=run[1:])
    h = (run[end] - run[start]) * inverse[start]
    h = mix(h + (end - start).astype(np.uint64) * np.uint64(0xA0761D6478BD642F))
    # a wrap-around sum cannot tell some very long spans apart, whatever its base: those are hashed by themselves
    for k in np.flatnonzero(end - start > LONG_SPAN).tolist():
        h[k] = int.from_bytes(hashlib.blake2b(data[start[k] : end[k]], digest_size=8).digest(), "big")
    return h


_STEP = [0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F, 0xEB44ACCAB455D165, 0x2127599BF4325C37]


def windows(hashes: np.ndarray, width: int) -> np.ndarray:
    """A hash of each run of ``width`` hashes; the caller leaves out runs that cross texts."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, dtype=np.uint64)
    for k in range(width):
        out += hashes[k : k + n] * np.uint64(_STEP[k % 5] + 2 * (k // 5))
    return mix(out)
