"""Vectorised word and shingle hashing over Arrow string columns (numpy, inside tasks).

A column is cut into slices of about a megabyte so that the 8-byte work arrays stay small whatever the
length of a text; one longer text makes a slice of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
SHINGLE = 5

_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE[65:91] = _BYTE[97:123]  # A-Z hash as a-z
_WHITE = np.zeros(256, bool)
_WHITE[[0x20, *range(0x09, 0x0E)]] = True
_BASE = 0x9E3779B97F4A7C15
_BASE_INV = pow(_BASE, -1, 2**64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_POW: dict[str, np.ndarray] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "p" not in _POW or len(_POW["p"]) < n:
        size = max(n, SLICE_BYTES + 1)
        _POW["p"], _POW["i"] = _powers(_BASE, size), _powers(_BASE_INV, size)
    return _POW["p"], _POW["i"]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def column_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if col.null_count:
        col = col.fill_null("")
    wide = pa.types.is_large_string(col.type)
    _, offsets, data = col.buffers()
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw, off


def slices(off: np.ndarray) -> Iterator[tuple[int, int]]:
    """Row ranges of about SLICE_BYTES bytes."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + SLICE_BYTES, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def words(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of each word ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased, in order."""
    lo, hi = int(off[0]), int(off[-1])
    b = raw[lo:hi]
    if not len(b):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    rel = off - lo
    ink = ~_WHITE[b]
    edge = np.zeros(len(b) + 1, bool)  # a text begins here
    edge[rel[:-1]] = True
    edge[-1] = True
    before = np.empty(len(b), bool)
    before[0], before[1:] = False, ink[:-1]
    start = np.flatnonzero(ink & (~before | edge[:-1]))
    after = np.empty(len(b), bool)
    after[-1], after[:-1] = False, ink[1:]
    end = np.flatnonzero(ink & (~after | edge[1:])) + 1
    p, inv = _power_tables(len(b) + 1)
    total = np.zeros(len(b) + 1, np.uint64)
    np.cumsum(_BYTE[b] * p[: len(b)], out=total[1:])
    h = mix((total[end] - total[start]) * inv[start] + (end - start).astype(np.uint64))
    return np.searchsorted(rel, start, "right") - 1, h


def shingles(raw: np.ndarray, off: np.ndarray, width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the distinct shingles of each text, sorted by row and hash.

    A text of fewer words than ``width`` has its whole word sequence as one shingle; one without words has none.
    """
    row, w = words(raw, off)
    n = len(off) - 1
    if not len(w):
        return row, w
    count = np.bincount(row, minlength=n)
    k = np.uint64(0xD6E8FEB86659FD93)
    out_row, out = [], []
    if len(w) >= width:
        h = w[: len(w) - width + 1].copy()
        for j in range(1, width):
            h = h * k + w[j : len(w) - width + 1 + j]
        whole = row[: len(w) - width + 1] == row[width - 1 :]
        out_row.append(row[: len(w) - width + 1][whole])
        out.append(mix(h[whole]))
    first = np.concatenate([[0], np.cumsum(count)])[:-1]
    for size in range(1, width):
        r = np.flatnonzero(count == size)
        if len(r):
            h = w[first[r]].copy()
            for j in range(1, size):
                h = h * k + w[first[r] + j]
            out_row.append(r)
            out.append(mix(h ^ np.uint64(size)))
    row, h = np.concatenate(out_row), np.concatenate(out)
    order = np.lexsort((h, row))
    row, h = row[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    return row[new], h[new]
