"""Vectorised text primitives over Arrow string columns.

A batch of texts is one UTF-8 byte buffer plus offsets; every function here works
on whole buffers with numpy, so a Python worker never loops over characters.

*Word*: a maximal run of ASCII letters, digits, underscore or any non-ASCII byte,
case-folded for ASCII and Latin-1.  A document boundary always ends a word.
Null texts count as empty.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
_C = ctypes.CDLL(None)
_R = 0x9E3779B97F4A7C15 | 1
_R_INV = pow(_R, -1, 1 << 64)
_BLOCK = 1 << 19

_WORD = np.zeros(256, bool)
for _c in range(256):
    _WORD[_c] = _c >= 0x80 or chr(_c).isalnum() or _c == 0x5F
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse modulo 2^64, at least n of each."""
    size = max(_BLOCK, 1 << max(1, int(n)).bit_length())
    if size not in _powers:
        out = []
        for base in (_R, _R_INV):
            p = np.empty(size, U64)
            p[0] = 1
            filled, step = 1, base
            while filled < size:
                m = min(filled, size - filled)
                p[filled : filled + m] = p[:m] * U64(step)
                filled += m
                step = pow(base, filled, 1 << 64)
            out.append(p)
        if size > _BLOCK:
            return out[0], out[1]
        _powers[size] = (out[0], out[1])
    return _powers[size]


def mix(h: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    h = h ^ (h >> U64(30))
    h = h * U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h *= U64(0x94D049BB133111EB)
    h ^= h >> U64(31)
    return h


def column_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow string column; nulls become empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_null(column.type):
        column = column.cast(pa.string())
    if column.null_count:
        column = pc.fill_null(column, "")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    n = len(column)
    if not n:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, kind)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def trim() -> None:
    """Gives memory that is free back to the system, as workers live from stage to stage; where the C library can."""
    if hasattr(_C, "malloc_trim"):
        _C.malloc_trim(0)


def slices(batch: pa.RecordBatch, column: str, limit: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """The batch cut into row ranges of about `limit` bytes of text each (a longer text stands alone)."""
    n = batch.num_rows
    if not n:
        return
    _, offsets = column_bytes(batch.column(batch.schema.get_field_index(column)))
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        hi = min(hi, lo + 65535)  # row numbers within a slice fit 16 bits
        yield batch.slice(lo, min(hi, n) - lo)
        lo = min(hi, n)
    trim()


def fold_case(raw: np.ndarray) -> np.ndarray:
    """ASCII and Latin-1 letters in lower case, length unchanged."""
    low = _LOWER[raw]
    lead = np.flatnonzero(raw[:-1] == 0xC3)
    if len(lead):
        nxt = raw[lead + 1]
        up = lead[(nxt >= 0x80) & (nxt <= 0x9E) & (nxt != 0x97)] + 1
        low[up] += 32
    return low


def word_spans(raw: np.ndarray, offsets: np.ndarray, table: np.ndarray = _WORD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word starts and ends (byte positions) and, per document, the index of its first word (one entry more at the end)."""
    n = len(raw)
    if not n:
        z = np.empty(0, np.int64)
        return z, z, np.zeros(len(offsets), np.int64)
    inside = table[raw]
    start = inside.copy()
    start[1:] &= ~inside[:-1]
    cut = offsets[1:-1]
    cut = cut[cut < n]
    start[cut] = inside[cut]
    end = np.empty(n + 1, bool)
    end[0] = False
    end[1:n] = inside[:-1] & ~inside[1:]
    end[n] = inside[-1]
    cut = cut[cut > 0]
    end[cut] = inside[cut - 1]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end)
    return starts, ends, np.searchsorted(starts, offsets)


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit polynomial hash of values[start:end] for sorted, possibly overlapping spans."""
    out = np.empty(len(starts), U64)
    lo = 0
    while lo < len(starts):
        base = starts[lo]
        hi = max(lo + 1, int(np.searchsorted(starts, base + _BLOCK // 2)))
        top = int(ends[lo:hi].max())
        p, inv = powers(top - base + 1)
        total = np.zeros(top - base + 1, U64)
        np.cumsum((values[base:top].astype(U64) + U64(1)) * p[: top - base], out=total[1:])
        s, e = starts[lo:hi] - base, ends[lo:hi] - base
        out[lo:hi] = mix((total[e] - total[s]) * inv[s] + (ends[lo:hi] - starts[lo:hi]).astype(U64) * U64(0xD6E8FEB86659FD93))
        lo = hi
    return out


def hashed_words(column) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(word hashes, starts, ends, first word of each document, document bytes' offsets)."""
    raw, offsets = column_bytes(column)
    starts, ends, first = word_spans(raw, offsets)
    return span_hashes(fold_case(raw), starts, ends), starts, ends, first, offsets


def gram_hashes(words: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the n-grams of words that lie within one document, the position of each and, per document,
    the index of its first gram.  A document of fewer than n words has none."""
    lengths = np.maximum(np.diff(first) - n + 1, 0)
    starts = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=starts[1:])
    at = np.repeat(first[:-1] - starts[:-1], lengths) + np.arange(starts[-1])
    if not len(at):
        return np.empty(0, U64), at, starts
    if n <= 4:
        h = np.zeros(len(at), U64)
        for j in range(n):
            h = h * U64(_R) + words[at + j]
        return mix(h), at, starts
    return span_hashes(words, at, at + n), at, starts
