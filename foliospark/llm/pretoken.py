"""Pre-tokenisation of a byte-level BPE, whole Arrow slices at a time, and the two piece tables built on it.

The pattern is the public 50k vocabulary's:
``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+``.
Its pieces follow from runs of four character classes, so they are found with array
operations; each distinct piece is then looked up, or encoded once per worker.
"""

from __future__ import annotations

import base64
import functools
import unicodedata

import numpy as np
import pyarrow as pa

from .arrowtext import column_bytes, span_hashes

DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_SPACES = [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


@functools.cache
def _classes() -> np.ndarray:
    """0 white space, 1 letter, 2 number, 3 other, for every code point."""
    out = np.full(0x110000, 3, np.uint8)
    for cp in range(0x110000):
        c = unicodedata.category(chr(cp))[0]
        if c == "L":
            out[cp] = 1
        elif c == "N":
            out[cp] = 2
    out[_SPACES] = 0
    return out


@functools.lru_cache(4)
def encoding(path: str):
    """(tiktoken encoding, ranks) of a vocabulary file."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), ranks


def code_points(column) -> tuple[str, np.ndarray, np.ndarray]:
    """All texts of a column as one string, its code points, and where each text begins (one entry more)."""
    raw, offsets = column_bytes(column)
    lead = np.zeros(len(raw) + 1, np.int64)
    np.cumsum((raw & 0xC0) != 0x80, out=lead[1:])
    text = raw.tobytes().decode("utf-8")
    return text, np.frombuffer(text.encode("utf-32-le"), np.uint32), lead[offsets]


def pieces(cp: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of all pieces, and [start, end) of the white-space runs that a non-space follows and that
    hold more than one character (a prefix that ends with such a run keeps it in one piece)."""
    n = len(cp)
    z = np.empty(0, np.int64)
    if not n:
        return z, z, z
    cls = _classes()[cp]
    first = np.zeros(n + 1, bool)
    first[begins] = True
    run = first[:n].copy()
    run[1:] |= cls[1:] != cls[:-1]
    mark = run & (cls == 0)
    word = np.flatnonzero(run & (cls != 0))
    inner = word[~first[word]]
    after = inner[cls[inner - 1] == 0]
    mark[word] = True
    mark[after - 1] = True
    mark[after[cp[after - 1] == 0x20]] = False

    quote = np.flatnonzero((cp == 0x27) & run & mark[:n])
    quote = quote[quote + 1 < n]
    quote = quote[(cls[quote + 1] == 1) & ~first[quote + 1]]
    if len(quote):
        one = cp[quote + 1]
        two = cp[np.minimum(quote + 2, n - 1)]
        joined = (quote + 2 < n) & ~first[np.minimum(quote + 2, n)]
        short = np.isin(one, [0x73, 0x74, 0x6D, 0x64])
        long = joined & (((one == 0x72) & (two == 0x65)) | ((one == 0x76) & (two == 0x65)) | ((one == 0x6C) & (two == 0x6C)))
        for hit, width in ((quote[short], 2), (quote[long & ~short], 3)):
            mark[hit + 1] = False
            nxt = hit + width
            nxt = nxt[nxt < n]
            nxt = nxt[(cls[nxt] == 1) & ~first[nxt]]
            mark[nxt] = True
    space = np.flatnonzero(run & (cls == 0))
    edge = np.flatnonzero(run)
    stop = np.append(edge, n)[np.searchsorted(edge, space, "right")]
    keep = (stop - space > 1) & ~first[stop]
    return np.flatnonzero(mark), space[keep], stop[keep]


class PieceCounts:
    """Token counts of pieces by their hash; the least used half goes when more than `limit` are held."""

    def __init__(self, path: str, limit: int = 3_000_000):
        self.enc, self.ranks = encoding(path)
        self.limit = limit
        self.keys, self.counts = np.empty(0, np.uint64), np.empty(0, np.int32)

    def measure(self, piece: str) -> int:
        return len(self.enc._encode_single_piece(piece))

    def of(self, text: str, cp: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        if not len(starts):
            return np.empty(0, np.int32)
        keys, where, back = np.unique(span_hashes(cp, starts, ends), return_index=True, return_inverse=True)
        at = np.searchsorted(self.keys, keys)
        at[at == len(self.keys)] = 0
        known = self.keys[at] == keys if len(self.keys) else np.zeros(len(keys), bool)
        found = np.empty(len(keys), np.int32)
        found[known] = self.counts[at[known]]
        new = np.flatnonzero(~known)
        if len(new):
            a, b = starts[where[new]].tolist(), ends[where[new]].tolist()
            found[new] = [self.measure(text[i:j]) for i, j in zip(a, b)]
            if len(self.keys) + len(new) > self.limit:
                self.keys, self.counts = keys, found
            else:
                self.keys, self.counts = np.concatenate([self.keys, keys[new]]), np.concatenate([self.counts, found[new]])
                order = np.argsort(self.keys)
                self.keys, self.counts = self.keys[order], self.counts[order]
        return found[back]


@functools.lru_cache(2)
def piece_counts(path: str) -> PieceCounts:
    return PieceCounts(path)


def token_totals(column, path: str) -> np.ndarray:
    """The exact number of tokens of every text of an Arrow column; 0 for null or empty ones."""
    text, cp, begins = code_points(column)
    starts, _, _ = pieces(cp, begins)
    counts = piece_counts(path).of(text, cp, starts, np.append(starts[1:], len(cp)))
    total = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(counts, out=total[1:])
    bound = np.searchsorted(starts, begins)
    return total[bound[1:]] - total[bound[:-1]]
