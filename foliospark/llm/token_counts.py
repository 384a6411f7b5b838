"""Exact token counts at every prefix of every text.

For each text the column `steps` holds one signed byte per character: how many tokens the
prefix that ends there has more (or, after a merge, fewer) than the one before.  Running sums
answer "how many tokens do the first n characters have" and "how many characters fit into b
tokens" without encoding anything again.

Within a piece of the pre-tokeniser the counts come from dynamic programming over prefixes:
the encoding of a prefix is that of a shorter prefix and one last token, the longest token
that ends there and is compatible with the last token of the prefix it follows.  Whole
pieces are looked up once a worker knows them.

Defined cases: a null or empty text has no steps and 0 tokens.  A row without doc_id keeps its
row, and repeated rows keep theirs; other columns are not read.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrowtext import slices, span_hashes
from .pretoken import DEFAULT_VOCABULARY, code_points, encoding, pieces
from .shared import output_schema


class PrefixEncoder:
    """Token counts of all prefixes of one piece."""

    def __init__(self, path: str, memo: int = 300_000):
        self.enc, self.ranks = encoding(path)
        self.longest = max(map(len, self.ranks))
        self.memo, self.known, self.pairs = memo, {b"": (0, 0)}, {}

    def _follows(self, left: bytes, right: bytes) -> bool:
        got = self.pairs.get((left, right))
        if got is None:
            if len(self.pairs) > 2 * self.memo:
                self.pairs.clear()
            got = self.pairs[left, right] = self.enc._encode_single_piece(left + right) == [self.ranks[left], self.ranks[right]]
        return got

    def steps(self, piece: str) -> bytes:
        """One signed byte per character of a piece."""
        if len(self.known) > self.memo:
            self.known = {b"": (0, 0)}
        data, ends = piece.encode(), []
        at = 0
        for c in piece:
            at += 1 if c < "\x80" else len(c.encode())
            ends.append(at)
        known, ranks, small = self.known, self.ranks, len(data) <= 48
        counts, lasts = [0], [0]
        for k in range(1, len(data) + 1):
            head = data[:k] if small else b""
            got = known.get(head) if small else None
            if got is None:
                for j in range(max(0, k - self.longest), k):
                    token = data[j:k]
                    if token in ranks and (not j or self._follows(data[j - lasts[j] : j], token)):
                        got = counts[j] + 1, k - j
                        break
                if small:
                    known[head] = got
            counts.append(got[0])
            lasts.append(got[1])
        seen, out = 0, bytearray()
        for e in ends:
            out.append((counts[e] - seen) & 255)
            seen = counts[e]
        return bytes(out)


class PieceSteps:
    """Steps of pieces by their hash, as spans of one pool; emptied when the pool passes `limit` bytes."""

    def __init__(self, path: str, limit: int = 24_000_000):
        self.encoder, self.limit = PrefixEncoder(path), limit
        self.clear()

    def clear(self) -> None:
        self.keys, self.first, self.pool = np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int8)

    def of(self, text: str, cp: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Where in the pool the steps of each piece begin."""
        if not len(starts):
            return np.empty(0, np.int64)
        if len(self.pool) > self.limit:
            self.clear()
        keys, where, back = np.unique(span_hashes(cp, starts, ends), return_index=True, return_inverse=True)
        at = np.searchsorted(self.keys, keys)
        at[at == len(self.keys)] = 0
        known = self.keys[at] == keys if len(self.keys) else np.zeros(len(keys), bool)
        found = np.empty(len(keys), np.int64)
        found[known] = self.first[at[known]]
        new = np.flatnonzero(~known)
        if len(new):
            a, b = starts[where[new]], ends[where[new]]
            made = b"".join([self.encoder.steps(text[i:j]) for i, j in zip(a.tolist(), b.tolist())])
            begin = len(self.pool) + np.cumsum(b - a) - (b - a)
            found[new] = begin
            self.pool = np.concatenate([self.pool, np.frombuffer(made, np.int8)])
            self.keys, self.first = np.concatenate([self.keys, keys[new]]), np.concatenate([self.first, begin])
            order = np.argsort(self.keys)
            self.keys, self.first = self.keys[order], self.first[order]
        return found[back]


@functools.lru_cache(2)
def _piece_steps(path: str) -> PieceSteps:
    return PieceSteps(path)


def prefix_steps(column, path: str) -> tuple[np.ndarray, np.ndarray]:
    """(steps of all texts, where each text's begin)."""
    text, cp, begins = code_points(column)
    if not len(cp):
        return np.empty(0, np.int8), begins
    starts, space, stop = pieces(cp, begins)
    ends = np.append(starts[1:], len(cp))
    table = _piece_steps(path)
    from_pool = table.of(text, cp, starts, ends)
    steps = table.pool[np.repeat(from_pool - starts, ends - starts) + np.arange(len(cp))]
    if len(space):
        # A prefix that ends with the last character of a white-space run still has the run in one piece.
        one = steps.astype(np.int64)
        whole = table.of(text, cp, space, stop)
        pool = np.zeros(len(table.pool) + 1, np.int64)
        np.cumsum(table.pool, out=pool[1:])
        total = np.zeros(len(cp) + 1, np.int64)
        np.cumsum(one, out=total[1:])
        more = (pool[whole + (stop - space)] - pool[whole]) - (total[stop] - total[space])
        one[stop - 1] += more
        one[stop] -= more
        steps = one.astype(np.int8)
    return steps, begins


def _runner(path: str, budgets: tuple[int, ...]):
    def run(batches):
        for batch in batches:
            for part in slices(batch, "text", 2 << 20):
                steps, begins = prefix_steps(part.column(1), path)
                total = np.zeros(len(steps) + 1, np.int64)
                np.cumsum(steps, out=total[1:])
                n = total[begins[1:]] - total[begins[:-1]]
                fit = np.zeros((len(budgets), len(n)), np.int64)
                for i, (a, b) in enumerate(zip(begins[:-1].tolist(), begins[1:].tolist())):
                    here = total[a : b + 1] - total[a]
                    for k, budget in enumerate(budgets):
                        fit[k, i] = b - a if n[i] <= budget else len(here) - 1 - int(np.argmax(here[::-1] <= budget))
                binary = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(begins.astype(np.int32)), pa.py_buffer(steps)])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(begins)), pa.array(n), *map(pa.array, fit), binary], names=["doc_id", "n_chars", "n_tokens", *(f"chars_in_{b}" for b in budgets), "steps"])

    return run


def prefix_token_counts(docs: DataFrame, vocabulary: str = DEFAULT_VOCABULARY, budgets: tuple[int, ...] = (512, 2048)) -> DataFrame:
    """doc_id, n_chars, n_tokens, the length of the longest prefix within each budget, and `steps`."""
    src = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    fit = "".join(f", chars_in_{b} bigint" for b in budgets)
    return src.mapInArrow(_runner(vocabulary, budgets), output_schema(src, ["doc_id"], f"n_chars bigint, n_tokens bigint{fit}, steps binary"))


@F.pandas_udf(T.LongType())
def _tokens_in(steps, n):
    import pandas as pd

    return pd.Series([None if s is None or k is None else int(np.frombuffer(s, np.int8)[: max(0, int(k))].sum(dtype=np.int64)) for s, k in zip(steps, n)], dtype="Int64")


@F.pandas_udf(T.LongType())
def _chars_within(steps, budget):
    import pandas as pd

    out = []
    for s, b in zip(steps, budget):
        if s is None or b is None:
            out.append(None)
            continue
        total = np.append(0, np.cumsum(np.frombuffer(s, np.int8), dtype=np.int64))
        out.append(len(total) - 1 - int(np.argmax(total[::-1] <= b)) if b >= 0 else 0)
    return pd.Series(out, dtype="Int64")


def tokens_in_prefix(steps: Column, n: Column) -> Column:
    """Tokens of the first n characters."""
    return _tokens_in(steps, n)


def longest_prefix_within(steps: Column, budget: Column) -> Column:
    """Characters of the longest prefix of at most `budget` tokens."""
    return _chars_within(steps, budget)
