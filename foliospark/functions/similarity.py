"""Similarity of texts: edit distance, token sets, BLEU and indel ratio."""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import let

MIN_CHARS = 4


def tokens(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(r"(\S+)"), F.lit(1))


def long_enough(a: Column, b: Column, least: int = MIN_CHARS) -> Column:
    return (F.length(a) >= least) & (F.length(b) >= least)


def _codes(*texts: str) -> list[np.ndarray]:
    kind, width = ("ascii", np.uint8) if all(s.isascii() for s in texts) else ("utf-32-le", np.uint32)
    return [np.frombuffer(s.encode(kind, "surrogatepass"), width) for s in texts]


def _last_deltas(needle: np.ndarray, hay: np.ndarray, free: bool) -> tuple[int, int]:
    """Bits at which the last row of the table of edit distances, the needle's rows over the hay's places, rises and falls;
    each row is a few operations on integers with a bit for each place."""
    full = (1 << len(hay)) - 1
    steps = needle.tolist()
    where = {c: int.from_bytes(np.packbits(hay == c, bitorder="little").tobytes(), "little") for c in set(steps)}
    rises, falls = 0 if free else full, 0
    for c in steps:
        same = where[c]
        down = same | falls
        across = (((same & rises) + rises) ^ rises) | same
        up = (falls | (full ^ ((across | rises) & full))) << 1 | 1
        rises, falls = ((rises & across) << 1 | (full ^ ((down | up) & full))) & full, up & down & full
    return rises, falls


def edit_distance(a: str, b: str) -> int:
    """Levenshtein distance, as many steps as the shorter text has characters."""
    x, y = _codes(*sorted((a, b), key=len))
    rises, falls = _last_deltas(x, y, False)
    return len(x) + rises.bit_count() - falls.bit_count()


@F.arrow_udf(T.IntegerType())
def levenshtein(a, b):
    import pyarrow as pa

    return pa.array((None if (s := x.as_py()) is None or (t := y.as_py()) is None else edit_distance(s, t) for x, y in zip(a, b)), pa.int32())


def edit_distance_share(a: Column, b: Column) -> Column:
    """Edit distance over the greater length; null where either text is too short to judge."""
    return F.when(long_enough(a, b), levenshtein(a, b) / F.greatest(F.length(a), F.length(b)))


def set_scores(pred: Column, truth: Column) -> Column:
    """struct(precision, recall, f_measure) of the sets of tokens; null where either has none.  The sets are made once."""
    sets = F.struct(F.array_distinct(tokens(pred)).alias("p"), F.array_distinct(tokens(truth)).alias("t"))
    sizes = let(F.when(long_enough(pred, truth), sets), lambda s: F.struct(F.size(s["p"]).alias("p"), F.size(s["t"]).alias("t"), F.size(F.array_intersect(s["p"], s["t"])).alias("both")))
    shares = let(sizes, lambda n: F.struct(F.when(n["p"] > 0, n["both"] / n["p"]).alias("precision"), F.when(n["t"] > 0, n["both"] / n["t"]).alias("recall")))

    def scores(s: Column) -> Column:
        p, r = s["precision"], s["recall"]
        return F.struct(p.alias("precision"), r.alias("recall"), F.when(p + r > 0, 2 * p * r / (p + r)).when(p + r == 0, 0.0).alias("f_measure"))

    return let(shares, scores)


INLINE, DISPLAY, TABLE = r"\\\((.*?)(?<!\\)\\\)", r"\\\[(.+?)(?<!\\)\\\]", r"(?s)\\begin\{tabular\}(.+?)(?:\\end\{tabular\}|\z)"


def modalities(page: Column) -> Column:
    """struct(text, math, tables): formulae between delimiters, table bodies, and what is left."""
    inline = F.regexp_extract_all(page, F.lit(INLINE), F.lit(1))
    page = F.regexp_replace(page, INLINE, "")
    display = F.regexp_extract_all(page, F.lit(DISPLAY), F.lit(1))
    page = F.regexp_replace(page, DISPLAY, "")
    table = F.regexp_extract_all(page, F.lit(TABLE), F.lit(1))
    text = F.trim(F.regexp_replace(page, TABLE, ""))
    return F.struct(text.alias("text"), F.concat(F.array_join(inline, "\n"), F.array_join(display, "\n")).alias("math"), F.array_join(table, "\n").alias("tables"))


def bleu_score(truth: list[str], pred: list[str]) -> float:
    """Uniform weights up to 4-grams, one reference, no smoothing."""
    logs = 0.0
    for n in range(1, 5):
        want = Counter(zip(*(truth[i:] for i in range(n))))
        have = Counter(g for g in zip(*(pred[i:] for i in range(n))) if g in want)
        hit = sum(min(k, want[g]) for g, k in have.items())
        if not hit:
            return 0.0
        logs += math.log(hit / max(1, len(pred) - n + 1)) / 4
    return math.exp(logs + min(0.0, 1 - len(truth) / len(pred)))


def common_subsequence(a: str, b: str) -> int:
    """Length of the longest common subsequence, bits of an integer for a row of the table."""
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    s = full
    for c in b:
        u = s & where.get(c, 0)
        s = (s + u | s - u) & full
    return len(a) - s.bit_count()


def indel_ratio(a: str, b: str) -> float:
    return 2 * common_subsequence(a, b) / (len(a) + len(b)) if a or b else 1.0


@F.arrow_udf(T.DoubleType())
def bleu(pred, truth):
    import pyarrow as pa

    pairs = ((p.as_py(), t.as_py()) for p, t in zip(pred, truth))
    return pa.array((None if p is None or t is None or min(len(p), len(t)) < MIN_CHARS else bleu_score(t.split(), p.split()) for p, t in pairs), pa.float64())


@F.pandas_udf(T.DoubleType())
def ratio(a, b):
    import pandas as pd

    return pd.Series([None if x is None or y is None else indel_ratio(x, y) for x, y in zip(a, b)], dtype="float64")


def near_matches(needle: str, hay: str, most: int) -> list[tuple[int, int, int]]:
    """(start, end, distance) of the best place of each stretch where needle is found within `most` edits."""
    if not needle or most < 0:
        return []
    n = len(needle)
    cost, start = list(range(n + 1)), [0] * (n + 1)
    ends = []
    for j, c in enumerate(hay, 1):
        new, begin = [0], [j]
        for i in range(1, n + 1):
            best = min((cost[i - 1] + (needle[i - 1] != c), -start[i - 1], 0), (cost[i] + 1, -start[i], 1), (new[i - 1] + 1, -begin[i - 1], 2))
            new.append(best[0])
            begin.append(-best[1])
        cost, start = new, begin
        if cost[n] <= most:
            ends.append((start[n], j, cost[n]))
    out: list[tuple[int, int, int]] = []
    reach = -1
    for s, e, d in sorted(ends, key=lambda m: m[1]):
        if out and s < reach:
            if d < out[-1][2]:
                out[-1] = (s, e, d)
        else:
            out.append((s, e, d))
        reach = max(reach, e)
    return out


def _last_row(needle: np.ndarray, hay: np.ndarray, free: bool) -> np.ndarray:
    """Edit distances of the needle to hay[:j] for all j, or to the best of hay[i:j] if its begin is free."""
    n = len(hay)
    up, down = (np.unpackbits(np.frombuffer(x.to_bytes(n // 8 + 1, "little"), np.uint8), count=n, bitorder="little").view(np.int8) for x in _last_deltas(needle, hay, free))
    row = np.full(n + 1, len(needle), np.int32)
    row[1:] += np.cumsum(up - down, dtype=np.int32)
    return row


def locate(needle: str, hay: str, rate: float = 0.5) -> tuple[int, float]:
    """(start, score) of the closest near match, the first of equally close ones, or (-1, 0)."""
    most = min(len(needle) - 1, int(len(needle) * min(0.9, rate)) + 5)
    if not needle or most < 0:
        return -1, 0.0
    x, y = _codes(needle, hay)
    ends = _last_row(x, y, True)
    end = int(ends.argmin())
    least = int(ends[end])
    if least > most:
        return -1, 0.0
    back = y[max(0, end - len(x) - least) : end][::-1]
    size = int(np.flatnonzero(_last_row(x[::-1], back, False) == least)[-1])  # the longest of equally close ones
    return end - size, 1 - least / max(1, most)


@F.pandas_udf(T.StructType([T.StructField("start", T.LongType()), T.StructField("score", T.DoubleType())]))
def fuzzy_position(needle, hay):
    import pandas as pd

    return pd.DataFrame([(None, None) if a is None or b is None else locate(a, b) for a, b in zip(needle, hay)], columns=["start", "score"])
