"""Packing documents into training windows by best-fit decreasing.

A document longer than a window is first cut into full windows and one rest.  Best-fit
decreasing depends on the lengths alone, and there are at most `capacity` of them: so the
lengths are counted over the whole corpus, the packing is computed for whole classes of
equal segments at once (a segment tree indexed by remaining capacity finds the tightest
open windows), and what comes out is a table of rules "segments i to j of length L go to
windows from w on, m to each".  Its size depends on the capacity, not on the corpus.  Every
segment then finds its window from its rank within its class.  The result is exactly that
of best-fit decreasing over all segments of the corpus, one after the other.

Defined cases: a row without doc_id, and a text of no tokens (null, empty), gets no window.
Rows that repeat a doc_id are packed each on its own.  Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .arrowtext import slices
from .pretoken import DEFAULT_VOCABULARY, token_totals
from .shared import output_schema, written

CAPACITY = 2048


class OpenWindows:
    """Ranges of window numbers by their remaining capacity, under a segment tree that answers
    "least capacity of at least x that any open window has" in O(log capacity)."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.tree = [False] * (2 * self.size)
        self.ranges: list[list[tuple[int, int]]] = [[] for _ in range(self.size)]

    def _refresh(self, r: int) -> None:
        i = r + self.size
        self.tree[i] = bool(self.ranges[r])
        while i > 1:
            i >>= 1
            self.tree[i] = self.tree[2 * i] or self.tree[2 * i + 1]

    def put(self, r: int, first: int, count: int) -> None:
        """`count` windows from number `first` on, r of whose capacity remains."""
        if r and count:
            self.ranges[r].append((first, count))
            self._refresh(r)

    def pop(self, r: int) -> tuple[int, int]:
        got = self.ranges[r].pop()
        self._refresh(r)
        return got

    def tightest(self, least: int) -> int | None:
        i = least + self.size
        if self.tree[i]:
            return least
        while i > 1:
            if not i & 1 and self.tree[i + 1]:
                i += 1
                break
            i >>= 1
        else:
            return None
        while i < self.size:
            i = 2 * i if self.tree[2 * i] else 2 * i + 1
        return i - self.size


def packing_rules(histogram: dict[int, int], capacity: int) -> tuple[np.ndarray, int]:
    """(rules, number of windows).  A rule (L, i, w, m) sends the segments of length L whose rank r is
    at least i, and below the next rule's, to window w + (r - i) // m."""
    open_windows, rules, used = OpenWindows(capacity), [], 0
    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            r = open_windows.tightest(length)
            if r is None:
                each = capacity // length
                full, odd = divmod(left, each)
                rules.append((length, rank, used, each))
                open_windows.put(capacity - each * length, used, full)
                if odd:
                    open_windows.put(capacity - odd * length, used + full, 1)
                used += full + bool(odd)
                break
            first, count = open_windows.pop(r)
            each = r // length
            take = min(count, left // each)
            if take:
                rules.append((length, rank, first, each))
                open_windows.put(r - each * length, first, take)
                rank, left, first, count = rank + take * each, left - take * each, first + take, count - take
            if count and left and left < each:
                rules.append((length, rank, first, each))
                open_windows.put(r - left * length, first, 1)
                first, count, left = first + 1, count - 1, 0
            open_windows.put(r, first, count)
    return np.array(rules, np.int64).reshape(-1, 4), used


def _counter(path: str):
    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(token_totals(part.column(1), path))], names=["doc_id", "n_tokens"])

    return run


def token_lengths(docs: DataFrame, vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """(doc_id, n_tokens) of every row with a doc_id."""
    src = docs.where("doc_id is not null").select("doc_id", F.col("text").cast("string").alias("text"))
    return src.mapInArrow(_counter(vocabulary), output_schema(src, ["doc_id"], "n_tokens bigint"))


def _assigner(rules: np.ndarray):
    order = np.lexsort((rules[:, 1], rules[:, 0])) if len(rules) else np.empty(0, int)
    rules = rules[order]
    keys = (rules[:, 0] << 44) | rules[:, 1]

    def run(batches):
        for b in batches:
            t = {c: b.column(b.schema.get_field_index(c)) for c in b.schema.names}
            length, rank = np.asarray(t["n_tokens"]).astype(np.int64), np.asarray(t["rank"]).astype(np.int64)
            rule = rules[np.searchsorted(keys, (length << 44) | rank, "right") - 1] if len(rules) else np.zeros((0, 4), np.int64)
            window = rule[:, 2] + (rank - rule[:, 1]) // np.maximum(rule[:, 3], 1)
            yield pa.RecordBatch.from_arrays([pa.array(window), t["doc_id"], t["segment"], t["start_token"], t["n_tokens"]], names=["window_id", "doc_id", "segment", "start_token", "n_tokens"])

    return run


def pack(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str = DEFAULT_VOCABULARY, lengths: DataFrame | None = None) -> DataFrame:
    """(window_id, doc_id, segment, start_token, n_tokens): the segments of every document and their windows."""
    lengths = written(token_lengths(docs, vocabulary) if lengths is None else lengths.select("doc_id", F.col("n_tokens").cast("bigint").alias("n_tokens")), "lengths")
    seg = (
        lengths.where("n_tokens > 0")
        .select("doc_id", F.col("n_tokens").alias("all"), F.explode(F.sequence(F.lit(0), ((F.col("n_tokens") - 1) / capacity).cast("int"))).alias("segment"))
        .select("doc_id", "segment", (F.col("segment").cast("bigint") * capacity).alias("start_token"), F.least(F.lit(capacity).cast("bigint"), F.col("all") - F.col("segment") * capacity).alias("n_tokens"))
    )
    histogram = {r.n_tokens: r.n for r in seg.groupBy("n_tokens").agg(F.count("*").alias("n")).collect()}
    rules, _ = packing_rules(histogram, capacity)
    # Ranks within a length are numbered bucket by bucket, so that no length is one task's work.
    buckets = max(1, sum(histogram.values()) // 500_000)
    seg = seg.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "segment"), F.lit(buckets)).cast("int"))
    sizes = seg.groupBy("n_tokens", "bucket").agg(F.count("*").alias("size"))
    before = sizes.select("n_tokens", "bucket", (F.sum("size").over(Window.partitionBy("n_tokens").orderBy("bucket")) - F.col("size")).alias("before"))
    rank = F.row_number().over(Window.partitionBy("n_tokens", "bucket").orderBy("doc_id", "segment")).cast("bigint") - 1 + F.col("before")
    ranked = seg.join(before, ["n_tokens", "bucket"]).select("doc_id", "segment", "start_token", "n_tokens", rank.alias("rank"))
    kind = output_schema(lengths, ["doc_id"], "segment int, start_token bigint, n_tokens bigint")
    return ranked.mapInArrow(_assigner(rules), "window_id bigint, " + ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kind.fields))
