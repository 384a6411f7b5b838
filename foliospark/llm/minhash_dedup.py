"""Near-duplicate documents from bottom-k sketches of one hash function.

1. Each document becomes its set of hashed word n-grams; the k least hashes are its sketch.
2. Documents of the same word sequence collapse to one node.
3. Inverted lists of retained values generate overlaps.  A pair that the sketch filter would
   pass shares at least ``ceil(floor * s)`` of the s values either side retains, so the two
   must meet among the ``s - ceil(floor * s) + 1`` values of each that are rarest in the
   corpus (prefix filtering): only those enter the lists, and nothing is lost.
4. Within a list every member is compared with the list's least node first; afterwards
   only pairs that no chain of verified pairs connects are compared.  Large groups of copies
   thus cost a number of comparisons in proportion to their size.
5. The union sketch (the k least values of both sketches together) estimates Jaccard
   similarity; pairs that pass are verified by the exact similarity of the n-gram sets.
6. Verified pairs make groups by connected components; the least document of a group stays, in the order
   (doc_id, hash of the text).

Defined cases: a row without doc_id, and a document without a word (null, empty, only
punctuation), takes part in no group and is always kept.  A document of fewer than n words
has one n-gram, all its words.  Rows that repeat a doc_id with the same text are one document; with
another text they are another, which stays or goes by itself, so `near_duplicates` may name a doc_id in several groups.
An empty table has no groups.  Other columns, whatever their names, pass through.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrowtext import U64, hashed_words, slices, span_hashes
from .shared import components, output_schema, written

GRAM = 3
K = 64
THRESHOLD = 0.55
FLOOR = 0.40
_LOW48 = U64((1 << 48) - 1)


def _sequences(column, n: int):
    words, _, _, first, _ = hashed_words(column)
    count = np.diff(first)
    grams = np.where(count == 0, 0, np.maximum(count - n + 1, 1))
    starts = np.zeros(len(count) + 1, np.int64)
    np.cumsum(grams, out=starts[1:])
    at = np.repeat(first[:-1] - starts[:-1], grams) + np.arange(starts[-1])
    ends = np.minimum(at + n, np.repeat(first[1:], grams))
    return words, first, span_hashes(words, at, ends), starts, grams


def _distinct(values: np.ndarray, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct 48-bit values of each document, ascending, and the bounds of each document."""
    keys = (np.repeat(np.arange(len(grams), dtype=U64), grams) << U64(48)) | (values & _LOW48)
    keys.sort()
    if len(keys):
        keep = np.ones(len(keys), bool)
        keep[1:] = keys[1:] != keys[:-1]
        keys = keys[keep]
    bounds = np.searchsorted(keys, np.arange(len(grams) + 1, dtype=U64) << U64(48))
    return keys & _LOW48, bounds


def _sketcher(n: int, k: int):
    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                words, first, grams_h, _, grams = _sequences(part.column(2), n)
                rows = np.arange(len(first) - 1)
                whole = span_hashes(words, first[:-1], first[1:])
                turned = span_hashes(words[::-1], (len(words) - first[1:])[::-1], (len(words) - first[:-1])[::-1])[::-1]
                values, bounds = _distinct(grams_h, grams)
                m = np.diff(bounds)
                rank = np.arange(len(values)) - np.repeat(bounds[:-1], m)
                kept = values[rank < k].astype(np.int64)
                offs = np.zeros(len(m) + 1, np.int32)
                np.cumsum(np.minimum(m, k), out=offs[1:])
                some = rows[m > 0]
                out = pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(whole.view(np.int64)), pa.array(np.ascontiguousarray(turned).view(np.int64)), pa.array(m.astype(np.int32)), pa.ListArray.from_arrays(pa.array(offs), pa.array(kept))],
                    names=["doc_id", "version", "h1", "h2", "m", "sketch"],
                )
                yield out.take(pa.array(some))

    return run


def sketches(docs: DataFrame, n: int = GRAM, k: int = K) -> DataFrame:
    """doc_id, a hash of the text, two of the word sequence, the number of distinct n-grams and the k least of their hashes."""
    src = docs.where("doc_id is not null").select("doc_id", F.xxhash64(F.col("text").cast("string")).alias("version"), F.col("text").cast("string").alias("text"))
    return src.mapInArrow(_sketcher(n, k), output_schema(src, ["doc_id"], "version bigint, h1 bigint, h2 bigint, m int, sketch array<bigint>"))


def _verifier(n: int, threshold: float):
    def run(batches):
        for batch in batches:
            t = pa.Table.from_batches([batch])
            for lo in range(0, t.num_rows, 256):
                p = t.slice(lo, 256)
                sides = []
                for c in ("ta", "tb"):
                    _, _, h, _, grams = _sequences(p.column(c), n)
                    sides.append(_distinct(h, grams))
                (va, ba), (vb, bb) = sides
                j = np.zeros(p.num_rows)
                for i in range(p.num_rows):
                    x, y = va[ba[i] : ba[i + 1]], vb[bb[i] : bb[i + 1]]
                    both = np.concatenate([x, y])
                    both.sort()
                    shared = int((both[1:] == both[:-1]).sum())
                    j[i] = shared / max(1, len(both) - shared)
                good = pa.array(np.flatnonzero(j >= threshold))
                for out in pa.table({"a": p.column("a"), "b": p.column("b"), "jaccard": pa.array(j)}).take(good).to_batches():
                    yield out

    return run


def _verified(pairs: DataFrame, sk: DataFrame, texts: DataFrame, n: int, k: int, threshold: float, floor: float) -> DataFrame:
    """Of the pairs of nodes (a, b), those whose estimate passes `floor` and whose similarity passes `threshold`."""
    left = sk.select(F.col("node").alias("a"), F.col("sketch").alias("sa"))
    right = sk.select(F.col("node").alias("b"), F.col("sketch").alias("sb"))
    p = pairs.join(left, "a").join(right, "b")
    union = F.slice(F.array_sort(F.array_union("sa", "sb")), 1, k)
    shared = F.size(F.array_intersect(F.array_intersect("sa", "sb"), union))
    p = p.where(shared >= F.lit(floor) * F.size(union)).select("a", "b")
    p = p.join(texts.select(F.col("node").alias("a"), F.col("text").alias("ta")), "a")
    p = p.join(texts.select(F.col("node").alias("b"), F.col("text").alias("tb")), "b")
    return p.mapInArrow(_verifier(n, threshold), output_schema(p, ["a", "b"], "jaccard double"))


def _members(docs: DataFrame, n: int, k: int, threshold: float, floor: float) -> DataFrame:
    """(doc_id, version, kept) of every document in a group of several; kept is the (doc_id, version) that stays."""
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    sk = written(sketches(docs, n, k), "sketches")
    copies = sk.groupBy("h1", "h2").agg(F.min("doc_id").alias("doc_id"))
    one_of_each = sk.join(copies, ["h1", "h2", "doc_id"], "left_semi").dropDuplicates(["h1", "h2", "doc_id"])
    nodes = written(one_of_each.withColumn("node", F.monotonically_increasing_id()), "nodes")
    reps = nodes.select("node", "m", "sketch")

    values = reps.select("node", "m", F.size("sketch").alias("s"), F.explode("sketch").alias("v"))
    common = values.groupBy("v").agg(F.count("*").alias("df")).where("df > 1")
    take = F.col("s") - F.ceil(F.lit(floor) * F.col("s") - F.lit(1e-9)) + 1 - (F.col("s") - F.size("shared"))
    prefix = (
        values.join(common, "v").groupBy("node", "m", "s").agg(F.array_sort(F.collect_list(F.struct("df", "v"))).alias("shared"))
        .withColumn("take", take.cast("int")).where("take > 0")
        .select("node", "m", F.explode(F.slice("shared", F.lit(1), F.col("take"))).alias("x")).select("node", "m", F.col("x.v").alias("v"))
    )
    pivots = prefix.groupBy("v").agg(F.min("node").alias("pivot"))
    prefix = written(prefix.join(pivots, "v"), "prefix")

    met = written(prefix.select("node").distinct(), "met")
    near = reps.join(met, "node", "left_semi")
    wanted = nodes.join(met, "node", "left_semi").select("node", "doc_id", "version")
    texts = docs.where("doc_id is not null").withColumn("version", F.xxhash64("text")).join(wanted, ["doc_id", "version"]).select("doc_id", "version", "node", "text")
    texts = written(texts.dropDuplicates(["doc_id", "version", "node"]).select("node", "text"), "texts")
    star = prefix.where("pivot <> node").select(F.col("pivot").alias("a"), F.col("node").alias("b")).distinct()
    one = written(_verified(star, near, texts, n, k, threshold, floor), "star")

    label = components(one)
    named = prefix.join(label, "node", "left").select("v", "node", "m", "pivot", F.coalesce("label", "node").alias("label"))
    mixed = named.groupBy("v").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("v")
    rest = named.join(mixed, "v").where("node <> pivot")
    x = rest.select("v", F.col("node").alias("a"), F.col("m").alias("ma"), F.col("label").alias("la"))
    y = rest.select("v", F.col("node").alias("b"), F.col("m").alias("mb"), F.col("label").alias("lb"))
    cross = x.join(y, "v").where((F.col("a") < F.col("b")) & (F.col("la") != F.col("lb")) & (F.least("ma", "mb") >= F.lit(threshold) * F.greatest("ma", "mb"))).select("a", "b").distinct()
    two = written(_verified(cross, near, texts, n, k, threshold, floor), "cross")

    label = components(one.unionByName(two))
    classes = nodes.select("node", "h1", "h2").join(label, "node", "left").select("h1", "h2", F.coalesce("label", "node").alias("label"))
    members = sk.select("doc_id", "version", "h1", "h2").distinct().join(classes, ["h1", "h2"]).select("doc_id", "version", "label")
    several = members.groupBy("label").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "version")).alias("kept")).where("n > 1").select("label", "kept")
    return members.join(several, "label").select("doc_id", "version", "kept")


def near_duplicates(docs: DataFrame, n: int = GRAM, k: int = K, threshold: float = THRESHOLD, floor: float = FLOOR) -> DataFrame:
    """(doc_id, group_id) of every document that has a near duplicate; group_id is the least doc_id of its group."""
    return _members(docs, n, k, threshold, floor).select("doc_id", F.col("kept.doc_id").alias("group_id")).distinct()


def drop_near_duplicates(docs: DataFrame, n: int = GRAM, k: int = K, threshold: float = THRESHOLD, floor: float = FLOOR) -> DataFrame:
    """docs without those rows that are near duplicates of the kept document of their group."""
    gone = _members(docs, n, k, threshold, floor).where("doc_id <> kept.doc_id or version <> kept.version").select("doc_id", "version")
    plain = [f"c{i}" if c not in ("doc_id", "text") else c for i, c in enumerate(docs.columns)]
    src = docs.toDF(*plain).withColumn("version", F.xxhash64(F.col("text").cast("string")))
    return src.join(gone, ["doc_id", "version"], "left_anti").select(plain).toDF(*docs.columns)
