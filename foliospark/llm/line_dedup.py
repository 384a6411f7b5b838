"""Repeated and nearly repeated lines across the corpus, by a deletion-neighbourhood join.

Lines (without white space at their ends) of at least `min_chars` characters are compared;
equal ones collapse to their earliest occurrence in the order (doc_id, line number).  Of the
distinct ones with at least `min_fuzzy` characters, two are near when one edit turns one into the other.

Both then share the variant that lacks the edited character: the key of a variant is a hash
of (what precedes, what follows, length, place).  To emit one key for every character of
every line would be needless: if two lines share a variant they also share the coarser one
that lacks a whole stretch around the character.  So variants are emitted from coarse to
fine (halves, then eighths of those, then characters), each time only for stretches whose
coarser variant another line shares.  No pair is lost.  A line of length L - 1 takes part in
the variants of length L with the stretch one shorter.

All lines that share a finest variant are within one edit of each other, so a grouped minimum
finds the earliest; the edit distance of each line to it is verified on the texts.  A line
goes if an earlier line is equal or near, kept or not.

Defined cases: rows without doc_id and null texts have no lines and stay as they are; empty and short
lines are never removed.  Rows that repeat doc_id and text are one document.  In `dedup_lines`
a document of which every non-empty line goes is dropped; other columns pass through.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .arrowtext import U64, mix, slices, span_hashes
from .pretoken import code_points
from .shared import output_schema, written

MIN_CHARS = 10
MIN_FUZZY = 20
PARTS = 8


def _lines(cp: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Trimmed [start, end), document and number within it of every line; an empty one has start == end."""
    n = len(cp)
    full = np.flatnonzero(np.diff(begins) > 0)  # an empty document begins where the next one does
    heads = begins[:-1][full]
    cut = np.flatnonzero(cp == 10)
    cut = cut[~np.isin(cut + 1, begins[1:])]  # a break that ends a document opens a last, empty line: nothing to compare
    starts = np.sort(np.concatenate([heads, cut + 1]))
    doc = full[np.searchsorted(heads, starts, "right") - 1]
    ends = np.append(starts[1:], n)
    solid = np.flatnonzero((cp > 32) & (cp != 0xA0))
    if not len(solid):
        return starts, starts, doc, np.zeros(len(starts), np.int64)
    a = np.searchsorted(solid, starts)
    s = solid[np.minimum(a, len(solid) - 1)]
    e = solid[np.searchsorted(solid, ends) - 1] + 1
    blank = (a == len(solid)) | (s >= ends)
    s, e = np.where(blank, starts, s), np.where(blank, starts, e)
    first = np.searchsorted(doc, np.arange(len(begins) - 1))
    return s, e, doc, np.arange(len(starts)) - first[doc]


def _second(cp: np.ndarray) -> np.ndarray:
    return mix(cp.astype(U64) + U64(77)) >> U64(32)


def _variant(cp: np.ndarray, s: np.ndarray, e: np.ndarray, length: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Keys of lines [s, e) without the stretch [lo, hi) of a line of `length` characters (one less for a shorter line)."""
    less = length - (e - s)
    before = span_hashes(cp, s, s + lo)
    after = span_hashes(cp, np.minimum(s + hi - less, e), e)
    place = (length.astype(U64) << U64(40)) | (lo.astype(U64) << U64(20)) | hi.astype(U64)
    return mix(before * U64(3) + mix(after) + mix(place ^ U64(0xABCDEF0123456789)))


def _line_reader(min_chars: int, min_fuzzy: int):
    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                _, cp, begins = code_points(part.column(2))
                s, e, doc, number = _lines(cp, begins)
                keep = e - s >= min_chars
                s, e, doc, number = s[keep], e[keep], doc[keep], number[keep]
                size = e - s
                keys = []
                for more in (0, 1):
                    length = size + more
                    half = length // 2
                    keys += [_variant(cp, s, e, length, half * 0, half), _variant(cp, s, e, length, half, length)]
                fuzzy = size >= min_fuzzy
                cols = [part.column(0).take(pa.array(doc)), part.column(1).take(pa.array(doc)), pa.array(number.astype(np.int32)), pa.array(span_hashes(cp, s, e).view(np.int64)), pa.array(span_hashes(_second(cp), s, e).view(np.int64))]
                cols += [pa.array(k.view(np.int64), mask=~fuzzy) for k in keys]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "version", "line_no", "h1", "h2", "k0", "k1", "k2", "k3"])

    return run


def _line_texts(batches):
    """The wanted lines of each document, as texts."""
    for batch in batches:
        for part in slices(batch, "text"):
            text, cp, begins = code_points(part.column(part.schema.get_field_index("text")))
            s, e, doc, _ = _lines(cp, begins)
            first = np.searchsorted(doc, np.arange(part.num_rows))
            wanted = part.column(part.schema.get_field_index("lines"))
            got = wanted.flatten()
            row = np.repeat(np.arange(part.num_rows), np.diff(np.asarray(wanted.offsets)))
            at = first[row] + np.asarray(got.field("line_no"))
            yield pa.RecordBatch.from_arrays([got.field("h1"), pa.array([text[a:b] for a, b in zip(s[at].tolist(), e[at].tolist())], pa.string())], names=["h1", "line"])


def _refiner(parts: int):
    """Stretches [lo, hi) cut into `parts`, or into characters if 0, with the key of each."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, "line", 1 << 20):
                get = {c: part.column(i) for i, c in enumerate(part.schema.names)}
                _, cp, begins = code_points(get["line"])
                s, e = begins[:-1], begins[1:]
                length, lo, hi = (np.asarray(get[c]).astype(np.int64) for c in ("length", "lo", "hi"))
                step = np.maximum(hi - lo, 1) if not parts else np.minimum(parts, np.maximum(hi - lo, 1))
                row = np.repeat(np.arange(len(s)), step)
                j = np.arange(len(row)) - np.repeat(np.cumsum(step) - step, step)
                width = (hi - lo)[row]
                a, b = lo[row] + j * width // step[row], lo[row] + (j + 1) * width // step[row]
                r = pa.array(row)
                key = np.empty(len(row), np.int64)
                order = np.lexsort((a, row))
                o = row[order]
                key[order] = _sorted_variant(cp, s[o], e[o], length[o], a[order], b[order]).view(np.int64)
                yield pa.RecordBatch.from_arrays([get["h1"].take(r), pa.array(length[row].astype(np.int32)), pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32)), pa.array(key)], names=["h1", "length", "lo", "hi", "key"])

    return run


def _sorted_variant(cp, s, e, length, lo, hi):
    # span_hashes wants ascending starts; the ends of stretches of one line ascend with lo, and lines ascend
    return _variant(cp, s, e, length, lo, hi)


def _shared(rows: DataFrame) -> DataFrame:
    """The rows whose key two distinct lines share."""
    keys = rows.groupBy("key").agg(F.min("h1").alias("a"), F.max("h1").alias("b")).where("a <> b").select("key")
    return rows.join(keys, "key")


def duplicate_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_fuzzy: int = MIN_FUZZY, parts: int = PARTS) -> DataFrame:
    """(doc_id, version, line_no, kept_doc_id, kept_line_no, distance) of every line an earlier one repeats.
    `version` tells apart different texts of one doc_id; kept_* is the earliest equal line, or the earliest near one."""
    src = docs.where("doc_id is not null").select("doc_id", F.xxhash64(F.col("text").cast("string")).alias("version"), F.col("text").cast("string").alias("text"))
    kind = output_schema(src, ["doc_id"], "version bigint, line_no int, h1 bigint, h2 bigint, k0 bigint, k1 bigint, k2 bigint, k3 bigint")
    lines = written(src.mapInArrow(_line_reader(min_chars, min_fuzzy), kind), "lines")
    place = F.struct("doc_id", "version", "line_no")
    distinct = written(lines.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.count("*").alias("n"), *(F.min(f"k{i}").alias(f"k{i}") for i in range(4))), "distinct")

    repeated = distinct.where("n > 1").select("h1", "h2", "first")
    exact = lines.select("doc_id", "version", "line_no", "h1", "h2").join(repeated, ["h1", "h2"]).where(place != F.col("first"))
    exact = exact.select("doc_id", "version", "line_no", F.col("first.doc_id").alias("kept_doc_id"), F.col("first.line_no").alias("kept_line_no"), F.lit(0).alias("distance"))

    coarse = distinct.where("k0 is not null").select("h1", F.posexplode(F.array("k0", "k1", "k2", "k3")).alias("side", "key"))
    coarse = written(_shared(coarse).select("h1", "side"), "coarse")
    wanted = distinct.select("h1", "first").join(coarse.select("h1").distinct(), "h1", "left_semi")
    per_doc = wanted.groupBy(F.col("first.doc_id").alias("doc_id"), F.col("first.version").alias("version")).agg(F.collect_list(F.struct("h1", F.col("first.line_no").alias("line_no"))).alias("lines"))
    texts = src.join(per_doc.hint("shuffle_hash"), ["doc_id", "version"]).dropDuplicates(["doc_id", "version"]).select("text", "lines")
    texts = written(texts.mapInArrow(_line_texts, "h1 bigint, line string").dropDuplicates(["h1"]), "texts")

    size, side = F.length("line"), F.col("side")
    length = size + F.when(side >= 2, 1).otherwise(0)
    half = F.floor(F.col("length") / 2).cast("int")
    stretch = coarse.join(texts, "h1").withColumn("length", length.cast("int"))
    stretch = stretch.select("h1", "line", "length", F.when(side % 2 == 0, 0).otherwise(half).alias("lo"), F.when(side % 2 == 0, half).otherwise(F.col("length")).alias("hi"))
    for p in (parts, 0):
        finer = stretch.mapInArrow(_refiner(p), "h1 bigint, length int, lo int, hi int, key bigint").dropDuplicates(["h1", "key"])
        finer = _shared(written(finer, "variants"))
        if p:
            stretch = finer.select("h1", "length", "lo", "hi").distinct().join(texts, "h1").select("h1", "line", "length", "lo", "hi")
    near = finer.join(distinct.select("h1", "first"), "h1")
    near = near.withColumn("kept", F.min(F.struct("first", "h1")).over(Window.partitionBy("key"))).where(F.col("kept.h1") != F.col("h1"))
    near = near.groupBy("h1", "first").agg(F.min("kept").alias("kept"))
    near = near.join(texts, "h1").join(texts.select(F.col("h1").alias("other"), F.col("line").alias("kept_line")), F.col("kept.h1") == F.col("other"))
    near = near.where(F.levenshtein("line", "kept_line", 1) == 1)
    near = near.select("first.doc_id", "first.version", "first.line_no", F.col("kept.first.doc_id").alias("kept_doc_id"), F.col("kept.first.line_no").alias("kept_line_no"), F.lit(1).alias("distance"))
    return exact.unionByName(near)


def _cutter(text_at: int):
    def run(batches):
        for batch in batches:
            texts, gone, drop = batch.column(text_at).to_pylist(), batch.column(batch.num_columns - 1).to_pylist(), []
            keep = np.ones(batch.num_rows, bool)
            for i, g in enumerate(gone):
                if g is not None:
                    g = set(g)
                    left = [x for k, x in enumerate(texts[i].split("\n")) if k not in g]
                    texts[i] = "\n".join(left)
                    keep[i] = any(x.strip() for x in left)
            columns = batch.columns[:-1]
            columns[text_at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names[:-1]).filter(pa.array(keep))

    return run


def dedup_lines(docs: DataFrame, **options) -> DataFrame:
    """docs without their repeated lines; n_chars, if there is such a column, follows the text."""
    gone = duplicate_lines(docs, **options).groupBy("doc_id", "version").agg(F.collect_list("line_no").alias("gone"))
    plain = [f"c{i}" if c not in ("doc_id", "text") else c for i, c in enumerate(docs.columns)]
    src = docs.toDF(*plain).withColumn("text", F.col("text").cast("string")).withColumn("version", F.xxhash64("text"))
    joined = src.join(gone, ["doc_id", "version"], "left").select(*plain, "gone")
    out = joined.mapInArrow(_cutter(plain.index("text")), src.select(plain).schema).toDF(*docs.columns)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out
