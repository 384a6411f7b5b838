"""Training passages that copy, edit or paraphrase benchmark items.

1. The words that benchmark items use are counted over the whole corpus.
2. Seeds are the items' word n-grams that are rare: an independence model of those counts
   expects at most `chance` of them in the corpus.  (The model, not the count of the n-gram,
   decides, so a passage copied a thousand times is no less rare.)  Each item has its own n, the least length of at
   least `SHORTEST` at which `SHARE` of its n-grams are rare, so n grows with the corpus; at most the whole
   item, and where none of its n-grams is rare, all of them are seeds.
3. Seeds join documents to items.  While the words of all items are at most `broadcast_limit` the seeds travel to the
   documents and nothing is shuffled; beyond it the benchmark never comes to the driver: words are counted,
   seeds are made and document n-grams meet seeds in joins.  Both ways give the same rows.
4. Around its seeds each document is aligned with the item by Smith-Waterman over words.
   The score, over the number of the item's words, is 1 for a verbatim copy.

Defined cases: rows without doc_id, or whose text has no words, match nothing and are never dropped;
items without item_id or without words match nothing.  Items of the same text are
all reported, and each text of an item_id that has several is looked for.  Of rows that repeat a doc_id or an
item_id, the best match counts in `contaminated`; `drop_contaminated` judges each row by its own text.
An empty benchmark or corpus gives no matches.  Other columns, whatever their names, pass through.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrowtext import U64, _R, hashed_words, mix, slices
from .shared import output_schema, written

THRESHOLD = 0.45
CHANCE = 0.5
MATCH, MISMATCH, GAP = 1.0, -1 / 3, -1 / 3
BROADCAST_LIMIT = 2_000_000
SHORTEST, SHARE = 3, 0.9


def smith_waterman(item: np.ndarray, text: np.ndarray) -> tuple[float, int, int]:
    """(best local score, first and last word of the text in it).  Rows are the item's words;
    gaps along the text come from a running maximum, so every row is a few array operations."""
    n = len(text)
    if not n or not len(item):
        return 0.0, 0, 0
    ramp = np.arange(n) * -GAP
    row, begin = np.zeros(n), np.arange(n)
    best, at = 0.0, (0, 0)
    prev, prev_begin = np.zeros(n), np.arange(n)
    for w in item:
        diag, diag_begin = np.zeros(n), np.arange(n)
        diag[1:], diag_begin[1:] = prev[:-1], np.where(prev[:-1] > 0, prev_begin[:-1], diag_begin[1:])
        score = diag + np.where(text == w, MATCH, MISMATCH)
        up = prev + GAP
        x = np.maximum(np.maximum(score, up), 0.0)
        x_begin = np.where(score >= up, diag_begin, prev_begin)
        x_begin = np.where(x > 0, x_begin, np.arange(n))
        run = np.maximum.accumulate(x + ramp)
        source = np.maximum.accumulate(np.where(x + ramp >= run, np.arange(n), 0))
        row, begin = run - ramp, x_begin[source]
        row = np.where(row > 1e-12, row, 0.0)
        j = int(row.argmax())
        if row[j] > best:
            best, at = float(row[j]), (int(begin[j]), j)
        prev, prev_begin = row, begin
    return best, *at


def gram_series(words: np.ndarray, first: np.ndarray, lengths: list[int]):
    """For each of the ascending lengths n: n, the hashes of the n-grams that lie within one document, their positions
    and the document of each.  Each hash goes on from that of the next shorter length."""
    size = np.diff(first)
    doc = np.repeat(np.arange(len(size)), size)
    left = np.repeat(first[1:], size) - np.arange(len(words))  # words from here to the end of the document
    at, h, done = np.arange(len(words)), np.zeros(len(words), U64), 0
    for n in lengths:
        keep = left[at] >= n
        at, h = at[keep], h[keep]
        for j in range(done, n):
            h = h * U64(_R) + words[at + j]
        done = n
        yield n, mix(h + U64(n)), at, doc[at]


class Seeds:
    """Seed hashes in ascending order with their items, and the items' words."""

    def __init__(self, hashes: np.ndarray, items: np.ndarray, lengths: list[int], words: list[np.ndarray]):
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.items, self.lengths, self.words = hashes[order], items[order], lengths, words
        self.bits = np.zeros(1 << 20, bool)
        self.bits[(self.hashes >> np.uint64(44)).astype(np.int64)] = True

    def hits(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index of a gram, item) of every meeting of grams and seeds."""
        at = np.flatnonzero(self.bits[(grams >> np.uint64(44)).astype(np.int64)])
        lo, hi = np.searchsorted(self.hashes, grams[at], "left"), np.searchsorted(self.hashes, grams[at], "right")
        times = hi - lo
        k = np.repeat(lo - (np.cumsum(times) - times), times) + np.arange(times.sum())
        return np.repeat(at, times), self.items[k]


def item_seeds(words: np.ndarray, count: np.ndarray, total: int, vocabulary: int, chance: float) -> tuple[int, np.ndarray]:
    """(n, hashes of the seeds) of one item from the corpus' counts of its words."""
    sums = np.concatenate([[0.0], np.cumsum(np.log((count + 0.5) / (total + 0.5 * vocabulary)))])
    n, rare = min(SHORTEST, len(words)), np.empty(0, bool)
    for n in range(n, len(words) + 1):
        rare = sums[n:] - sums[:-n] + math.log(total) <= math.log(chance)
        if rare.mean() >= SHARE:
            break
    _, h, _, _ = next(gram_series(words, np.array([0, len(words)]), [n]))
    return n, np.unique(h[rare] if rare.any() else h)


def align(doc: np.ndarray, item: np.ndarray, seeds: np.ndarray) -> tuple[float, int, int]:
    """The best alignment of an item in a document whose words at `seeds` (ascending) begin shared n-grams."""
    reach = len(item) + len(item) // 2 + 2
    best = (0.0, 0, 0)
    for group in np.split(seeds, np.flatnonzero(np.diff(seeds) > 2 * reach) + 1):
        lo, hi = max(0, int(group[0]) - reach), min(len(doc), int(group[-1]) + reach)
        s, a, b = smith_waterman(item, doc[lo:hi])
        if s > best[0]:
            best = (s, lo + a, lo + b + 1)
    return best


def _vocabulary_counter(vocabulary: np.ndarray):
    def run(batches):
        total, n = np.zeros(len(vocabulary), np.int64), 0
        bits = np.zeros(1 << 20, bool)
        bits[(vocabulary >> np.uint64(44)).astype(np.int64)] = True
        for batch in batches:
            for part in slices(batch, "text"):
                words = hashed_words(part.column(0))[0]
                n += len(words)
                words = words[bits[(words >> np.uint64(44)).astype(np.int64)]]
                at = np.minimum(np.searchsorted(vocabulary, words), len(vocabulary) - 1)
                total += np.bincount(at[vocabulary[at] == words], minlength=len(vocabulary))
        k = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(k, -1)), pa.array(np.append(total[k], n))], names=["word", "n"])

    return run


def _count_words(docs: DataFrame, vocabulary: np.ndarray) -> tuple[np.ndarray, int]:
    """The corpus' counts of the words of a sorted vocabulary, and of all words; one count a word comes to the driver."""
    counted = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(_vocabulary_counter(vocabulary), "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n")).collect()
    n = {r.word: r.n for r in counted}
    return np.array([n.get(i, 0) for i in range(len(vocabulary))], np.int64), max(1, n.get(-1, 0))


def _known_items(benchmark: DataFrame) -> DataFrame:
    """item_id, text and a key that tells items apart, of items with both."""
    items = benchmark.where("item_id is not null").select("item_id", F.col("text").cast("string").alias("text")).where("text is not null").distinct()
    return items.withColumn("item", F.struct("item_id", F.md5("text").alias("version")))


def _small(benchmark: DataFrame, limit: int) -> bool:
    """Whether the items have at most `limit` words; decided before anything of them comes to the driver."""
    size = _known_items(benchmark).agg(F.sum(F.size(F.split("text", r"[\x00-\x7F&&[^\w]]+", -1))).alias("n")).first().n
    return (size or 0) <= limit


def rare_seeds(docs: DataFrame, benchmark: DataFrame, chance: float = CHANCE) -> tuple[Seeds, pa.Array]:
    """The seeds of a benchmark of bounded size, and the item_ids that their item numbers stand for."""
    rows = _known_items(benchmark).select("item_id", "text").toArrow()
    flat, _, _, first, _ = hashed_words(rows.column("text"))
    ids = pa.concat_arrays(rows.column("item_id").chunks or [pa.array([], rows.schema.field("item_id").type)])
    words = [flat[a:b] for a, b in zip(first[:-1], first[1:])]
    vocabulary, at = np.unique(flat, return_inverse=True)
    if not len(vocabulary):
        return Seeds(np.empty(0, np.uint64), np.empty(0, np.int64), [], words), ids
    count, total = _count_words(docs, vocabulary)
    count, hashes, items, lengths = count[at], [np.empty(0, np.uint64)], [], set()
    for i, (a, b) in enumerate(zip(first[:-1], first[1:])):
        if b > a:
            n, h = item_seeds(flat[a:b], count[a:b], total, len(vocabulary), chance)
            lengths.add(n)
            hashes.append(h)
            items.append(np.full(len(h), i))
    return Seeds(np.concatenate(hashes), np.concatenate([np.empty(0, np.int64), *items]), sorted(lengths), words), ids


def _scanner(seeds: Seeds, ids: pa.Array, threshold: float, mark: bool):
    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                words, _, _, first, _ = hashed_words(part.column(part.schema.get_field_index("text")))
                met = [[np.empty(0, np.int64)] for _ in range(3)]
                for _, grams, where, docs in gram_series(words, first, seeds.lengths):
                    gram, item = seeds.hits(grams)
                    for m, v in zip(met, (docs[gram], item, where[gram])):
                        m.append(v)
                doc, item, where = (np.concatenate(m) for m in met)
                order = np.lexsort((where, item, doc))
                doc, item, where = doc[order], item[order], where[order]
                cut = np.flatnonzero((doc[1:] != doc[:-1]) | (item[1:] != item[:-1])) + 1
                found = []
                for g in np.split(np.arange(len(doc)), cut) if len(doc) else ():
                    d, it = int(doc[g[0]]), int(item[g[0]])
                    best, a, b = align(words[first[d] : first[d + 1]], seeds.words[it], np.unique(where[g] - first[d]))
                    score = best / (MATCH * len(seeds.words[it]))
                    if score >= threshold:
                        found.append((d, it, score, a, b))
                if mark:
                    keep = np.ones(part.num_rows, bool)
                    keep[[f[0] for f in found]] = False
                    keep |= np.asarray(part.column(part.schema.get_field_index("doc_id")).is_null())
                    yield part.filter(pa.array(keep))
                else:
                    rows = pa.array([f[0] for f in found], pa.int64())
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0).take(rows), ids.take(pa.array([f[1] for f in found], pa.int64())), *(pa.array([f[k] for f in found], kind) for k, kind in ((2, pa.float64()), (3, pa.int64()), (4, pa.int64())))],
                        names=["doc_id", "item_id", "score", "start_word", "end_word"],
                    )

    return run


# --- the way of a benchmark too large to travel ------------------------------------------------


def _word_counter(batches):
    """(word, n) of each slice, and (null, all words)."""
    for batch in batches:
        for part in slices(batch, "text"):
            words, n = np.unique(hashed_words(part.column(0))[0].view(np.int64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(np.append(words, 0), mask=np.arange(len(words) + 1) == len(words)), pa.array(np.append(n, n.sum()).astype(np.int64))], names=["word", "n"])


def _item_words(batches):
    for batch in batches:
        for part in slices(batch, "text"):
            words, _, _, first, _ = hashed_words(part.column(1))
            row = np.repeat(np.arange(part.num_rows), np.diff(first))
            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row)), pa.array(words.view(np.int64))], names=["item", "word"])


def _seed_maker(total: int, vocabulary: int, chance: float):
    def run(batches):
        for b in batches:
            words, _, _, first, _ = hashed_words(b.column(1))
            out, size, lengths = [np.empty(0, np.uint64)], [], []
            for i, known in enumerate(b.column(2).to_pylist()):
                own = words[first[i] : first[i + 1]]
                n = {w["word"]: w["n"] for w in known}
                length, h = item_seeds(own, np.array([n.get(w, 0) for w in own.view(np.int64).tolist()], np.int64), total, vocabulary, chance)
                out.append(h)
                size.append(len(h))
                lengths.append(length)
            row = np.repeat(np.arange(b.num_rows), size)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row)), pa.array(np.array(lengths, np.int32)[row]), pa.array(np.concatenate(out).view(np.int64))], names=["item", "n", "gram"])

    return run


def _gram_emitter(lengths: list[int]):
    def run(batches):
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                words, _, _, first, _ = hashed_words(part.column(2))
                for _, grams, where, doc in gram_series(words, first, lengths):
                    d = pa.array(doc)
                    yield pa.RecordBatch.from_arrays([part.column(0).take(d), part.column(1).take(d), pa.array(where - first[doc]), pa.array(grams.view(np.int64))], names=["doc_id", "version", "pos", "gram"])

    return run


def _aligner(threshold: float):
    def run(batches):
        for b in batches:
            get = {c: b.column(i) for i, c in enumerate(b.schema.names)}
            dw, _, _, df, _ = hashed_words(get["text"])
            iw, _, _, itf, _ = hashed_words(get["item_text"])
            out = []
            for r, pos in enumerate(get["pos"].to_pylist()):
                item = iw[itf[r] : itf[r + 1]]
                s, x, y = align(dw[df[r] : df[r + 1]], item, np.unique(np.array(pos)))
                out.append((s / (MATCH * len(item)), x, y))
            s, x, y = (np.array([o[k] for o in out]) for k in range(3))
            t = pa.RecordBatch.from_arrays([get["doc_id"], get["version"], get["item_id"], pa.array(s.astype(float)), pa.array(x.astype(np.int64)), pa.array(y.astype(np.int64))], names=["doc_id", "version", "item_id", "score", "start_word", "end_word"])
            yield t.filter(pa.array(s >= threshold))

    return run


def _joined_hits(src: DataFrame, benchmark: DataFrame, threshold: float, chance: float) -> DataFrame:
    """(doc_id, version, item_id, score, start_word, end_word) of alignments, nothing but lengths and totals on the driver.
    src has doc_id and text; a version is the hash of a text."""
    every, src = src, src.select("doc_id", F.xxhash64("text").alias("version"), "text").distinct()
    items = written(_known_items(benchmark), "items")
    struct = items.schema["item"].dataType.simpleString()
    used = written(items.select("item", "text").mapInArrow(_item_words, f"item {struct}, word bigint").distinct(), "item_words")
    counts = written(every.select("text").mapInArrow(_word_counter, "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n")), "counts")
    total = counts.where("word is null").agg(F.sum("n").alias("n")).first().n or 0
    size = used.select("word").distinct().count()
    known = used.join(counts, "word", "left").groupBy("item").agg(F.collect_list(F.struct("word", F.coalesce("n", F.lit(0)).alias("n"))).alias("known"))
    seeds = items.select("item", "text").join(known, "item").select("item", "text", "known").mapInArrow(_seed_maker(max(1, total), size, chance), f"item {struct}, n int, gram bigint")
    seeds = written(seeds, "item_seeds")
    lengths = sorted(r.n for r in seeds.select("n").distinct().collect())  # at most as many as the longest item has words
    grams = src.select("doc_id", "version", "text").mapInArrow(_gram_emitter(lengths), output_schema(src, ["doc_id"], "version bigint, pos bigint, gram bigint"))
    meet = grams.join(seeds.select("item", "gram"), "gram").groupBy("doc_id", "version", "item").agg(F.collect_set("pos").alias("pos"))
    meet = written(meet, "seeds").join(items.select("item", "item_id", F.col("text").alias("item_text")), "item").join(src, ["doc_id", "version"])
    kind = output_schema(meet, ["doc_id", "version", "item_id"], "score double, start_word bigint, end_word bigint")
    return meet.select("doc_id", "version", "item_id", "pos", "text", "item_text").mapInArrow(_aligner(threshold), kind)


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, chance: float = CHANCE, broadcast_limit: int = BROADCAST_LIMIT) -> DataFrame:
    """(doc_id, item_id, score, start_word, end_word) of the best alignment of every document and item that reaches the threshold."""
    src = docs.where("doc_id is not null").select("doc_id", F.col("text").cast("string").alias("text"))
    if _small(benchmark, broadcast_limit):
        seeds, ids = rare_seeds(src, benchmark, chance)
        item_kind = benchmark.schema["item_id"].dataType.simpleString()
        hits = src.mapInArrow(_scanner(seeds, ids, threshold, False), output_schema(src, ["doc_id"], f"item_id {item_kind}, score double, start_word bigint, end_word bigint"))
    else:
        hits = _joined_hits(src, benchmark, threshold, chance)
    best = F.max(F.struct("score", "start_word", "end_word")).alias("x")
    return hits.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "x.score", "x.start_word", "x.end_word")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, chance: float = CHANCE, broadcast_limit: int = BROADCAST_LIMIT) -> DataFrame:
    """docs without those rows in whose text any item reaches the threshold."""
    plain = [f"c{i}" if c not in ("doc_id", "text") else c for i, c in enumerate(docs.columns)]
    src = docs.toDF(*plain).withColumn("text", F.col("text").cast("string"))
    named = src.where("doc_id is not null").select("doc_id", "text")
    if _small(benchmark, broadcast_limit):
        seeds, ids = rare_seeds(named, benchmark, chance)
        return src.mapInArrow(_scanner(seeds, ids, threshold, True), src.schema).toDF(*docs.columns)
    gone = _joined_hits(named, benchmark, threshold, chance).select("doc_id", "version").distinct()
    return src.withColumn("version", F.xxhash64("text")).join(gone, ["doc_id", "version"], "left_anti").select(plain).toDF(*docs.columns)
