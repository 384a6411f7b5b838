"""Toxic documents, after undoing obfuscated spelling.

1. A character trigram model is counted over the words of the whole corpus.
2. Tokens that may hide a word (a digit, symbol or currency sign between letters or in place of one, a letter three
   times in a row, letters spaced out one by one) become lattices: a leetspeak sign may stand for its
   letters, a separator for nothing, a run for one or two letters, a gap for nothing or
   itself.  Viterbi decoding finds the likeliest reading under the model, of the whole token or stretch however long
   it is.  A token without any of these has one reading, itself, so it needs no decoding.
3. From labelled documents (at most `max_labelled`, taken by hash of doc_id) features of words
   get weights: whole words, prefixes, 5-grams with word boundaries.  A weight is the change
   of the log-odds that a document is toxic.  Of toxic documents that are copies of each other, or nearly so, one
   counts: else all words of a document that is copied often would seem to make documents toxic.
4. A document's score starts at the prior log-odds and adds a weight for each distinct word, as written and
   as restored, that has a feature a likelihood-ratio test found significant; the most
   specific known feature of the word decides.  The document is toxic from `threshold` on.

Defined cases: a null or empty text, or one without letters, scores the prior.  Every row gets a
score, also those without doc_id and repeated ones.  Without labels of both kinds nothing
can be learned and every score is the same low value.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrowtext import column_bytes, fold_case, mix, slices, span_hashes, word_spans
from .minhash_dedup import sketches
from .shared import output_schema, written

MAX_LABELLED = 20_000
THRESHOLD = 4.0  # log-odds; chosen on labelled documents held out from the fit
LEET = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "{": "c", "€": "e", "£": "l"}
SEPARATORS = set(".-_*~^'`,+|/\\")
SIZE = 29  # boundary, a-z, other letters, unknown

_LETTER = np.zeros(256, bool)
for _c in range(256):
    _LETTER[_c] = _c >= 0x80 or chr(_c).isalpha()
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_CODE = np.zeros(256, np.uint8)
for _c in range(256):
    _CODE[_c] = _c - 96 if 97 <= _c <= 122 else 27 if _c >= 0x80 else 0


# --- the character model -------------------------------------------------------------------


def _trigram_counter(batches):
    total = np.zeros(SIZE**3, np.int64)
    for batch in batches:
        for part in slices(batch, "text"):
            raw, offsets = column_bytes(part.column(0))
            low = fold_case(raw)
            keep = (low & 0xC0) != 0x80  # one code for each character
            code = _CODE[low]
            begin = offsets[:-1][np.diff(offsets) > 0]
            code = np.insert(code[keep], np.searchsorted(np.flatnonzero(keep), begin), 0).astype(np.int64)
            code = np.concatenate([[0], code, [0]])
            a, b, c = code[:-2], code[1:-1], code[2:]
            inner = b != 0
            total += np.bincount((a * SIZE * SIZE + b * SIZE + c)[inner], minlength=SIZE**3)
            total += np.bincount(c[~inner & (c != 0)], minlength=SIZE**3)  # a word's first letter, after (boundary, boundary)
    k = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(k.astype(np.int32)), pa.array(total[k])], names=["gram", "n"])


def character_model(docs: DataFrame) -> np.ndarray:
    """log P(c | a, b) over 29 symbols, from every word of every document (interpolated trigrams)."""
    counted = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(_trigram_counter, "gram int, n bigint").groupBy("gram").agg(F.sum("n").alias("n"))
    tri = np.zeros(SIZE**3)
    for r in counted.collect():  # at most 29^3 rows
        tri[r.gram] = r.n
    tri = tri.reshape(SIZE, SIZE, SIZE)
    bi, uni = tri.sum(0), tri.sum((0, 1))
    p1 = (uni + 1) / (uni.sum() + SIZE)
    p2 = (bi + 20 * p1) / (bi.sum(1, keepdims=True) + 20)
    p3 = (tri + 10 * p2[None]) / (tri.sum(2, keepdims=True) + 10)
    return np.log(p3)


def _symbol(c: str) -> int:
    return ord(c) - 96 if "a" <= c <= "z" else 27 if c.isalpha() else 28


def lattice(token: str) -> list[list[str]]:
    """The readings of each stretch of a token: letters stand for themselves, a run of three or more
    of one letter for one or two, a leetspeak sign for its letters or for itself, a separator for nothing."""
    token = token.lower()
    out: list[list[str]] = []
    i = 0
    while i < len(token):
        c, j = token[i], i
        while j < len(token) and token[j] == c:
            j += 1
        n, inner = j - i, 0 < i and j < len(token)
        if c.isalpha():
            out += [[c, c + c]] if n >= 3 else [[c]] * n
        else:
            reads = [x * min(n, 2) for x in LEET.get(c, "")] + ([x for x in LEET.get(c, "")] if n > 1 else [])
            if c in SEPARATORS or c.isspace():
                reads.append("")
            reads.append(c * min(n, 3))
            out.append(reads if inner or c in LEET else [c * n])
        i = j
    return out


def decode(token: str, model: np.ndarray, keep: float = -9.0) -> str:
    """The likeliest reading of a token.  A sign that is kept as it is costs `keep` and ends a word."""
    beam: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}  # last two symbols: score, (reading, what came before)
    for reads in lattice(token):
        nxt: dict[tuple[int, int], tuple[float, tuple | None]] = {}
        for (a, b), (score, before) in beam.items():
            for r in reads:
                x, y, s = a, b, score
                for c in r:
                    k = _symbol(c)
                    if k == 28:
                        s += keep + (model[x, y, 0] if y else 0.0)
                        x, y = 0, 0
                    else:
                        s += model[x, y, k]
                        x, y = y, k
                if (x, y) not in nxt or s > nxt[x, y][0]:
                    nxt[x, y] = (s, (r, before))
        beam = nxt
    link = max(((s + (model[a, b, 0] if b else 0.0)), i, link) for i, ((a, b), (s, link)) in enumerate(beam.items()))[2]
    said = []
    while link:
        said.append(link[0])
        link = link[1]
    return "".join(reversed(said))


def _all(raw: np.ndarray, what: bytes) -> np.ndarray:
    """Where the bytes `what` occur."""
    at = np.flatnonzero(raw[: len(raw) - len(what) + 1] == what[0])
    for k in range(1, len(what)):
        at = at[raw[at + k] == what[k]]
    return at


class Restorer:
    """Finds the tokens of a text slice that may hide words and decodes each distinct one once."""

    def __init__(self, model: np.ndarray, limit: int = 50_000):
        self.model, self.limit, self.known = model, limit, {}

    def read(self, token: str) -> str:
        if len(token) > 100:  # hardly seen twice
            return decode(token, self.model)
        got = self.known.get(token)
        if got is None:
            if len(self.known) > self.limit:
                self.known.clear()
            got = self.known[token] = decode(token, self.model)
        return got

    @staticmethod
    def suspects(raw: np.ndarray, low: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int]]:
        """Byte spans to decode, in order: single tokens, and stretches of spaced letters."""
        n = len(raw)
        if n < 3:
            return []
        letter, space = _LETTER[raw], _SPACE[raw]
        euro, pound = _all(raw, "€".encode()), _all(raw, "£".encode())
        for at, size in ((euro, 3), (pound, 2)):
            for k in range(size):
                letter[at + k] = False
        sign = ~letter & ~space
        first = np.zeros(n, bool)
        first[offsets[:-1][offsets[:-1] < n]] = True
        begins = ~space
        begins[1:] &= space[:-1] | first[1:]
        starts = np.flatnonzero(begins)
        if not len(starts):
            return []
        stop = space.copy()
        stop[first] = True
        stops = np.append(np.flatnonzero(stop), n)
        ends = stops[np.searchsorted(stops, starts, "right")]

        def inside(where):  # index of the token of each position
            return np.searchsorted(starts, where, "right") - 1

        bad = np.zeros(len(starts), bool)
        opened = np.flatnonzero(sign[1:] & letter[:-1]) + 1
        closed = np.flatnonzero(sign[:-1] & letter[1:])
        lead = np.full(len(starts), n)
        t = inside(opened)[::-1]
        lead[t] = opened[::-1]
        last = np.full(len(starts), -1)
        last[inside(closed)] = closed
        bad |= last >= lead
        leet = np.zeros(256, bool)
        leet[[ord(c) for c in "013456789@$!|+({"]] = True
        leet[[0xE2, 0xC2]] = True  # of signs, only the two currencies begin so
        head = leet[raw[starts]] & sign[starts] & (last >= starts)
        bad |= head
        tail = leet.copy()
        tail[[ord(c) for c in "!|+({"]] = False  # after a word these are punctuation
        alone = raw[np.minimum(opened + 1, n - 1)] != raw[opened]  # a run of one sign is decoration
        bad[inside(opened[tail[raw[opened]] & alone])] = True
        triple = np.flatnonzero(letter[2:] & (low[2:] == low[1:-1]) & (low[1:-1] == low[:-2]) & (raw[2:] < 0x80))
        t = inside(triple)
        bad[t[triple + 2 < ends[t]]] = True
        # stretches of at least three one-letter tokens with single gaps
        size = ends - starts
        wide = (raw[starts] >= 0xC2).astype(np.int64)
        single = (size == 1 + wide) & (letter[starts] | leet[raw[starts]]) | (size == 3) & np.isin(starts, euro)
        near = np.zeros(len(starts), bool)
        near[1:] = single[1:] & single[:-1] & (starts[1:] - ends[:-1] == 1) & (raw[np.maximum(starts[1:] - 1, 0)] == 32)
        spans = [(int(starts[i]), int(ends[i])) for i in np.flatnonzero(bad)]
        i = np.flatnonzero(near)
        if len(i):
            cut = np.flatnonzero(np.diff(i) > 1) + 1
            for g in np.split(i, cut):
                if len(g) >= 2:
                    spans.append((int(starts[g[0] - 1]), int(ends[g[-1]])))
        return spans

    def restored(self, raw: np.ndarray, low: np.ndarray, offsets: np.ndarray) -> tuple[list[int], list[str]]:
        """(document, reading) of every suspect whose reading differs from what is written."""
        rows, texts = [], []
        spans = self.suspects(raw, low, offsets)
        if spans:
            data = raw.tobytes()
            doc = np.searchsorted(offsets, [s for s, _ in spans], "right") - 1
            for (s, e), d in zip(spans, doc.tolist()):
                token = data[s:e].decode("utf-8", "ignore")
                said = self.read(token)
                if said != token.lower():
                    rows.append(d)
                    texts.append(said)
        return rows, texts


# --- features of words -----------------------------------------------------------------------

PREFIXES = (11, 9, 7)
_BITS = 22


def _tagged(h: np.ndarray, tag: int) -> np.ndarray:
    return mix(h ^ np.uint64(tag * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) >> np.uint64(16)


class Features:
    """Of the words of some texts: the document of each, 48-bit hashes of the whole word and of its prefixes
    (most specific first), and hashes of the 5-grams within a word and its two boundaries."""

    def __init__(self, low: np.ndarray, offsets: np.ndarray):
        starts, ends, first = word_spans(low, offsets, _LETTER)
        self.doc = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
        self.levels = [_tagged(span_hashes(low, starts, ends), 1)]
        self.levels += [_tagged(span_hashes(low, starts, np.minimum(starts + p, ends)), p) for p in PREFIXES]
        # the texts apart, blanks for all but letters, room at both ends
        n, gap = len(low), np.arange(len(offsets) - 1)
        wide = np.full(n + len(gap) + 5, 32, np.uint8)
        wide[np.arange(n) + np.repeat(gap, np.diff(offsets)) + 1] = np.where(_LETTER[low], low, 32)
        w, blank = wide.astype(np.uint64), wide == 32
        code = w[:-4] | w[1:-3] << np.uint64(8) | w[2:-2] << np.uint64(16) | w[3:-1] << np.uint64(24) | w[4:] << np.uint64(32)
        b0, b1, b2, b3 = (blank[i : len(wide) - 4 + i] for i in range(4))
        short = b0 & ~b1 & (b2 | b3)
        at = np.flatnonzero((~b1 & ~b2 & ~b3) | short)
        value, s = code[at], short[at]
        value[s] = np.where(b2[at[s]], value[s] & np.uint64(0xFFFFFF), value[s] & np.uint64(0xFFFFFFFF)) | np.uint64(1 << 40)
        run = ~blank
        run[1:] &= blank[:-1]
        self.gram, self.gram_word = _tagged(value, 2), np.cumsum(run)[at + 1] - 1


def _both(column, restorer: Restorer) -> list[tuple[Features, np.ndarray]]:
    """Features of the texts as written and, where they differ, as restored; each with its words' documents."""
    raw, offsets = column_bytes(column)
    low = fold_case(raw)
    f = Features(low, offsets)
    out = [(f, f.doc)]
    rows, texts = restorer.restored(raw, low, offsets)
    if rows:
        more, off = column_bytes(pa.array(texts))
        f = Features(fold_case(more), off)
        out.append((f, np.array(rows)[f.doc]))
    return out


def _gram_counter(model: np.ndarray):
    def run(batches):
        restorer = Restorer(model)
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                toxic = np.asarray(part.column(1)).astype(bool)
                keys = [x << np.uint64(16) | d.astype(np.uint64) for f, doc in _both(part.column(0), restorer) for x, d in [*((h, doc) for h in f.levels), (f.gram, doc[f.gram_word])]]
                keys = np.unique(np.concatenate(keys))
                bad = toxic[(keys & np.uint64(0xFFFF)).astype(np.int64)]
                gram, at = np.unique(keys >> np.uint64(16), return_inverse=True)
                n_bad = np.bincount(at[bad], minlength=len(gram))
                n_good = np.bincount(at[~bad], minlength=len(gram))
                head = (np.append(gram.astype(np.int64), -1), np.append(n_bad, toxic.sum()), np.append(n_good, (~toxic).sum()))
                yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in head], names=["gram", "bad", "good"])

    return run


class Weights:
    """What labelled documents say: for each feature that at least `support` of them hold, the change of the
    log-odds of "toxic" and whether a likelihood-ratio test finds it significant."""

    def __init__(self, keys=(), change=(), significant=(), prior: float = -50.0):
        self.keys, self.change = np.array(keys, np.uint64), np.array(change, float)
        self.prior = prior
        self.hot = self.keys[np.array(significant, bool)] if len(self.keys) else self.keys

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
        return self.keys[at] == h, at


def _copies(sketched: pa.Table, share: float = 0.5) -> np.ndarray:
    """Rows whose sketch shares that part of its values with the sketch of one row before it."""
    sketch = sketched.column("sketch").combine_chunks()
    size = np.asarray(sketch.value_lengths()).astype(np.int64)
    row, value = np.repeat(np.arange(len(size)), size), np.asarray(sketch.flatten())
    order = np.lexsort((row, value))
    row, value = row[order], value[order]
    first = np.maximum.accumulate(np.where(np.diff(value, prepend=value[:1] - 1) != 0, np.arange(len(value)), 0))
    pair, n = np.unique(row[first] * len(size) + row, return_counts=True)
    a, b = pair // max(1, len(size)), pair % max(1, len(size))
    return np.unique(b[(a != b) & (n >= share * size[b])])


def fit(docs: DataFrame, labels: DataFrame, model: np.ndarray, max_labelled: int = MAX_LABELLED, support: int = 8, margin: float = 5.0) -> Weights:
    """The weights; significant is a likelihood ratio beyond log(number of features) + margin."""
    known = labels.where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    # the sample has at most max_labelled rows of two numbers
    own = docs.where("doc_id is not null").select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(sample), "doc_id")
    bad = sketches(own.where("toxic = 1")).select("doc_id", "version", "sketch").dropDuplicates(["doc_id", "version"]).orderBy("doc_id", "version").toArrow()
    copies = docs.sparkSession.createDataFrame(bad.select(["doc_id", "version"]).take(pa.array(_copies(bad))), output_schema(own, ["doc_id"], "version bigint"))
    own = own.withColumn("version", F.xxhash64("text")).join(F.broadcast(copies), ["doc_id", "version"], "left_anti").dropDuplicates(["doc_id", "version"]).select("text", "toxic")
    counted = own.mapInArrow(_gram_counter(model), "gram bigint, bad bigint, good bigint").groupBy("gram").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    counted = written(counted, "features")
    total = counted.where("gram = -1").first()
    if not total or not total.bad or not total.good:
        return Weights()
    share, size = total.bad / (total.bad + total.good), counted.count()
    prior = math.log(total.bad / total.good)
    p = F.col("bad") / (F.col("bad") + F.col("good"))
    ratio = F.when(F.col("bad") > 0, F.col("bad") * F.log(p / share)).otherwise(0.0) + F.when(F.col("good") > 0, F.col("good") * F.log((1 - p) / (1 - share))).otherwise(0.0)
    change = F.log((F.col("bad") + 0.5) / (F.col("good") + 0.5)) - prior
    # The labelled sample is bounded, and so is the number of its features.
    kept = counted.where((F.col("gram") >= 0) & (F.col("bad") + F.col("good") >= support)).select("gram", change.alias("w"), ((p > share) & (ratio > math.log(size) + margin)).alias("s")).toArrow()
    gram, w, s = (kept.column(c).to_numpy() for c in ("gram", "w", "s"))
    order = np.argsort(gram)
    return Weights(gram[order], w[order], s[order], prior)


def _bit(value: np.ndarray) -> np.ndarray:
    return value >> np.uint64(48 - _BITS)


def word_values(low: np.ndarray, offsets: np.ndarray, weights: Weights, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, weight) of every distinct word of a document whose weight is positive.  Features are
    looked up once for each distinct word of all the texts."""

    def likely(h: np.ndarray) -> np.ndarray:
        at = np.flatnonzero(hot[_bit(h)])
        return at[np.isin(h[at], weights.hot)]

    starts, ends, first = word_spans(low, offsets, _LETTER)
    if not len(starts):
        return np.empty(0, np.int64), np.empty(0)
    keys, where, back = np.unique(span_hashes(low, starts, ends), return_index=True, return_inverse=True)
    size = ends[where] - starts[where] + 1  # with a blank behind each
    begin = np.cumsum(size) - size
    own = low[np.minimum(np.repeat(starts[where] - begin, size) + np.arange(size.sum()), len(low) - 1)]
    own[begin + size - 1] = 32
    f = Features(own, np.array([0, len(own)]))
    gram = likely(f.gram)
    word = np.unique(np.concatenate([f.gram_word[gram], *map(likely, f.levels)]).astype(np.int64))
    value, open_ = np.zeros(len(word)), np.ones(len(word), bool)
    for h in f.levels:  # the most specific feature that is known decides
        found, at = weights.find(h[word])
        value[found & open_] = weights.change[at[found & open_]]
        open_ &= ~found
    best = np.zeros(len(keys))
    found, at = weights.find(f.gram[gram])
    np.maximum.at(best, f.gram_word[gram][found], weights.change[at[found]])
    value[open_] = best[word[open_]]
    values = np.zeros(len(keys))
    values[word] = value
    at = np.flatnonzero(values[back] > 0)
    pair = np.unique((np.searchsorted(first, at, "right") - 1) * len(keys) + back[at])
    return pair // len(keys), values[pair % len(keys)]


def _scorer(model: np.ndarray, weights: Weights):
    def run(batches):
        hot = np.zeros(1 << _BITS, bool)
        hot[_bit(weights.hot)] = True
        restorer = Restorer(model)
        for batch in batches:
            for part in slices(batch, "text"):
                n = part.num_rows
                total, words = np.full(n, weights.prior), np.zeros(n, np.int64)
                if len(weights.hot):
                    raw, offsets = column_bytes(part.column(part.schema.get_field_index("text")))
                    low = fold_case(raw)
                    got = [word_values(low, offsets, weights, hot)]
                    rows, texts = restorer.restored(raw, low, offsets)
                    if rows:  # the readings of one document one after the other, so that each word counts once
                        rows = np.array(rows)
                        order = np.argsort(rows, kind="stable")
                        own, at = np.unique(rows[order], return_index=True)
                        more, off = column_bytes(pa.array([" ".join(texts[i] for i in g) for g in np.split(order, at[1:])]))
                        doc, value = word_values(fold_case(more), off, weights, hot)
                        got.append((own[doc], value))
                    for doc, value in got:
                        np.add.at(total, doc, value)
                        words += np.bincount(doc, minlength=n)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(total), pa.array(words)], names=[*part.schema.names, "toxic_score", "toxic_words"])

    return run


def _scored(docs: DataFrame, labels: DataFrame, max_labelled: int) -> DataFrame:
    docs = docs.withColumn("text", F.col("text").cast("string"))
    model = character_model(docs)
    return docs.mapInArrow(_scorer(model, fit(docs, labels, model, max_labelled)), output_schema(docs, docs.columns, "toxic_score double, toxic_words bigint"))


def toxic_documents(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """doc_id, toxic_score, toxic_words and the verdict of every row."""
    return _scored(docs.select("doc_id", "text"), labels, max_labelled).select("doc_id", "toxic_score", "toxic_words", (F.col("toxic_score") >= threshold).alias("toxic"))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """docs without the toxic ones; columns and their names, whatever they are, as they were."""
    plain = [f"c{i}" if c not in ("doc_id", "text") else c for i, c in enumerate(docs.columns)]
    scored = _scored(docs.toDF(*plain), labels, max_labelled)
    return scored.where(F.col("toxic_score") < threshold).select(plain).toDF(*docs.columns)
