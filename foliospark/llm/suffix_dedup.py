"""Passages that repeat, from a sparse suffix array made by a common-prefix-aware distributed merge sort.

1. Anchors.  Every window of `WINDOW` consecutive word 4-grams gives its least hash (the first of equal ones) as an
   anchor, so equal passages have equal anchors, and every passage of at least
   ``min_words`` words holds an anchor with `PREFIX` words of it behind it.  Only suffixes that
   begin at anchors are sorted, about 2 in `WINDOW` + 1 of all.
2. A suffix is compared by `PREFIX` words, as one byte a word, before them four bytes of a hash
   of the anchor's 4-gram (so that ranges of the order are of even size), behind them
   a 64-bit hash of all of them (so that equal keys mean equal words).
3. Each task sorts its suffixes into runs of about `RUN`.  Of suffixes of a run with equal keys and equal passages around them
   only the first goes on, however often a passage is copied; the others are kept aside as its members.  The run is cut by ranges
   of the order and front-coded: for every suffix the length it shares with its predecessor, and only the rest.
4. The pieces of a range meet in one task.  A loser tree merges them.  Each loser keeps the
   length it shares with the suffix that beat it: of two candidates the one that shares
   more with the last winner comes first, and only where both share the same is
   anything compared, and then from that length on.  Prefixes known to be equal are never read again.
5. Suffixes of one key may repeat.  Each carries two bytes of the hash of every word beside its key that the
   passages of `min_words` words which gave the anchor hold.  Each of these passages points to the earliest
   equal one of the key's suffixes in the order (doc_id, word), so every passage of `min_words` words that
   an earlier place has is found, whatever other places share of it.  Members have the sources of their first, and it
   itself where it has none.
6. Passages that overlap and have the same source and offset make chains: repeated passages.  Chains are
   extended to both sides, word by word, up to `min_words` words, where a part of a passage has an earlier source.

Defined cases: rows without doc_id, and null or empty texts, repeat nothing.  Of rows that repeat a doc_id the
least text counts.  A passage may repeat within one document; its first occurrence is the source.  Ids may be of any
type that has an order.  An empty table has no passages.  Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrowtext import _R, U64, gram_hashes, hashed_words, mix, powers, slices, span_hashes, trim
from .shared import one_text_per_id, written

MIN_WORDS = 50
PREFIX = 30
GRAM = 4
RUN = 100_000
_LEAD = 4
_KEY = _LEAD + PREFIX + 8


def window(min_words: int) -> int:
    """How many 4-grams a window may have for an anchor to lie in the first words of a passage."""
    return min_words - PREFIX + 1


def _first_least(x: np.ndarray, w: int) -> np.ndarray:
    """Place of the first least element of all windows of w elements, by doubling."""
    size, at = 1, np.arange(len(x))
    while size < w:
        step = min(size, w - size)
        a, b = at[:-step], at[step:]
        at = np.where(x[a] <= x[b], a, b)
        size += step
    return at


def anchors(words: np.ndarray, first: np.ndarray, min_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Positions of anchors with PREFIX words behind them, document of each, hash of the 4-gram there, least and greatest number of
    words that a passage of min_words words which gave the anchor has before it."""
    w = window(min_words)
    grams, at, starts = gram_hashes(words, first, GRAM)
    if len(grams) < w:
        z = np.empty(0, np.int64)
        return z, z, np.empty(0, U64), z, z
    # of windows in order the places never go back, so those of one anchor are neighbours
    place = _first_least(grams, w)
    begin = np.flatnonzero(np.diff(place, prepend=-1))
    pick, end = place[begin], np.append(begin[1:], len(place)) - 1
    doc = np.searchsorted(starts, pick, "right") - 1
    pos = at[pick]
    most = np.minimum(pick - begin, pos - first[doc])
    least = np.maximum(pick - end, min_words - (first[doc + 1] - pos))
    fits = least <= most
    return pos[fits], doc[fits], grams[pick[fits]], least[fits], most[fits]


def suffix_keys(words: np.ndarray, pos: np.ndarray, grams: np.ndarray) -> np.ndarray:
    """One row of _KEY bytes for each suffix; the order of rows as bytes is the order of suffixes."""
    key = np.empty((len(pos), _KEY), np.uint8)
    lead = (mix(grams ^ U64(0x5BF03635)) >> U64(32)).astype(">u4")
    key[:, :_LEAD] = lead.view(np.uint8).reshape(-1, _LEAD)
    code = (words >> U64(23)).astype(np.uint8)
    key[:, _LEAD : _LEAD + PREFIX] = code[pos[:, None] + np.arange(PREFIX)]
    key[:, _LEAD + PREFIX :] = span_hashes(words, pos, pos + PREFIX).astype(">u8").view(np.uint8).reshape(-1, 8)
    return key


def suffix_sides(words: np.ndarray, pos: np.ndarray, least: np.ndarray, most: np.ndarray, min_words: int) -> np.ndarray:
    """Codes of the min_words - PREFIX words before each key and behind it; 0 for those that none of the anchor's passages holds."""
    reach = min_words - PREFIX
    step = np.arange(2 * reach)
    held = (step >= reach - most[:, None]) & (step < 2 * reach - least[:, None])
    at = np.where(held, pos[:, None] + np.where(step < reach, step - reach, step - reach + PREFIX), 0)
    return np.where(held, (words >> U64(17)).astype(np.uint16)[at], np.uint16(0))


def earliest_passages(group: np.ndarray, least: np.ndarray, most: np.ndarray, sides: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(suffix, source, least, greatest number of words before the key): runs of passages over a suffix's key for which the
    source is the earliest suffix of the group with an equal passage.  Suffixes are sorted by group, then place."""
    reach = sides.shape[1] // 2
    p, inv = powers(2 * reach + 1)
    total = np.zeros((len(group), 2 * reach + 1), U64)
    np.cumsum((sides.astype(U64) + U64(1)) * p[: 2 * reach], axis=1, out=total[:, 1:])
    source, since = np.full(len(group), -1, np.int64), np.zeros(len(group), np.int64)
    out = [[], [], [], []]
    for before in range(reach + 2):
        now = np.full(len(group), -1, np.int64)
        row = np.flatnonzero((least <= before) & (before <= most))
        if len(row):
            lo = reach - before
            h = (total[row, lo + reach] - total[row, lo]) * inv[lo]
            order = np.lexsort((h, group[row]))  # stable: equal passages stay in the order of their places
            row, h = row[order], h[order]
            new = np.ones(len(row), bool)
            new[1:] = (group[row[1:]] != group[row[:-1]]) | (h[1:] != h[:-1])
            head = row[np.maximum.accumulate(np.where(new, np.arange(len(row)), 0))]
            now[row[~new]] = head[~new]
        changed = now != source
        ended = np.flatnonzero(changed & (source >= 0))
        for o, v in zip(out, (ended, source[ended], since[ended], np.full(len(ended), before - 1))):
            o.append(v)
        source, since = now, np.where(changed, before, since)
    return tuple(np.concatenate(o) for o in out)


def front_code(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(shared length with the row before, remaining bytes of all rows) of sorted rows."""
    shared = np.zeros(len(keys), np.uint8)
    if len(keys) > 1:
        differ = keys[1:] != keys[:-1]
        shared[1:] = np.where(differ.any(1), differ.argmax(1), keys.shape[1])
    return shared, keys[np.arange(keys.shape[1]) >= shared[:, None]]


def front_decode(shared: np.ndarray, rest: np.ndarray, width: int = _KEY) -> np.ndarray:
    keys = np.zeros((len(shared), width), np.uint8)
    own = np.arange(width) >= shared[:, None]
    keys[own] = rest
    row = np.arange(len(shared))
    for j in range(width):
        keys[:, j] = keys[np.maximum.accumulate(np.where(own[:, j], row, 0)), j]
    return keys


def _sorted_rows(keys: np.ndarray, doc: np.ndarray, pos: np.ndarray) -> np.ndarray:
    head = np.ascontiguousarray(keys[:, :8]).view(">u8").ravel().astype(U64)
    order = np.lexsort((pos, doc, head))
    head = head[order]
    tie = np.zeros(len(order), bool)
    tie[1:] = head[1:] == head[:-1]
    if tie.any():  # few: suffixes that share eight bytes are put right by all their bytes
        both = tie.copy()
        both[:-1] |= tie[1:]
        at = np.flatnonzero(both)
        own = order[at]
        whole = np.ascontiguousarray(keys[own]).view(f"S{keys.shape[1]}").ravel()
        # a zero byte at the end doesn't count in "S", which only makes ties that the hash before it has settled
        order[at] = own[np.lexsort((pos[own], doc[own], whole))]
    return order


def _alike(keys: np.ndarray, reach: np.ndarray, sides: np.ndarray) -> np.ndarray:
    """For each row of sorted suffixes the first with an equal key, reach and sides; sides by a 64-bit hash."""
    first = np.arange(len(keys))
    tie = np.zeros(len(keys), bool)
    tie[1:] = (keys[1:] == keys[:-1]).all(1)
    if not tie.any():
        return first
    group = np.cumsum(~tie)
    both = tie.copy()
    both[:-1] |= tie[1:]
    at = np.flatnonzero(both)
    h = reach[at, 0].astype(U64) << U64(32) | reach[at, 1].astype(U64)
    for k in range(sides.shape[1]):  # column by column: a table of 64-bit numbers would take much memory
        h = h * U64(_R) + sides[at, k]
    h = mix(h)
    order = np.lexsort((h, group[at]))  # stable: equal ones stay in the order of their places
    g, x = group[at][order], h[order]
    new = np.ones(len(order), bool)
    new[1:] = (g[1:] != g[:-1]) | (x[1:] != x[:-1])
    first[at[order]] = at[order][np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
    return first


def _run_maker(min_words: int, ranges: int):
    def cut(parts):
        keys, doc, pos, reach, sides = (np.concatenate([p[k] for p in parts]) for k in range(5))
        parts.clear()
        trim()
        order = _sorted_rows(keys, doc, pos)
        keys, doc, pos, reach, sides = keys[order], doc[order].astype(np.int64), pos[order].astype(np.int32), reach[order], sides[order]
        first = _alike(keys, reach, sides)
        own = first == np.arange(len(first))
        member = np.flatnonzero(~own)
        several = np.zeros(len(first), np.int32)
        several[first[member]] = 1
        kept = [(doc[member], pos[member], doc[first[member]], pos[first[member]])]
        keys, doc, pos, sides = keys[own], doc[own], pos[own], sides[own]
        reach = np.concatenate([reach[own], several[own][:, None]], axis=1).astype(np.int32)
        lead = np.ascontiguousarray(keys[:, :_LEAD]).view(">u4").ravel().astype(np.int64)
        at = np.searchsorted(lead * ranges >> 32, np.arange(ranges + 1))
        rows = np.flatnonzero(at[:-1] < at[1:]).tolist()
        out = [[], [], [], [], [], []]
        for k in rows:
            s = slice(at[k], at[k + 1])
            shared, rest = front_code(keys[s])
            for o, v in zip(out, (shared, rest, doc[s], pos[s], reach[s], sides[s])):
                o.append(v.tobytes())
        for d, p, fd, fp in kept if len(member) else ():
            rows.append(-1 - int(d[0]) % (1 << 30))
            for o, v in zip(out, (b"", fd.tobytes(), d.tobytes(), p.tobytes(), fp.tobytes(), b"")):
                o.append(v)
        return pa.RecordBatch.from_arrays([pa.array(rows, pa.int32()), *(pa.array(o, pa.binary()) for o in out)], names=["part", "shared", "rest", "doc", "pos", "reach", "sides"])

    def run(batches):
        held, n = [], 0
        for batch in batches:
            for part in slices(batch, "text"):
                words, _, _, first, _ = hashed_words(part.column(1))
                pos, doc, grams, least, most = anchors(words, first, min_words)
                if not len(pos):
                    continue
                held.append((suffix_keys(words, pos, grams), np.asarray(part.column(0))[doc], pos - first[doc], np.stack([least, most], 1).astype(np.int32), suffix_sides(words, pos, least, most, min_words)))
                n += len(pos)
                if n >= RUN:
                    yield cut(held)
                    held, n = [], 0
        if held:
            yield cut(held)

    return run


def _members(t: pa.Table) -> pa.Table:
    """Rows like the merger's for the suffixes that runs kept aside: their firsts in the place of sources, and no reach."""
    cols = [np.concatenate([np.frombuffer(x.as_buffer(), kind) for x in t.column(c)]).astype(np.int64) for c, kind in (("doc", np.int64), ("pos", np.int32), ("rest", np.int64), ("reach", np.int32))]
    none = np.full(len(cols[0]), -1)
    return pa.table([pa.array(x) for x in (cols[0], cols[1], none, none, cols[2], cols[3])], names=["doc_id", "pos", "least", "most", "kept_doc_id", "kept_pos"])


class LoserTree:
    """Merges sorted runs of byte strings, each with the length every string shares with the one before it.

    `keys[r]` ends with None.  A node holds the run that lost there and the length its head
    shares with the head that beat it."""

    def __init__(self, keys: list[list[bytes | None]], shared: list[list[int]]):
        self.keys, self.shared, self.at = keys, shared, [0] * len(keys)
        self.size = 1
        while self.size < len(keys):
            self.size *= 2
        self.loser, self.lcp = [-1] * self.size, [0] * self.size
        self.winner, self.winner_lcp = self._build(1)
        self.compared = 0

    def _head(self, r: int) -> bytes | None:
        return self.keys[r][self.at[r]] if 0 <= r < len(self.keys) else None

    def _build(self, node: int) -> tuple[int, int]:
        if node >= self.size:
            return node - self.size, 0
        (x, _), (y, _) = self._build(2 * node), self._build(2 * node + 1)
        win, lose, h = self._beat(x, y, 0)
        self.loser[node], self.lcp[node] = lose, h
        return win, 0

    def _beat(self, x: int, y: int, h: int) -> tuple[int, int, int]:
        """(winner, loser, shared length) of two heads known to share h bytes; of equal ones the lower run wins."""
        a, b = self._head(x), self._head(y)
        if a is None or b is None:
            return (y, x, -1) if a is None and b is not None else (x, y, -1)
        a, b = a[h:], b[h:]
        differ = int.from_bytes(a) ^ int.from_bytes(b)
        if not differ:
            return (x, y, h + len(a)) if x < y else (y, x, h + len(a))
        h += len(a) - (differ.bit_length() + 7) // 8
        return (x, y, h) if a < b else (y, x, h)

    def __iter__(self):
        """(run, index in it, length shared with the string before) in ascending order."""
        keys, shared, at, loser, lcp, size, beat = self.keys, self.shared, self.at, self.loser, self.lcp, self.size, self._beat
        win, h = self.winner, 0
        while self._head(win) is not None:
            i = at[win]
            yield win, i, h
            at[win] = i + 1
            r, h = win, shared[win][i + 1] if keys[win][i + 1] is not None else -1
            node = (win + size) >> 1
            while node:
                other = lcp[node]
                if other > h:  # the loser shares more with the last winner, so it comes first
                    loser[node], lcp[node], r, h = r, h, loser[node], other
                elif other == h and h >= 0:
                    x = loser[node]
                    w, l, g = beat(r, x, h)
                    self.compared += 1
                    loser[node], lcp[node] = l, g
                    r = w
                node >>= 1
            win = r


def _merger(min_words: int):
    def run(t: pa.Table) -> pa.Table:
        if t.column("part")[0].as_py() < 0:
            return _members(t)
        keys, shared, docs, poss, reaches, sidess = [], [], [], [], [], []
        for s, rest, d, p, reach, sides in zip(*([x.as_buffer() for x in t.column(c)] for c in ("shared", "rest", "doc", "pos", "reach", "sides"))):
            s = np.frombuffer(s, np.uint8)
            rows = front_decode(s, np.frombuffer(rest, np.uint8)).tobytes()
            # suffixes of a run that are all equal go through the tree as one
            head = np.flatnonzero(s < _KEY)
            keys.append([rows[i * _KEY : (i + 1) * _KEY] for i in head.tolist()] + [None])
            shared.append(s[head].tolist() + [-1])
            bounds = np.append(head, len(s))
            docs.append((np.frombuffer(d, np.int64), bounds))
            poss.append(np.frombuffer(p, np.int32))
            reaches.append(np.frombuffer(reach, np.int32).reshape(len(s), 3))
            sidess.append(np.frombuffer(sides, np.uint16).reshape(len(s), -1))
        tree = list(LoserTree(keys, shared))
        runs, index, lcp = (np.array([x[k] for x in tree], np.int64) for k in range(3))
        group = np.cumsum(lcp < _KEY)
        cols = [[], [], [], [], []]
        several = np.zeros(group[-1] + 1, np.int64)  # suffixes of a key, or 2 and more where one has members
        for r in range(len(keys)):
            mine = runs == r
            bounds = docs[r][1]
            more = np.concatenate([[0], np.cumsum(reaches[r][:, 2])])
            size = np.diff(bounds) + np.diff(more[bounds])
            several += np.bincount(group[mine], size[index[mine]], len(several)).astype(np.int64)
        for r in range(len(keys)):
            mine = runs == r
            mine[mine] = several[group[mine]] > 1
            lo, hi = docs[r][1][index[mine]], docs[r][1][index[mine] + 1]
            at = np.repeat(lo - (np.cumsum(hi - lo) - (hi - lo)), hi - lo) + np.arange((hi - lo).sum())
            for c, v in zip(cols, (np.repeat(group[mine], hi - lo), docs[r][0][at], poss[r][at], reaches[r][at], sidess[r][at])):
                c.append(v)
        group, doc, pos, reach, sides = (np.concatenate(c) for c in cols)
        order = np.lexsort((pos, doc, group))
        group, doc, pos, reach = group[order], doc[order], pos[order].astype(np.int64), reach[order]
        # whole groups at a time, so that hashes of the passages take little memory
        cuts = [0]
        while cuts[-1] < len(group):
            cuts.append(int(np.searchsorted(group, group[min(cuts[-1] + 100_000, len(group)) - 1], "right")))
        found = [[np.empty(0, np.int64)] for _ in range(6)]
        for lo, hi in zip(cuts, cuts[1:]):
            s = slice(lo, hi)
            d, p, flag = doc[s], pos[s], reach[s, 2] > 0
            suffix, source, least, most = earliest_passages(group[s], reach[s, 0], reach[s, 1], sides[order[s]])
            for o, v in zip(found, (d[suffix], p[suffix], least, most, d[source], p[source])):
                o.append(v)
            # suffixes with members: what has no earlier source has itself as the members' source
            firsts = np.flatnonzero(flag)
            span = np.arange(reach[s, 1].max(initial=0) + 1)
            bare = (span >= reach[s, 0][firsts][:, None]) & (span <= reach[s, 1][firsts][:, None])
            row = np.full(len(d), -1, np.int64)
            row[firsts] = np.arange(len(firsts))
            mine = flag[suffix]
            size = most[mine] - least[mine] + 1
            at = np.repeat(least[mine] - (np.cumsum(size) - size), size) + np.arange(size.sum())
            bare[np.repeat(row[suffix[mine]], size), at] = False
            edge = np.diff(np.pad(bare, ((0, 0), (1, 1))).astype(np.int8), axis=1)
            i, a = np.nonzero(edge > 0)
            _, e = np.nonzero(edge < 0)
            for o, v in zip(found, (d[firsts[i]], p[firsts[i]], a, e - 1, d[firsts[i]], p[firsts[i]])):
                o.append(v)
        return pa.table([pa.array(np.concatenate(o).astype(np.int64)) for o in found], names=["doc_id", "pos", "least", "most", "kept_doc_id", "kept_pos"])

    return run


def _context_reader(reach: int):
    def run(batches):
        for batch in batches:
            get = {c: batch.column(i) for i, c in enumerate(batch.schema.names)}
            for lo in range(0, batch.num_rows, 200):
                text, asks = get["text"].slice(lo, 200), get["asks"].slice(lo, 200)
                words, _, _, first, _ = hashed_words(text)
                code = (words >> U64(17)).astype(np.uint16)
                row = np.repeat(np.arange(len(text)), np.asarray(asks.value_lengths()).astype(np.int64))
                flat = asks.flatten()
                a, b = first[row] + np.asarray(flat.field("a")), first[row] + np.asarray(flat.field("b"))
                left = [code[x:y][::-1].tobytes() for x, y in zip(np.maximum(a - reach, first[row]).tolist(), a.tolist())]
                right = [code[x:y].tobytes() for x, y in zip(b.tolist(), np.minimum(b + reach, first[row + 1]).tolist())]
                yield pa.RecordBatch.from_arrays([flat.field("chain"), flat.field("side"), pa.array(left, pa.binary()), pa.array(right, pa.binary())], names=["chain", "side", "before", "after"])

    return run


def _common(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b)) // 2
    differ = np.frombuffer(a, np.uint16, n) != np.frombuffer(b, np.uint16, n)
    return int(differ.argmax()) if differ.any() else n


def _extender():
    def run(batches):
        for b in batches:
            get = {c: b.column(i) for i, c in enumerate(b.schema.names)}
            more = np.array([(_common(w, x), _common(y, z)) for w, x, y, z in zip(*(get[c].to_pylist() for c in ("before", "kept_before", "after", "kept_after")))], np.int64).reshape(-1, 2)
            a, e, k = (np.asarray(get[c]) for c in ("a", "b", "kept_a"))
            t = pa.RecordBatch.from_arrays([get["doc_id"], pa.array(a - more[:, 0]), pa.array(e + more[:, 1]), get["kept_doc_id"], pa.array(k - more[:, 0])], names=["doc_id", "start_word", "end_word", "kept_doc_id", "kept_start_word"])
            yield t

    return run


def repeated_passages(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, start_word, end_word, kept_doc_id, kept_start_word): passages of at least min_words words that an earlier
    place has, and the earliest such place."""
    if min_words <= PREFIX:
        raise ValueError(f"min_words must be above {PREFIX}")
    kind = docs.schema["doc_id"].dataType
    src, ids = one_text_per_id(docs), None
    if isinstance(kind, T.IntegralType):
        src = src.withColumn("doc_id", F.col("doc_id").cast("bigint"))
    else:  # numbers in the order of the ids stand for them
        parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        ids = written(src.select("doc_id").repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id").withColumn("number", F.monotonically_increasing_id()), "ids")
        src = src.join(ids, "doc_id").select(F.col("number").alias("doc_id"), "text")
    ranges = max(4, 4 * docs.select("doc_id").rdd.getNumPartitions())
    runs = src.mapInArrow(_run_maker(min_words, ranges), "part int, shared binary, rest binary, doc binary, pos binary, reach binary, sides binary")
    sources = written(runs.groupBy("part").applyInArrow(_merger(min_words), "doc_id bigint, pos bigint, least bigint, most bigint, kept_doc_id bigint, kept_pos bigint"), "sources")
    members = sources.where("least < 0").select("doc_id", "pos", F.col("kept_doc_id").alias("first_doc"), F.col("kept_pos").alias("first_pos"))
    sources = sources.where("least >= 0")
    of_members = members.join(sources.withColumnsRenamed({"doc_id": "first_doc", "pos": "first_pos"}), ["first_doc", "first_pos"]).select(sources.columns)
    every = sources.where("doc_id <> kept_doc_id or pos <> kept_pos").unionByName(of_members)
    repeats = every.select("doc_id", (F.col("pos") - F.col("most")).alias("a"), (F.col("pos") - F.col("least") + min_words).alias("b"), "kept_doc_id", (F.col("kept_pos") - F.col("most")).alias("kept_a"))

    line = Window.partitionBy("doc_id", "kept_doc_id", "offset").orderBy("a", "b")
    chained = repeats.withColumn("offset", F.col("a") - F.col("kept_a"))
    chained = chained.withColumn("new", (F.col("a") > F.max("b").over(line.rowsBetween(Window.unboundedPreceding, -1))).cast("int")).withColumn("part", F.sum(F.coalesce("new", F.lit(0))).over(line.rowsBetween(Window.unboundedPreceding, 0)))
    chains = chained.groupBy("doc_id", "kept_doc_id", "offset", "part").agg(F.min("a").alias("a"), F.max("b").alias("b"))
    chains = chains.select(F.monotonically_increasing_id().alias("chain"), "doc_id", "a", "b", "kept_doc_id", (F.col("a") - F.col("offset")).alias("kept_a"), (F.col("b") - F.col("offset")).alias("kept_b"))
    chains = written(chains, "chains")

    def ask(doc, side, a, b):
        return chains.select(F.col(doc).alias("doc_id"), F.struct("chain", F.lit(side).alias("side"), F.col(a).alias("a"), F.col(b).alias("b")).alias("ask"))

    asks = ask("doc_id", 0, "a", "b").unionByName(ask("kept_doc_id", 1, "kept_a", "kept_b"))
    # a document that thousands of others copy is asked in shares, so that no row grows with their number
    asks = asks.withColumn("share", F.pmod(F.hash("ask.chain"), F.lit(1 << 20)) % F.greatest(F.lit(1), (F.count("*").over(Window.partitionBy("doc_id")) / 2000).cast("int")))
    asks = asks.groupBy("doc_id", "share").agg(F.collect_list("ask").alias("asks"))
    contexts = written(src.join(asks.hint("shuffle_hash"), "doc_id").select("text", "asks").mapInArrow(_context_reader(min_words), "chain bigint, side int, before binary, after binary"), "contexts")
    own = contexts.where("side = 0").select("chain", "before", "after")
    kept = contexts.where("side = 1").select("chain", F.col("before").alias("kept_before"), F.col("after").alias("kept_after"))
    found = chains.join(own, "chain").join(kept, "chain").mapInArrow(_extender(), "doc_id bigint, start_word bigint, end_word bigint, kept_doc_id bigint, kept_start_word bigint")
    found = found.groupBy("doc_id", "start_word", "end_word").agg(F.min(F.struct("kept_doc_id", "kept_start_word")).alias("kept"))
    found = found.select("doc_id", "start_word", "end_word", "kept.kept_doc_id", "kept.kept_start_word")
    if ids is None:
        return found.withColumns({c: F.col(c).cast(kind) for c in ("doc_id", "kept_doc_id")})
    for c in ("doc_id", "kept_doc_id"):
        found = found.join(ids.select(F.col("number").alias(c), F.col("doc_id").alias(f"_{c}")), c).drop(c).withColumnRenamed(f"_{c}", c)
    return found.select("doc_id", "start_word", "end_word", "kept_doc_id", "kept_start_word")
