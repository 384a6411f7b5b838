"""Near-duplicate embeddings by an epsilon grid order join.

1. Vectors are scaled to length 1, so cosine >= threshold means distance <= eps.
2. One pass over all vectors sums their second moments; the eigenvectors, by falling variance,
   are the new axes.  Turning the vectors changes no distance.
3. Epsilon grid order: vectors are sorted by their cells of side eps on the leading axes.
   The sorted sequence is cut into tiles by range partitioning.
4. Intervals of the sequence are joined recursively: a tree of tiles, eight to a node, is
   descended pair by pair, and pairs of intervals whose boxes lie further apart than eps are
   skipped.  Pairs of tiles that remain go to tasks, which halve the intervals further in
   the same way; only intervals of at most `BASE` vectors are compared, as one matrix product.
5. A task returns a spanning forest of the pairs it found, so groups of thousands of copies
   yield edges in proportion to their size.  Connected components make the groups.

Nothing is approximate: every pair within the threshold ends in one group.

Defined cases: rows without vec_id, null, empty or zero vectors, vectors with null, NaN or infinite
elements, and vectors of another length than most of the table (of two equally frequent lengths the
lesser counts) are in no group.  Equal vectors are one point.  Rows that repeat a vec_id with an equal vector are one
member; with other vectors they may be members of several groups.  Ids may be of any type that has an order.  An empty
table has no groups.  Other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import components, written

THRESHOLD = 0.95
LEADING = 12
TILE = 16384
BASE = 512
FAN = 8


def _matrix(column, d: int) -> np.ndarray:
    """Rows of an Arrow column of d-element lists, scaled to length 1."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    x = np.asarray(column.flatten()).astype(np.float64).reshape(-1, d)
    x = x / np.abs(x).max(axis=1, keepdims=True, initial=0)  # else squares of very small or large elements vanish or overflow
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _moments(d: int):
    def run(batches):
        total = np.zeros((d, d))
        mean = np.zeros(d)
        n = 0
        for b in batches:
            x = _matrix(b.column(0), d)
            total += x.T @ x
            mean += x.sum(0)
            n += len(x)
        flat = np.concatenate([total.ravel(), mean, [n]])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat))), pa.array(flat)], names=["k", "v"])

    return run


def principal_axes(vectors: DataFrame, d: int) -> np.ndarray:
    """d x d, one axis a column, by falling variance; what comes to the driver depends on d alone."""
    flat = np.zeros(d * d + d + 1)
    for r in vectors.select("embedding").mapInArrow(_moments(d), "k bigint, v double").groupBy("k").agg(F.sum("v").alias("v")).collect():
        flat[r.k] = r.v
    n = max(flat[-1], 1.0)
    mean = flat[d * d : -1] / n
    _, axes = np.linalg.eigh(flat[: d * d].reshape(d, d) / n - np.outer(mean, mean))
    return axes[:, ::-1]


def _turner(axes: np.ndarray, eps: float, leading: int):
    d = len(axes)

    def run(batches):
        for b in batches:
            x = (_matrix(b.column(3), d) @ axes).astype(np.float32)
            cell = np.clip(np.floor(x[:, :leading] / eps) + 128, 0, 255).astype(np.uint8)
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:3], pa.array([r.tobytes() for r in cell], pa.binary()), pa.array([r.tobytes() for r in x], pa.binary())],
                names=["node", "h1", "h2", "cell", "x"],
            )

    return run


def _points(column) -> np.ndarray:
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), np.float32).reshape(len(rows), -1)


def _boxes(batches):
    """The least and greatest coordinate of each tile on each axis, batch by batch."""
    for b in batches:
        if not b.num_rows:
            continue
        x, tile = _points(b.column(1)), np.asarray(b.column(0))
        order = np.argsort(tile, kind="stable")
        own, at = np.unique(tile[order], return_index=True)
        lo, hi = np.minimum.reduceat(x[order], at), np.maximum.reduceat(x[order], at)
        axis = np.tile(np.arange(x.shape[1], dtype=np.int32), len(own))
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(own, x.shape[1])), pa.array(axis), pa.array(lo.ravel()), pa.array(hi.ravel())], names=["node", "axis", "lo", "hi"])


def near_tiles(boxes: DataFrame, tiles: int, eps: float) -> DataFrame:
    """(a, b), a <= b: the tiles whose boxes are within eps, by descending a tree of intervals from its root."""
    levels = [boxes]
    while tiles > 1:
        tiles = -(-tiles // FAN)
        levels.append(levels[-1].groupBy(F.floor(F.col("node") / FAN).cast("int").alias("node"), "axis").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")))
    whole = [b.groupBy("node").agg(F.array_sort(F.collect_list(F.struct("axis", "lo", "hi"))).alias("box")) for b in levels]
    pairs = whole[-1].select(F.col("node").alias("a"), F.col("node").alias("b"))
    gap = F.aggregate(
        F.zip_with("box_a", "box_b", lambda p, q: F.greatest(p["lo"] - q["hi"], q["lo"] - p["hi"], F.lit(0.0).cast("float")).cast("double")),
        F.lit(0.0), lambda s, g: s + g * g,
    )
    for box in reversed(whole[:-1]):
        x = box.select(F.floor(F.col("node") / FAN).cast("int").alias("a"), F.col("node").alias("na"), F.col("box").alias("box_a"))
        y = box.select(F.floor(F.col("node") / FAN).cast("int").alias("b"), F.col("node").alias("nb"), F.col("box").alias("box_b"))
        pairs = pairs.join(x, "a").join(y, "b").where("na <= nb").where(gap <= eps * eps * 1.0001).select(F.col("na").alias("a"), F.col("nb").alias("b"))
    return pairs


class _Forest:
    """Sets of rows under a growing list of edges; `edges` has only those that joined two sets."""

    def __init__(self, n: int):
        self.label, self.edges = np.arange(n), []

    def join(self, i: np.ndarray, j: np.ndarray) -> None:
        apart = self.label[i] != self.label[j]
        i, j = i[apart], j[apart]
        if not len(i):
            return
        _, one = np.unique(self.label[i] * len(self.label) + self.label[j], return_index=True)
        up: dict[int, int] = {}

        def root(x: int) -> int:
            while up.get(x, x) != x:
                up[x] = x = up.get(up[x], up[x])
            return x

        for a, b, la, lb in zip(i[one].tolist(), j[one].tolist(), self.label[i[one]].tolist(), self.label[j[one]].tolist()):
            x, y = root(la), root(lb)
            if x != y:
                up[max(x, y)] = min(x, y)
                self.edges.append((a, b))
        to = np.arange(len(self.label))
        to[list(up)] = [root(x) for x in list(up)]
        self.label = to[self.label]


def join_sequences(x: np.ndarray, y: np.ndarray | None, eps: float, threshold: float) -> list[tuple[int, int]]:
    """A spanning forest of the pairs (row of x, row of y) that reach the threshold; rows of y count on
    after those of x.  With y None x is joined with itself."""
    both = x if y is None else np.concatenate([x, y])
    forest, known = _Forest(len(both)), {}

    def box(lo, hi):
        if (lo, hi) not in known:
            known[lo, hi] = both[lo:hi].min(0), both[lo:hi].max(0)
        return known[lo, hi]

    stack = [(0, len(x), 0, len(x))] if y is None else [(0, len(x), len(x), len(both))]
    while stack:
        a, b, c, d = stack.pop()
        if a >= b or c >= d:
            continue
        if (a, b) != (c, d):
            (la, ha), (lc, hc) = box(a, b), box(c, d)
            gap = np.maximum(np.maximum(la - hc, lc - ha), 0)
            if float(gap @ gap) > eps * eps * 1.0001:
                continue
        if b - a <= BASE and d - c <= BASE:
            i, j = np.nonzero(both[a:b] @ both[c:d].T >= threshold)
            if (a, b) == (c, d):
                i, j = i[i < j], j[i < j]
            forest.join(i + a, j + c)
        elif (a, b) == (c, d):
            m = (a + b) // 2
            stack += [(a, m, a, m), (m, b, m, b), (a, m, m, b)]
        elif b - a >= d - c:
            m = (a + b) // 2
            stack += [(a, m, c, d), (m, b, c, d)]
        else:
            m = (c + d) // 2
            stack += [(a, b, c, m), (a, b, m, d)]
    return forest.edges


def _tile_join(eps: float, threshold: float):
    def run(t: pa.Table) -> pa.Table:
        tile, ids = np.asarray(t.column("tile")), np.asarray(t.column("node"))
        a, b = int(t.column("a")[0].as_py()), int(t.column("b")[0].as_py())
        cells, points = np.array(t.column("cell").to_pylist(), object), _points(t.column("x"))
        rows = [np.flatnonzero(tile == k) for k in ((a,) if a == b else (a, b))]
        rows = [r[np.argsort(cells[r], kind="stable")] for r in rows]
        edges = join_sequences(points[rows[0]], points[rows[1]] if a != b else None, eps, threshold)
        e = np.array(edges, np.int64).reshape(-1, 2)
        own = ids[np.concatenate(rows)]
        return pa.table({"a": pa.array(own[e[:, 0]]), "b": pa.array(own[e[:, 1]])})

    return run


def near_duplicate_vectors(vectors: DataFrame, threshold: float = THRESHOLD, leading: int = LEADING, tile: int = TILE) -> DataFrame:
    """(vec_id, group_id) of every vector that has a near duplicate; group_id is the least vec_id of its group."""
    finite = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    src = vectors.where("vec_id is not null and size(embedding) > 0").select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    src = src.where(finite & F.exists("embedding", lambda v: v != 0))
    most = src.groupBy(F.size("embedding").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    d = most.d if most else 1
    src = src.where(F.size("embedding") == d)
    eps = math.sqrt(2 * (1 - threshold))

    members = src.select("vec_id", "embedding", F.xxhash64("embedding").alias("h1"), F.hash("embedding").alias("h2"))
    points = members.groupBy("h1", "h2").agg(F.first("embedding").alias("embedding")).withColumn("node", F.monotonically_increasing_id())
    axes = principal_axes(src, d)
    turned = written(points.select("node", "h1", "h2", "embedding").mapInArrow(_turner(axes, eps, leading), "node bigint, h1 bigint, h2 int, cell binary, x binary"), "turned")
    tiles = max(1, -(-turned.count() // tile))
    sequence = written(turned.select("node", "cell", "x").repartitionByRange(tiles, "cell", "node").sortWithinPartitions("cell", "node").withColumn("tile", F.spark_partition_id()), "sequence")

    boxes = sequence.select("tile", "x").mapInArrow(_boxes, "node int, axis int, lo float, hi float").groupBy("node", "axis").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    pairs = written(near_tiles(written(boxes, "boxes"), tiles, eps), "tiles")
    left = pairs.join(sequence, F.col("tile") == F.col("a"))
    right = pairs.where("a < b").join(sequence, F.col("tile") == F.col("b"))
    edges = left.unionByName(right).groupBy("a", "b").applyInArrow(_tile_join(eps, threshold), "a bigint, b bigint")
    label = components(edges)

    group = turned.select("node", "h1", "h2").join(label, "node", "left").select("h1", "h2", F.coalesce("label", "node").alias("label"))
    found = members.select("vec_id", "h1", "h2").distinct().join(group, ["h1", "h2"]).select("vec_id", "label").distinct()
    several = found.groupBy("label").agg(F.count("*").alias("n"), F.min("vec_id").alias("group_id")).where("n > 1").select("label", "group_id")
    return found.join(several, "label").select("vec_id", "group_id")
