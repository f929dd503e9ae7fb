"""Hard negatives for embeddings, by a multiway hyperplane tree with distance ranges.

Scores are inner products of whole numbers.  With one more coordinate,
sqrt(M2 - |x|2) for rows and 0 for anchors (M2: the largest squared norm), the
distance of an anchor q and a row x is sqrt(|q|2 + M2 - 2 score): a window of
scores is an annulus of distances around the anchor, whatever the norms.

The tree: each node has up to ``WAYS`` split points; a row goes to the nearest
one, so the parts are bounded by the hyperplanes between them.  Each split
point keeps the range of its distances to the rows of every sibling part.  The
split points are fitted on at most ``SAMPLE_ROWS`` rows, the ranges cover all
rows.  An anchor at distance d of a split point can find rows of its annulus
[r, R] only in parts whose range meets [max(d - R, r - d, 0), d + R]; all other
parts are eliminated.  Leaves are searched exactly, so the result is exact.

In Spark: rows lie in units of at most ``UNIT_ROWS`` rows of one leaf, anchors
in blocks of at most ``BLOCK_ANCHORS``.  A block has one row for each leaf that
one of its anchors visits, with these anchors alone; it is joined to the units
on the leaf, and a task multiplies one block with one unit at a time.  What
leaves a task is the best rows per anchor, window and leaf.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import settle

#: Bound of the sample that the split points and first limits come from, and shape of the tree.
SAMPLE_ROWS = 4096
WAYS = 8
LEAF_SAMPLE = 64
UNIT_ROWS = 1024
BLOCK_ANCHORS = 512
#: Candidates that a task holds before it keeps the best ones only.
HELD = 1 << 20
EXACT = 2.0 ** 53
_LOW, _HIGH = -(1 << 62), 1 << 62


def inner(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of whole numbers, rows of ``a`` against rows of ``b``."""
    most = (np.abs(a).max(initial=0.0) * np.abs(b).max(initial=0.0)) * max(1, a.shape[1])
    if most < EXACT:
        return np.rint(a @ b.T).astype(np.int64)
    whole = np.vectorize(int, otypes=[object])
    return (whole(a) @ whole(b).T).astype(np.int64)  # Python's whole numbers; beyond 64 bits this raises


@dataclass
class Node:
    """Split points, what each part is (a node, or a leaf as -1 - leaf), and ranges[i, j] of distances of point i to part j."""

    points: np.ndarray
    parts: list[int]
    low: np.ndarray = field(default=None)
    high: np.ndarray = field(default=None)


class Tree:
    """Split points fitted on a sample of vectors; ranges are set later from all rows."""

    def __init__(self, sample: np.ndarray, norm2: float, ways: int = WAYS, leaf: int = LEAF_SAMPLE):
        self.norm2, self.ways, self.leaf = norm2, ways, leaf
        self.nodes: list[Node] = []
        self.leaves = 0
        self.root = self._grow(sample)

    def lift(self, x: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(self.norm2 - np.einsum("ij,ij->i", x, x), 0.0))

    def distances(self, x: np.ndarray, points: np.ndarray) -> np.ndarray:
        """Of rows to split points, both with their further coordinate."""
        square = (np.einsum("ij,ij->i", x, x)[:, None] + np.einsum("ij,ij->i", points, points)[None, :] - 2 * (x @ points.T)
                  + (self.lift(x)[:, None] - self.lift(points)[None, :]) ** 2)
        return np.sqrt(np.maximum(square, 0.0))

    def _grow(self, x: np.ndarray) -> int:
        if len(x) > self.leaf:
            chosen, gap = [0], self.distances(x, x[:1])[:, 0]
            while len(chosen) < self.ways and gap.max() > 0:  # the point farthest from those chosen
                chosen.append(int(gap.argmax()))
                gap = np.minimum(gap, self.distances(x, x[chosen[-1:]])[:, 0])
            if len(chosen) > 1:
                at = len(self.nodes)
                points = x[chosen]
                self.nodes.append(Node(points, []))
                near = self.distances(x, points).argmin(axis=1)
                self.nodes[at].parts = [self._grow(x[near == j]) for j in range(len(points))]
                return at
        self.leaves += 1
        return -self.leaves

    def route(self, x: np.ndarray) -> np.ndarray:
        """Leaf of each row."""
        out = np.zeros(len(x), np.int64)
        todo = [(self.root, np.arange(len(x)))]
        while todo:
            at, rows = todo.pop()
            if at < 0:
                out[rows] = -1 - at
            elif len(rows):
                near = self.distances(x[rows], self.nodes[at].points).argmin(axis=1)
                todo += [(part, rows[near == j]) for j, part in enumerate(self.nodes[at].parts)]
        return out

    def ranges(self, x: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(node, low, high) of rows that come together to a node: smallest and largest distances by point and part."""
        todo = [(self.root, x)]
        while todo:
            at, rows = todo.pop()
            if at < 0 or not len(rows):
                continue
            node = self.nodes[at]
            d = self.distances(rows, node.points)
            near = d.argmin(axis=1)
            low, high = np.full((2, len(node.parts), len(node.parts)), np.nan)
            for j, part in enumerate(node.parts):
                if (own := near == j).any():
                    low[:, j], high[:, j] = d[own].min(axis=0), d[own].max(axis=0)
                    todo.append((part, rows[own]))
            yield at, low, high

    def visits(self, q: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Whether an anchor must visit a leaf; ``low`` and ``high`` are its windows of scores (anchors x windows)."""
        out = np.zeros((len(q), self.leaves), dtype=bool)
        square = np.einsum("ij,ij->i", q, q)[:, None]
        slack = 1e-6 * np.sqrt(square + self.norm2 + 1)
        used = low <= high
        far = np.sqrt(np.maximum(square + self.norm2 - 2.0 * np.maximum(low, -EXACT), 0.0)) + slack
        near = np.maximum(np.sqrt(np.maximum(square + self.norm2 - 2.0 * np.minimum(high, EXACT), 0.0)) - slack, 0.0)
        todo = [(self.root, np.flatnonzero(used.any(axis=1)))]
        while todo:
            at, rows = todo.pop()
            if at < 0:
                out[rows, -1 - at] = True
                continue
            node = self.nodes[at]
            d = np.sqrt(np.maximum(square[rows] + self.norm2 - 2.0 * (q[rows] @ node.points.T), 0.0))
            least = np.maximum(np.maximum(d[:, None, :] - far[rows][:, :, None], near[rows][:, :, None] - d[:, None, :]), 0.0)
            most = d[:, None, :] + far[rows][:, :, None]
            for j, part in enumerate(node.parts):
                meets = ((least <= node.high[:, j] + slack[rows][:, None]) & (most >= node.low[:, j] - slack[rows][:, None])).all(axis=2)
                go = rows[(meets & used[rows]).any(axis=1)]  # a part without rows has a range that nothing meets
                if len(go):
                    todo.append((part, go))
        return out


def vectors_of(rows: DataFrame, id_column: str, vector_column: str, label_column: str, scale: int = 256) -> DataFrame:
    """(vec_id, label, vector): components as floor(scale * x); rows with a null id, label, vector or component, or one that is not finite, are left out."""
    x = F.col(vector_column)
    fine = F.forall(x, lambda v: F.coalesce(F.abs(v.cast("double")) < float("inf"), F.lit(False)))
    whole = F.transform(x, lambda v: F.floor(v.cast("double") * scale).cast("double"))
    return rows.where(F.col(id_column).isNotNull() & F.col(label_column).isNotNull() & x.isNotNull() & fine).select(
        F.col(id_column).cast("long").alias("vec_id"), F.col(label_column).cast("long").alias("label"), whole.alias("vector"))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Lists as rows of a matrix; shorter ones end with zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    size = np.diff(column.offsets.to_numpy())
    if (size == width).all():
        return flat.reshape(len(column), width)
    out = np.zeros((len(column), width))
    out[np.repeat(np.arange(len(size)), size), np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
    return out


def _packed(x: np.ndarray, kind: str) -> bytes:
    return np.ascontiguousarray(x, dtype=kind).tobytes()


class Mining:
    """The rows of one table in leaves, and searches against them."""

    def __init__(self, rows: DataFrame, sample_rows: int = SAMPLE_ROWS):
        """``rows`` are (vec_id, label, vector) of whole numbers; a vector shorter than the longest one ends with zeros."""
        self.rows = settle(rows, "vectors")
        x = F.col("vector")
        norm2 = F.aggregate(x, F.lit(0.0), lambda s, v: s + v * v)
        size = self.rows.agg(F.max(F.size(x)).alias("width"), F.max(norm2).alias("norm2"),
                             F.max(F.array_max(F.transform(x, lambda v: F.abs(v)))).alias("most")).first()
        self.width, self.most = max(1, size["width"] or 0), size["most"] or 0.0
        self.kind = "<i2" if self.most < 1 << 15 else "<i4" if self.most < 1 << 31 else "<f8"
        sample = self.rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample_rows).toArrow()  # bounded by the parameter
        self.sample_ids, self.sample_labels = (sample.column(c).to_numpy() for c in ("vec_id", "label"))
        self.sample = _matrix(sample.column("vector"), self.width) if len(sample) else np.zeros((0, self.width))
        self.tree = Tree(self.sample, size["norm2"] or 0.0)
        self.units = settle(self._units(), "units")
        self._set_ranges()

    def _units(self) -> DataFrame:
        tree, width, kind = self.tree, self.width, self.kind

        def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = _matrix(batch.column("vector"), width)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(tree.route(x)), batch.column("vec_id"), batch.column("label"),
                     pa.array([_packed(v, kind) for v in x], pa.binary())], ["leaf", "vec_id", "label", "vector"])

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[pa.Table] = []

            def units(rows: pa.Table, last: bool) -> tuple[list[tuple], pa.Table]:
                leaf = rows.column("leaf").to_numpy()
                cuts = np.flatnonzero(np.diff(leaf, prepend=leaf[:1] - 1)) if len(leaf) else np.zeros(0, np.int64)
                out, done = [], 0
                for start, end in zip(cuts, np.append(cuts[1:], len(leaf))):
                    for at in range(int(start), int(end), UNIT_ROWS):
                        to = min(at + UNIT_ROWS, int(end))
                        if not last and end == len(leaf) and to - at < UNIT_ROWS:
                            break
                        part = rows.slice(at, to - at)
                        out.append((int(leaf[at]), part.column("vec_id").to_numpy().tobytes(),
                                    part.column("label").to_numpy().tobytes(), b"".join(part.column("vector").to_pylist())))
                        done = to
                return out, rows.slice(done)

            rest = None
            for batch in batches:
                held.append(pa.Table.from_batches([batch]))
                rest = pa.concat_tables(held).combine_chunks()
                found, rest = units(rest, False)
                held = [rest]
                if found:
                    yield _unit_batch(found)
            if rest is not None and len(rest):
                yield _unit_batch(units(rest, True)[0])

        placed = self.rows.mapInArrow(route, "leaf long, vec_id long, label long, vector binary")
        return placed.repartitionByRange("leaf", "vec_id").sortWithinPartitions("leaf", "vec_id").mapInArrow(
            pack, "leaf long, ids binary, labels binary, vectors binary")

    def _set_ranges(self):
        """Ranges of distances over all rows: a few numbers per node and task, then per node."""
        tree, width, kind = self.tree, self.width, self.kind

        def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            low = [np.full((len(n.parts),) * 2, np.inf) for n in tree.nodes]
            high = [np.full((len(n.parts),) * 2, -np.inf) for n in tree.nodes]
            for batch in batches:
                for raw in batch.column("vectors"):
                    for at, lo, hi in tree.ranges(np.frombuffer(raw.as_py(), kind).reshape(-1, width).astype(np.float64)):
                        low[at], high[at] = np.fmin(low[at], lo), np.fmax(high[at], hi)
            rows = [(k, i, j, low[k][i, j], high[k][i, j]) for k in range(len(low)) for i, j in zip(*np.nonzero(low[k] <= high[k]))]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(np.array(c)) for c in zip(*rows)], ["node", "i", "j", "low", "high"])

        for node in tree.nodes:
            node.low, node.high = np.full((2, len(node.parts), len(node.parts)), np.inf)
            node.high = -node.high
        found = self.units.select("vectors").mapInArrow(measure, "node long, i long, j long, low double, high double")
        for r in found.groupBy("node", "i", "j").agg(F.min("low").alias("low"), F.max("high").alias("high")).collect():
            tree.nodes[r["node"]].low[r["i"], r["j"]], tree.nodes[r["node"]].high[r["i"], r["j"]] = r["low"], r["high"]

    def search(self, anchors: DataFrame, k: int, same: bool) -> DataFrame:
        """(anchor, w, score, vec_id, place): the first k rows in each window of each anchor, best score first, then the smaller id.

        ``anchors`` are (anchor, vec_id, label, vector, low, high): a number, a
        row and its windows of scores.  With ``same`` rows of the same label
        count, else those of another; an anchor's own id never counts.
        """
        blocks = self._visits(anchors, k, same)
        width, kind = self.width, self.kind

        def best(held: list[tuple]) -> list[np.ndarray]:
            a, w, s, v = (np.concatenate(c) for c in zip(*held))
            order = np.lexsort((v, -s, w, a))
            a, w, s, v = a[order], w[order], s[order], v[order]
            new = np.ones(len(a), dtype=bool)
            new[1:] = (a[1:] != a[:-1]) | (w[1:] != w[:-1])
            first = np.flatnonzero(new)
            keep = np.arange(len(a)) - first[np.cumsum(new) - 1] < k
            return [c[keep] for c in (a, w, s, v)]

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            key, held, size = None, [], 0

            def closed() -> Iterator[pa.RecordBatch]:
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in best(held)], ["anchor", "w", "score", "vec_id"])

            for batch in batches:
                at = {c: batch.column(c) for c in batch.schema.names}
                for r in range(batch.num_rows):
                    if (now := (at["leaf"][r].as_py(), at["block"][r].as_py())) != key:
                        yield from closed()
                        key, held, size = now, [], 0
                        number, own, tag = (np.frombuffer(at[c][r].as_py(), np.int64) for c in ("anchors", "a_ids", "a_labels"))
                        q = np.frombuffer(at["a_vectors"][r].as_py(), kind).reshape(-1, width).astype(np.float64)
                        low, high = (np.frombuffer(at[c][r].as_py(), np.int64).reshape(len(q), -1).copy() for c in ("low", "high"))
                    ids, labels = (np.frombuffer(at[c][r].as_py(), np.int64) for c in ("ids", "labels"))
                    score = inner(q, np.frombuffer(at["vectors"][r].as_py(), kind).reshape(-1, width).astype(np.float64))
                    counts = ((labels[None, :] == tag[:, None]) == same) & (ids[None, :] != own[:, None])
                    for w in range(low.shape[1]):
                        i, j = np.nonzero(counts & (score >= low[:, w, None]) & (score <= high[:, w, None]))
                        if len(i):
                            held.append((number[i], np.full(len(i), w), score[i, j], ids[j]))
                            size += len(i)
                    if size > HELD:
                        held = [tuple(best(held))]
                        size = len(held[0][0])
            yield from closed()

        # Sorted on the leaf: a block meets all units of its leaf in a row, and neither side, both growing, is broadcast.
        pairs = blocks.hint("merge").join(self.units, "leaf")
        found = pairs.mapInArrow(scan, "anchor long, w long, score long, vec_id long")
        order = Window.partitionBy("anchor", "w").orderBy(F.desc("score"), "vec_id")
        return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)

    def _visits(self, anchors: DataFrame, k: int, same: bool) -> DataFrame:
        """One row per block of anchors and leaf to visit; the sample raises the lower limits first."""
        tree, width, kind = self.tree, self.width, self.kind
        sample, sample_ids, sample_labels = self.sample, self.sample_ids, self.sample_labels

        def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            name = TaskContext.get().partitionId() << 32
            for batch in batches:
                for at in range(0, batch.num_rows, BLOCK_ANCHORS):
                    part = batch.slice(at, BLOCK_ANCHORS)
                    number, ids, labels = (part.column(c).to_numpy() for c in ("anchor", "vec_id", "label"))
                    q = _matrix(part.column("vector"), width)
                    low, high = (part.column(c).flatten().to_numpy().reshape(len(q), -1).copy() for c in ("low", "high"))
                    score = inner(q, sample)
                    counts = ((sample_labels[None, :] == labels[:, None]) == same) & (sample_ids[None, :] != ids[:, None])
                    for w in range(low.shape[1]):
                        inside = np.where(counts & (score >= low[:, w, None]) & (score <= high[:, w, None]), score, _LOW)
                        if inside.shape[1] >= k:  # the k-th best row of the sample is a lower limit
                            low[:, w] = np.maximum(low[:, w], np.partition(inside, -k, axis=1)[:, -k])
                    go = tree.visits(q, low, high)
                    leaves = np.flatnonzero(go.any(axis=0))
                    rows = []
                    for leaf in leaves:
                        i = np.flatnonzero(go[:, leaf])
                        rows.append((int(leaf), name, number[i].tobytes(), ids[i].tobytes(), labels[i].tobytes(), _packed(q[i], kind),
                                     low[i].tobytes(), high[i].tobytes()))
                    name += 1
                    for start in range(0, len(rows), 16):
                        yield _block_batch(rows[start:start + 16])

        spread = anchors.select("anchor", "vec_id", "label", "vector", "low", "high").repartitionByRange("anchor")
        return spread.mapInArrow(block, "leaf long, block long, anchors binary, a_ids binary, a_labels binary, a_vectors binary, "
                                        "low binary, high binary")


def _unit_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), *[pa.binary()] * 3]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], ["leaf", "ids", "labels", "vectors"])


def _block_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), *[pa.binary()] * 6]
    names = ["leaf", "block", "anchors", "a_ids", "a_labels", "a_vectors", "low", "high"]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)


def hard_negatives(vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 10,
                   from_percent: int = 30, to_percent: int = 90) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the anchors among ``vectors``.

    An anchor's positives are its ``positives`` best other rows of its label.
    For each, the first ``negatives`` rows of another label whose score is
    from 30 to 90 percent of the positive's (both ends included) follow, best
    score first, then the smaller id; a negative positive score has no such
    row.  Rows that share an id are rows of their own, but none is another row
    for an anchor of that id.  An anchor alone in its label, or without rows in
    the window, has no result; nor has an empty table.  A score beyond 64 bits
    raises an error.
    """
    mining = Mining(vectors)
    every = lambda n: F.array(F.lit(n).cast("long"))
    anchors = settle(mining.rows.where(is_anchor).withColumn("anchor", F.monotonically_increasing_id()), "anchors")
    good = mining.search(anchors.withColumns({"low": every(_LOW), "high": every(_HIGH)}), positives, True)
    best = good.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("place", "vec_id", "score"))).alias("best"))
    chosen = settle(anchors.join(best, "anchor"), "positives")
    score = F.transform("best", lambda p: p["score"])
    # 100 s >= from p and 100 s <= to p in whole numbers; windows that are not there have low > high.
    low = F.transform(score, lambda p: F.ceil(p.cast("decimal(20,0)") * from_percent / 100).cast("long"))
    high = F.transform(score, lambda p: F.floor(p.cast("decimal(20,0)") * to_percent / 100).cast("long"))
    pad = lambda c, n: F.concat(c, F.array_repeat(F.lit(n).cast("long"), F.lit(positives) - F.size("best")))
    bad = mining.search(chosen.withColumns({"low": pad(low, 1), "high": pad(high, 0)}), negatives, False)
    named = chosen.select("anchor", F.col("vec_id").alias("anchor_id"), F.posexplode("best").alias("w", "positive"))
    return bad.join(named, ["anchor", "w"]).select(
        "anchor_id", F.col("positive.vec_id").alias("positive_id"), F.col("place").cast("int").alias("rank"),
        F.col("vec_id").alias("negative_id"), F.col("positive.score").alias("positive_score"), F.col("score").alias("negative_score"))
