"""Rank correlation of many columns, and features pruned by it.

Two columns are ranked on the rows where both are present.  Columns present in
the same rows form a class, so a column needs one rank per class and not one
per partner.  The values of all columns are dealt out once in the order
(column, value); a sweep over a sorted chunk gives the ranks inside the
chunk for all classes, and what a chunk holds of a column, a few numbers, gives
the ranks of the column.  A second exchange brings the values of a row
together; a task adds up products of ranks as matrices, and the matrices, one
per block of columns and task, are summed in two steps.

Nothing is shuffled cell by cell: the cells that a slice of neighbouring rows
has in a chunk are one compressed block, sorted by value.  In this order
values and ranks rise, so their differences are what is stored, and a cell
is known by its place in the slice.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.ratios import amount_ratios, pairwise_ratios
from ..schema import C_COLS, D_COLS, V_COLS
from ..session import parallelism, scratch, settle
from .ordered import DRAWN, running_totals

# Columns whose sums a task hands over in one row.
BLOCK_COLUMNS = 512
# Ranks that a task multiplies at once.
HELD_RANKS = 4_000_000
# Values of a column that a task sorts at once, and blocks that it writes at once.
CHUNK_CELLS = 1_000_000
WRITTEN = 500
# First step of the sum: so many parts per block.
PARTS = 16
DEALT = "chunk int, slice bigint, n int, data binary"
RANKED = "slice bigint, chunk int, n int, first int, last int, data binary"
SUMS = "block int, part int, sums binary"
PAIRS = "col_i string, col_j string, n bigint, rho double"


def _finite(c: str) -> Column:
    """The value as double, null unless finite (NaN compares above infinity)."""
    return F.expr(f"case when abs(cast(`{c}` as double)) < double('infinity') then cast(`{c}` as double) end")


def _matrix(batch: pa.RecordBatch, width: int) -> np.ndarray:
    """Rows of values; NaN where one is missing or not finite."""
    flat = batch.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, width)
    return np.where(np.isfinite(flat), flat, np.nan)


def _presence_classes(work: DataFrame, width: int) -> tuple[list[list[int]], dict[int, int]]:
    """Columns grouped by the set of rows in which they are present, and in how many each is.

    A set is known by its size and two sums of row hashes; a task hands over one
    row per column.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((3, width), np.int64)
        for batch in batches:
            here = np.isfinite(_matrix(batch, width)).astype(np.int64)
            row = batch.column("row").to_numpy().astype(np.uint64)
            for k, factor in enumerate((0x9E3779B97F4A7C15, 0xD1B54A32D192ED03)):
                mixed = (row + np.uint64(1)) * np.uint64(factor)
                mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
                total[k] += (mixed >> np.uint64(33)).astype(np.int64) @ here
            total[2] += here.sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width)), *map(pa.array, total)], ["c", "h1", "h2", "n"])

    sums = work.mapInArrow(count, "c bigint, h1 bigint, h2 bigint, n bigint").groupBy("c").agg(
        *[F.sum(F.col(x).cast("decimal(38,0)")).alias(x) for x in ("n", "h1", "h2")])
    classes: dict[tuple, list[int]] = {}
    found = sums.where("n > 0").orderBy("c").collect()  # one row per column
    for r in found:
        classes.setdefault((r["n"], r["h1"], r["h2"]), []).append(r["c"])
    return list(classes.values()), {r["c"]: int(r["n"]) for r in found}


@dataclass
class Layout:
    """Which ranks a column needs (``wanted``: its classes) and what the pairs are.

    ``dealt`` are the columns with a partner, ``leaders`` one of them for each class.
    """

    names: list[str]
    classes: list[list[int]]
    own_ranks: bool
    goal: int | None = None
    apart: dict[str, int] | None = None
    block: int = 0
    held: int = 0
    bits: int = 0
    home: list[int] = field(default_factory=list)
    wanted: list[list[int]] = field(default_factory=list)
    dealt: list[int] = field(default_factory=list)
    leaders: list[int | None] = field(default_factory=list)

    def __post_init__(self):
        self.block, self.held = self.block or BLOCK_COLUMNS, self.held or HELD_RANKS
        self.home = [0] * len(self.names)
        for k, members in enumerate(self.classes):
            for c in members:
                self.home[c] = k
        used = sorted(c for members in self.classes for c in members)
        sets = [(self.apart or {}).get(n, -1) for n in self.names]
        self.wanted = [[] for _ in self.names]
        for c in used:
            partners = used if self.goal is None or c == self.goal else [self.goal]
            self.wanted[c] = sorted({self.home[j] for j in partners if j != c and not sets[j] == sets[c] >= 0})
        self.dealt = [c for c in used if self.wanted[c]]
        self.leaders = [next((c for c in members if self.wanted[c]), None) for members in self.classes]
        # Rows of a slice: their ranks are held at once.
        self.bits = min(13, max(5, (4 * self.held // (len(self.names) * len(self.classes))).bit_length() - 1))


class Chunks:
    """Borders of the chunks: each holds a stretch of one column in the order (value, slice)."""

    def __init__(self, layout: Layout, counts: dict[int, int], drawn, chunks: int | None):
        """``drawn(n)`` gives values and slices of n rows; ``chunks`` is about how many there are in all."""
        total = sum(counts[c] for c in layout.dealt)
        number = {c: max(1, round(chunks * counts[c] / total)) if chunks else -(-counts[c] // CHUNK_CELLS) for c in layout.dealt}
        values, slices = drawn(64 + DRAWN * max(number.values())) if max(number.values()) > 1 else (None, None)
        self.column, self.start, self.borders = [], {}, {}
        for c in layout.dealt:
            cuts = [np.zeros(0), np.zeros(0, np.int64)]
            if number[c] > 1:
                here = np.flatnonzero(np.isfinite(values[:, c]))
                here = here[np.lexsort((slices[here], values[here, c]))]
                at = here[[len(here) * i // number[c] for i in range(1, number[c])]] if len(here) else here
                cuts = [values[at, c], slices[at]]
            self.start[c], self.borders[c] = len(self.column), cuts
            self.column += [c] * (len(cuts[0]) + 1)

    def places(self, c: int, x: np.ndarray, part: int) -> np.ndarray:
        """Where the chunks of the column begin and end in the sorted values of a slice."""
        value, border = self.borders[c]
        inner = np.where(part >= border, np.searchsorted(x, value, "left"), np.searchsorted(x, value, "right"))
        return np.concatenate([[0], inner, [len(x)]])


def _planes(numbers: np.ndarray) -> bytes:
    """Rising numbers, line by line, as bytes of their differences: first bytes first, as they are alike."""
    steps = np.ascontiguousarray(np.diff(numbers, axis=1, prepend=numbers.dtype.type(0)))
    return steps.view(np.uint8).reshape(*steps.shape, steps.itemsize).transpose(2, 0, 1).tobytes()


def _risen(raw: np.ndarray, kind, lines: int, n: int) -> np.ndarray:
    """The reverse of :func:`_planes`."""
    size = np.dtype(kind).itemsize
    steps = np.ascontiguousarray(raw[:size * lines * n].reshape(size, lines, n).transpose(1, 2, 0)).view(kind).reshape(lines, n)
    return np.cumsum(steps, axis=1, dtype=kind)


def _squeezed(raw: bytes) -> bytes:
    return pa.compress(raw, codec="zstd", asbytes=True)


def _widened(raw, size: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(raw, decompressed_size=size, codec="zstd"), np.uint8)


def _dealt(layout: Layout, chunks: Chunks):
    """Task side: per slice and chunk the sorted values, their places in the slice and which classes these rows have."""
    width, mask = len(layout.names), (1 << layout.bits) - 1
    leaders = [c for c in layout.leaders if c is not None]
    known = [k for k, c in enumerate(layout.leaders) if c is not None]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            values, rows = _matrix(batch, width), batch.column("row").to_numpy()
            slices, made = rows >> layout.bits, []
            cuts = np.flatnonzero(np.r_[True, slices[1:] != slices[:-1], True])
            for start, end in zip(cuts[:-1], cuts[1:]):
                part, place, number = values[start:end], (rows[start:end] & mask).astype(np.uint16), int(slices[start])
                here = np.isfinite(part)
                flags = np.ones((end - start, len(layout.classes)), bool)
                if not layout.own_ranks:
                    flags[:, known] = here[:, leaders]
                flags = np.packbits(flags, axis=1, bitorder="little")
                for c in layout.dealt:
                    line = np.flatnonzero(here[:, c])
                    line = line[np.argsort(part[line, c], kind="stable")]
                    x = part[line, c]
                    at = chunks.places(c, x, number)
                    for i in np.flatnonzero(at[1:] > at[:-1]):
                        cells = slice(at[i], at[i + 1])
                        raw = _planes(x[cells].view(np.int64)[None]) + place[line[cells]].tobytes() + flags[line[cells]].T.tobytes()
                        made.append((chunks.start[c] + int(i), number, int(at[i + 1] - at[i]), _squeezed(raw)))
            for at in range(0, len(made), WRITTEN):
                columns = list(zip(*made[at:at + WRITTEN]))
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(columns, (pa.int32(), pa.int64(), pa.int32(), pa.binary()))],
                                                 ["chunk", "slice", "n", "data"])

    return run


def _sweep(layout: Layout, chunks: Chunks):
    """Task side: twice the ranks inside a chunk, for each class a column needs.

    A block goes back to its slice in the order in which it came; ``first`` and
    ``last`` are how many of its cells have the first and the last value of the
    chunk.  Per chunk a last row (slice -1) holds what the chunk has: rows per
    class in all, with the first and with the last value, and these two values.
    """
    width = len(layout.classes) + 7 >> 3

    def ranked(chunk: int, held: list) -> Iterator[tuple]:
        need = layout.wanted[chunks.column[chunk]]
        blocks = []
        for _, n, data in held:
            raw = _widened(data, n * (10 + width))
            blocks.append((_risen(raw, np.int64, 1, n)[0].view(np.float64), raw[8 * n:10 * n], raw[10 * n:].reshape(width, n)))
        x = np.concatenate([b[0] for b in blocks])
        bits = np.concatenate([b[2] for b in blocks], axis=1)
        order = np.argsort(x, kind="stable")
        value = x[order]
        new = np.r_[True, value[1:] != value[:-1]]
        first, group = np.flatnonzero(new), np.cumsum(new) - 1
        last = np.append(first[1:], len(value))
        twice, counts = np.empty((len(need), len(value)), np.int32), np.zeros((3, len(need)), np.int64)
        for at, k in enumerate(need):
            upto = np.concatenate([[0], np.cumsum(bits[k >> 3, order] >> (k & 7) & 1, dtype=np.int64)])
            twice[at, order] = (upto[first] + upto[last] + 1)[group]
            counts[:, at] = upto[-1], upto[last[0]], upto[-1] - upto[first[-1]]
        start = 0
        for (number, n, _), (own, place, _) in zip(held, blocks):
            low = int(np.count_nonzero(own == value[0]))
            high = 0 if value[0] == value[-1] else int(np.count_nonzero(own == value[-1]))
            yield number, chunk, n, low, high, _squeezed(place.tobytes() + _planes(twice[:, start:start + n]))
            start += n
        yield -1, chunk, 0, 0, 0, counts.tobytes() + value[[0, -1]].tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def written(rows: list) -> pa.RecordBatch:
            kinds = (pa.int64(), *[pa.int32()] * 4, pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows), kinds)], ["slice", "chunk", "n", "first", "last", "data"])

        def finished(chunk: int, held: list) -> Iterator[pa.RecordBatch]:
            rows = []
            for row in ranked(chunk, held):
                rows.append(row)
                if len(rows) == WRITTEN:
                    yield written(rows)
                    rows = []
            if rows:
                yield written(rows)

        chunk, held = None, []
        for batch in batches:
            for one, *block in zip(*(batch.column(n).to_pylist() for n in ("chunk", "slice", "n", "data"))):
                if one != chunk and held:
                    yield from finished(chunk, held)
                    held = []
                chunk = one
                held.append(block)
        if held:
            yield from finished(chunk, held)

    return run


class Carried:
    """What to add to twice the ranks of a chunk, and twice the ranks of its first and last value.

    Made of one row per chunk, so its size depends on classes and chunks and
    not on rows.
    """

    def __init__(self, totals, layout: Layout, chunks: Chunks):
        rows = sorted((chunks.column[r["chunk"]], r["chunk"], r["data"]) for r in totals)
        self.at = {chunk: i for i, (_, chunk, _) in enumerate(rows)}
        self.base, self.first, self.last = np.zeros((3, len(rows), len(layout.classes)))
        at = 0
        while at < len(rows):
            end = at
            while end < len(rows) and rows[end][0] == rows[at][0]:
                end += 1
            wide = len(layout.wanted[rows[at][0]])
            counts = np.array([np.frombuffer(raw[:24 * wide], np.int64).reshape(3, wide) for _, _, raw in rows[at:end]])
            values = np.array([np.frombuffer(raw[24 * wide:], np.float64) for _, _, raw in rows[at:end]])
            before = np.cumsum(counts[:, 0], axis=0) - counts[:, 0]
            self.base[at:end, :wide] = 2 * before
            # A value may go on over several chunks: where it begins and how many rows it has in all.
            starts: dict[float, np.ndarray] = {}
            sizes: dict[float, np.ndarray] = {}
            for i in range(end - at):
                low, high = values[i]
                starts.setdefault(low, before[i])
                sizes[low] = sizes.get(low, 0) + counts[i, 1]
                if high != low:
                    starts.setdefault(high, before[i] + counts[i, 0] - counts[i, 2])
                    sizes[high] = sizes.get(high, 0) + counts[i, 2]
            for i in range(end - at):
                for out, value in ((self.first, values[i, 0]), (self.last, values[i, 1])):
                    out[at + i, :wide] = 2 * starts[value] + sizes[value] + 1
            at = end

    def whole(self, chunk: int, twice: np.ndarray, first: int, last: int) -> np.ndarray:
        """Ranks in the whole column of a block of cells sorted by value, a line per class."""
        at, (wide, n) = self.at[chunk], twice.shape
        ranks = twice + self.base[at, :wide, None]
        ranks[:, :first] = self.first[at, :wide, None]
        ranks[:, n - last:] = self.last[at, :wide, None]
        return ranks / 2


def _products(layout: Layout, chunks: Chunks, carried: Carried):
    """Task side: sums over the rows of a partition, which is sorted by slice; one output row per block of columns."""
    p, depth = len(layout.names), len(layout.classes)
    classes, goal, home = layout.classes, layout.goal, layout.home

    def add(sums: dict[str, np.ndarray], dense: np.ndarray) -> None:
        here, full = ~np.isnan(dense), np.nan_to_num(dense)
        if layout.own_ranks:
            here, full = here[:, :, 0].astype(float), full[:, :, 0]
            square = full * full
            for name, product in (("n", here.T @ here), ("s", full.T @ here), ("q", square.T @ here), ("x", full.T @ full)):
                sums[name] += product
            return
        sums["n"] += here.sum(axis=0)
        sums["s"] += full.sum(axis=0)
        sums["q"] += np.einsum("rck,rck->ck", full, full)
        if goal is not None:
            for b, members in enumerate(classes):
                sums["x"][goal, members] += full[:, goal, b] @ full[:, members, home[goal]]
            return
        for a, one in enumerate(classes):
            for b in range(a, len(classes)):
                product = full[:, one, b].T @ full[:, classes[b], a]
                sums["x"][np.ix_(one, classes[b])] += product
                if b != a:
                    sums["x"][np.ix_(classes[b], one)] += product.T

    def put(sums: dict[str, np.ndarray], cells: list) -> None:
        """The ranks of a slice, so many rows at a time as may be held."""
        rows = 1 + max(int(place.max()) for _, place, _ in cells)
        step = max(1, layout.held // (p * depth))
        for low in range(0, rows, step):
            dense = np.full((min(step, rows - low), p, depth), np.nan)
            present = np.zeros(dense.shape[:2], bool)
            for c, place, ranks in cells:
                mine = np.flatnonzero((place >= low) & (place < low + step))
                line = place[mine] - low
                present[line, c] = True
                dense[line[:, None], c, np.array(layout.wanted[c])[None]] = ranks[:, mine].T
            if not layout.own_ranks:
                for k, leader in enumerate(layout.leaders):
                    if leader is not None:
                        dense[~present[:, leader], :, k] = np.nan
            add(sums, dense)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        square = (p, p) if layout.own_ranks else (p, depth)
        sums = {"x": np.zeros((p, p)), **{name: np.zeros(square) for name in "nsq"}}
        current, part, cells = None, None, []
        for batch in batches:
            for number, chunk, n, first, last, data in zip(*(batch.column(i).to_pylist() for i in range(6))):
                if number != current and cells:
                    put(sums, cells)
                    cells = []
                current, part = number, number % PARTS if part is None else part
                c = chunks.column[chunk]
                wide = len(layout.wanted[c])
                raw = _widened(data, n * (2 + 4 * wide))
                twice = _risen(raw[2 * n:], np.int32, wide, n)
                cells.append((c, raw[:2 * n].view(np.uint16).astype(np.int64), carried.whole(chunk, twice, first, last)))
        if part is None:
            return
        put(sums, cells)
        narrow = [] if layout.own_ranks else [sums[n].ravel() for n in "nsq"]
        for block, at in enumerate(range(0, p, layout.block)):
            to = at + layout.block
            own = [sums["x"][at:to].ravel()]
            if layout.own_ranks:
                own += [sums[n][at:to].ravel() for n in "nsq"] + [sums[n][:, at:to].T.ravel() for n in "sq"]
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([part], pa.int32()),
                                              pa.array([np.concatenate([*own, *narrow]).tobytes()], pa.binary())], ["block", "part", "sums"])

    return run


def _summed(parts: DataFrame, keys: list[str]) -> DataFrame:
    """The matrices of equal keys added up as they arrive; one of each key is held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple, np.ndarray] = {}
        for batch in batches:
            for block, part, raw in zip(*(batch.column(n).to_pylist() for n in ("block", "part", "sums"))):
                key = (block, part if "part" in keys else 0)
                one = np.frombuffer(raw, np.float64)
                total[key] = total[key] + one if key in total else one
        for (block, part), sums in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([part], pa.int32()), pa.array([sums.tobytes()], pa.binary())],
                                             ["block", "part", "sums"])

    return parts.repartition(*keys).mapInArrow(run, SUMS)


def _pairs(layout: Layout):
    """Task side: the pairs of a block of columns; with ``apart`` none of two columns that have one number there."""
    p, depth, names = len(layout.names), len(layout.classes), np.array(layout.names, dtype=object)
    home = np.array(layout.home)
    sets = np.array([(layout.apart or {}).get(n, -1) for n in layout.names])
    used = np.isin(np.arange(p), [c for members in layout.classes for c in members])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, raw in zip(batch.column("block").to_pylist(), batch.column("sums").to_pylist()):
                sums = np.frombuffer(raw, np.float64)
                low = block * layout.block
                size = min(layout.block, p - low)
                x, rest = sums[:size * p].reshape(size, p), sums[size * p:]
                i, j = np.arange(low, low + size), np.arange(p)
                if layout.own_ranks:
                    n, si, qi, sj, qj = rest.reshape(5, size, p)
                else:
                    full = rest.reshape(3, p, depth)
                    n, si, qi = (f[low:low + size][:, home] for f in full)
                    sj, qj = (np.broadcast_to(f[:, home[layout.goal]], (size, p)) if layout.goal is not None else f[:, home[i]].T for f in full[1:])
                yield from emit(i, j, x, n, si, qi, sj, qj)

    def emit(i, j, x, n, si, qi, sj, qj) -> Iterator[pa.RecordBatch]:
        keep = (i[:, None] < j[None, :]) if layout.goal is None else (i[:, None] == layout.goal) & (j[None, :] != layout.goal)
        keep = keep & (n > 0) & used[i][:, None] & used[j][None, :] & ~((sets[i][:, None] == sets[j][None, :]) & (sets[i] >= 0)[:, None])
        a, b = np.nonzero(keep)
        if not len(a):
            return
        count, s1, s2, q1, q2 = n[a, b], si[a, b], sj[a, b], qi[a, b], qj[a, b]
        over = count * x[a, b] - s1 * s2
        spread = np.sqrt(np.maximum((count * q1 - s1 * s1) * (count * q2 - s2 * s2), 0.0))
        rho = pa.array(np.divide(over, spread, out=np.zeros_like(over), where=spread > 0), mask=spread <= 0)
        one, two = np.minimum(i[a], j[b]), np.maximum(i[a], j[b])
        yield pa.RecordBatch.from_arrays([pa.array(names[one], pa.string()), pa.array(names[two], pa.string()),
                                          pa.array(count.astype(np.int64)), rho], ["col_i", "col_j", "n", "rho"])

    return run


def spearman_pairs(df: DataFrame, columns, method: str = "pairwise", target: str | None = None,
                   chunks: int | None = None, apart: dict[str, int] | None = None) -> DataFrame:
    """(col_i, col_j, n, rho) for every pair i < j of the listed columns.

    Only finite values count; every row counts, whatever its key.  ``method='pairwise'`` ranks each pair on the rows
    where both are present: exact.  ``method='column_ranks'`` ranks a column over its own rows only; it differs
    from the exact result where the row sets differ.  With ``target`` only pairs with that column are returned, with
    ``apart`` none of two columns that have the same number there.
    """
    names = list(dict.fromkeys([*columns, *([target] if target else [])]))
    if method not in ("pairwise", "column_ranks"):
        raise ValueError("method must be 'pairwise' or 'column_ranks'")
    spark = df.sparkSession
    empty = spark.createDataFrame([], PAIRS)
    with scratch(spark) as made:
        # The work per row grows with (columns * classes) from here on: rows that came in few large files are spread first.
        values = df.select(F.array(*[F.col(f"`{c}`").cast("double") for c in names]).alias("v")).repartition(parallelism(spark))
        work = settle(values.withColumn("row", F.monotonically_increasing_id()), "finite", compression="zstd")
        classes, counts = _presence_classes(work, len(names))
        own_ranks = method == "column_ranks"
        if own_ranks and classes:
            classes = [sorted(c for members in classes for c in members)]
        goal = names.index(target) if target else None
        if not classes or goal is not None and not any(goal in members for members in classes):
            return empty
        layout = Layout(names, classes, own_ranks, goal, apart)
        if not layout.dealt:
            return empty

        def drawn(n: int) -> tuple[np.ndarray, np.ndarray]:
            some = work.orderBy(F.xxhash64("row")).limit(n).toArrow().combine_chunks().to_batches()[0]  # bounded by the number of chunks
            return _matrix(some, len(names)), some.column("row").to_numpy() >> layout.bits

        parts = Chunks(layout, counts, drawn, chunks)
        most, cells = int(spark.conf.get("spark.sql.shuffle.partitions")), sum(counts[c] for c in layout.dealt)
        tasks, total = min(len(parts.column), most, 1 + cells // 20_000), len(parts.column)
        dealt = work.mapInArrow(_dealt(layout, parts), DEALT).withColumn("task", F.expr(f"cast(cast(chunk as bigint) * {tasks} div {total} as int)"))
        sorted_cells = dealt.repartitionById(tasks, "task").sortWithinPartitions("chunk").drop("task")
        swept = made.keep(settle(sorted_cells.mapInArrow(_sweep(layout, parts), RANKED), "ranks"))
    carried = Carried(swept.where("slice = -1").select("chunk", "data").collect(), layout, parts)
    rows = swept.where("slice >= 0").repartition("slice").sortWithinPartitions("slice")
    sums = _summed(_summed(rows.mapInArrow(_products(layout, parts, carried), SUMS), ["block", "part"]), ["block"])
    return sums.mapInArrow(_pairs(layout), PAIRS)


def correlated_later(pairs: DataFrame, threshold: float = 0.99) -> DataFrame:
    """(column): columns correlated with any earlier column, dropped or not."""
    return pairs.where(F.abs("rho") > threshold).select(F.col("col_j").alias("column")).distinct()


def correlated_columns(df: DataFrame, columns, threshold: float = 0.99, method: str = "pairwise",
                       apart: dict[str, int] | None = None) -> list[str]:
    with scratch(df.sparkSession):
        found = {r["column"] for r in correlated_later(spearman_pairs(df, columns, method, apart=apart), threshold).collect()}
    return [c for c in columns if c in found]


def related_columns(df: DataFrame, columns, label: str, rho: float | None = None, ks: float | None = None) -> list[str]:
    """Columns whose rank correlation with the label is at least ``rho`` in size and whose gap
    between the two classes is at least ``ks``; a limit that is not given does not count."""
    kept = set(columns)
    if rho is not None:
        other = F.when(F.col("col_i") == label, F.col("col_j")).otherwise(F.col("col_i"))
        close = spearman_pairs(df, columns, target=label).where(F.abs("rho") >= rho)
        kept &= {r["column"] for r in close.select(other.alias("column")).collect()}
    if ks is not None:
        kept &= {r["column"] for r in kolmogorov_smirnov(df, columns, label).where(F.col("ks") >= ks).collect()}
    return [c for c in columns if c in kept]


def pruned_ratios(df: DataFrame, fit_on: Column | None = None, threshold: float = 0.99, base=None,
                  divided=None, method: str = "pairwise") -> tuple[DataFrame, dict[str, list[str]]]:
    """Ratio features without those that repeat an earlier one, fitted on the training rows.

    Three passes: column / amount; pairwise ratios; then base columns and all
    survivors together, where pairs of the first two passes need no second look.  Returns the table and the columns dropped per pass.
    """
    base = [c for c in (base or [*C_COLS, *D_COLS, *V_COLS]) if c in df.columns]
    divided = [c for c in (divided or [*C_COLS, *D_COLS]) if c in df.columns]
    by_amount, by_pair = amount_ratios(df, base), pairwise_ratios(df, divided)
    wide = df.select("*", *[e.alias(n) for n, e in {**by_amount, **by_pair}.items()])
    train = wide.where(fit_on) if fit_on is not None else wide
    dropped = {}
    dropped["by_amount"] = correlated_columns(train, list(by_amount), threshold, method)
    dropped["by_pair"] = correlated_columns(train, list(by_pair), threshold, method)
    gone = {*dropped["by_amount"], *dropped["by_pair"]}
    rest = [c for c in [*base, *by_amount, *by_pair] if c not in gone]
    apart = {c: i for i, made in enumerate((by_amount, by_pair)) for c in made}
    dropped["together"] = correlated_columns(train, rest, threshold, method, apart)
    return wide.drop(*gone, *dropped["together"]), dropped


def kolmogorov_smirnov(df: DataFrame, columns, label: str, chunks: int | None = None) -> DataFrame:
    """(column, ks): largest gap between the distributions of a column in the two classes."""
    long = df.select(label, *[_finite(c).alias(c) for c in columns]).unpivot(
        [label], list(columns), "column", "x").where("x is not null")
    counts = settle(long.groupBy("column", "x").agg(
        F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) == 0).alias("n")), "values")
    below = running_totals(counts, ["column"], ["x"], {"_p": F.col("p"), "_n": F.col("n")}, chunks)
    totals = settle(counts.groupBy("column").agg(F.sum("p").alias("_tp"), F.sum("n").alias("_tn")), "totals")
    gap = F.abs(F.try_divide(F.col("_p") + F.col("p"), F.col("_tp")) - F.try_divide(
        F.col("_n") + F.col("n"), F.col("_tn")))
    return below.join(totals, "column").groupBy("column").agg(F.max(gap).alias("ks"))
