"""Repeated byte strings by column-wise construction of a collection's BWT and common prefixes.

A byte is removed if a string of ``LENGTH`` bytes over it also starts anywhere
else.  Inserting one symbol of every document per round needs as many rounds
as the longest text has bytes, each over the whole collection.  Two facts make
the rounds few and the collections small without losing a string:

* Every window of ``LENGTH`` bytes has a leftmost smallest gram of ``GRAM``
  bytes (by hash), its anchor.  Equal windows have equal anchors at the same
  place, so only windows whose anchor gram occurs twice can be repeated.
* The pieces of text around equal anchors are aligned at the anchor.  Equal
  windows then start in the same column, and a column-wise construction over
  at most ``LENGTH + LENGTH - GRAM`` columns sees all of them.

A task gets the pieces of some anchor grams.  Each round inserts one column,
from the right: the symbols in the order of the suffixes to their right are the
next column of the Burrows-Wheeler transform, a stable sort by them gives the
new order, and the common prefix of two new neighbours is one more than the
smallest one between them before.  Where it reaches ``LENGTH``, the windows of
both pieces are repeated.  The pieces pass through Spark's sorted shuffle
files, so a task reads them in sequence and holds ``CHUNK`` at a time.

Grams with more than ``HOT`` occurrences are never gathered: equal pieces are
collapsed by an aggregate, and what differs is split by window offset into
halves, keyed by the bytes that all windows of a half share, until every window
is resolved (``_hot_marks``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from ..session import settle
from .text import mix, slices, text_buffer

LENGTH = 400
GRAM = 64
HOT = 512
CHUNK = 4096
#: Bytes of one long text that are searched for anchors at once.
PART = 1 << 23



class Powers:
    """Powers of an odd base modulo 2**64, grown on demand and kept by the worker."""

    def __init__(self, base: int):
        self.base, self.table = np.uint64(base), np.ones(1, dtype=np.uint64)

    def upto(self, n: int) -> np.ndarray:
        if len(self.table) < n:
            factors = np.full(max(n, 2 * len(self.table)), self.base, dtype=np.uint64)
            factors[0] = 1
            self.table = np.cumprod(factors, dtype=np.uint64)
        return self.table[:n]


_BASE = 0x9E3779B97F4A7C15
_UP, _DOWN = Powers(_BASE), Powers(pow(_BASE, -1, 1 << 64))
_BYTES = mix((np.arange(256, dtype=np.uint64) + np.uint64(1)) * np.uint64(0xD1B54A32D192ED03))


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """Hash of every string of ``gram`` bytes, by differences of one running sum."""
    n = len(data)
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(_BYTES[data] * _UP.upto(n), out=total[1:])
    return mix((total[gram:] - total[:-gram]) * _DOWN.upto(n - gram + 1))


def smallest_in_windows(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` consecutive values."""
    span, low = 1, values
    while 2 * span <= width:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    rest = width - span
    return np.minimum(low[:len(low) - rest], low[rest:]) if rest else low


def anchors(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(document, anchor, first window, last window, gram hash): maximal runs of windows with one anchor."""
    out = []
    n = len(data)
    document = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    room = offsets[1:][document] - np.arange(n) if n else np.zeros(0, np.int64)
    for at in range(0, max(1, n - length + 1), PART):
        part = data[at:at + PART + length - 1]
        if len(part) < length:
            continue
        h = gram_hashes(part, gram)
        key = (h & ~np.uint64((1 << 24) - 1)) | np.arange(len(h), dtype=np.uint64)
        best = smallest_in_windows(key, length - gram + 1)
        start = np.flatnonzero(room[at:at + len(best)] >= length)
        if len(start) == 0:
            continue
        place = (best[start] & np.uint64((1 << 24) - 1)).astype(np.int64)
        new = np.ones(len(start), dtype=bool)
        new[1:] = (place[1:] != place[:-1]) | (start[1:] != start[:-1] + 1)
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(start)) - 1
        doc = document[at + start[first]]
        base = offsets[:-1][doc]
        out.append((doc, at + place[first] - base, at + start[first] - base, at + start[last] - base, h[place[first]]))
    if not out:
        return tuple(np.zeros(0, np.int64) for _ in range(4)) + (np.zeros(0, np.uint64),)
    return tuple(np.concatenate(x) for x in zip(*out))


def repeated_windows(pieces: list[bytes], lefts: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """For pieces aligned at their anchors (``lefts`` bytes from their starts): which windows are repeated.

    Row per piece, column per aligned place; True where the window of
    ``length`` bytes that starts there is also in another piece.
    """
    n = len(pieces)
    sizes = np.fromiter(map(len, pieces), np.int64, n)
    left = int(lefts.max())
    width = left + int((sizes - lefts).max())
    table = np.zeros((width, n), dtype=np.uint16)   # a row per column of the alignment; 0 is outside, else byte + 1
    for i, piece in enumerate(pieces):
        at = left - lefts[i]
        table[at:at + sizes[i], i] = np.frombuffer(piece, np.uint8)
        table[at:at + sizes[i], i] += 1
    found = np.zeros((n, width), dtype=bool)
    order, prefix = np.arange(n), np.zeros(n, dtype=np.int64)  # prefix[i]: of suffixes i - 1 and i in order
    for column in range(width - 1, -1, -1):
        bwt = table[column][order]
        moved = np.argsort(bwt, kind="stable")
        symbol = bwt[moved]
        same = np.flatnonzero((symbol[1:] == symbol[:-1]) & (symbol[1:] > 0))
        fresh = np.zeros(n, dtype=np.int64)
        if len(same):
            bounds = np.empty(2 * len(same), dtype=np.int64)
            bounds[::2], bounds[1::2] = moved[same] + 1, moved[same + 1] + 1
            padded = np.append(prefix, 0)
            fresh[same + 1] = np.minimum(np.minimum.reduceat(padded, bounds)[::2] + 1, length)
        order, prefix = order[moved], fresh
        hit = np.flatnonzero(prefix == length)
        found[order[hit], column] = True
        found[order[hit - 1], column] = True
    return found


def _anchor_table(docs: DataFrame, length: int, gram: int) -> DataFrame:
    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("place"), "text").where("text is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch):
                doc, at, first, last, h = anchors(*text_buffer(piece.column(2)), length, gram)
                own = pa.array(doc)
                yield pa.RecordBatch.from_arrays(
                    [piece.column(0).take(own), piece.column(1).take(own), pa.array(at.astype(np.int32)),
                     pa.array(first.astype(np.int32)), pa.array(last.astype(np.int32)), pa.array(h.view(np.int64))],
                    ["doc_id", "place", "at", "first", "last", "gram"])

    return rows.mapInArrow(run, "doc_id long, place long, at int, first int, last int, gram long")


_ID = ["doc_id", "place"]
_PIECE = "gram long, n long, doc_id long, place long, first int, last int, at int, piece binary"


def _pieces(docs: DataFrame, chosen: DataFrame, length: int) -> DataFrame:
    """The bytes of the windows of each chosen anchor."""
    lists = chosen.groupBy(*_ID).agg(F.collect_list(F.struct("gram", "n", "at", "first", "last")).alias("list")).select(
        F.col("doc_id").alias("_id"), F.col("place").alias("_place"), "list")
    texts = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("place"), "text")
    both = texts.join(lists, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("place") == F.col("_place"))).select(
        *_ID, "text", "list")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                rows = part.column(3)
                items = rows.flatten()
                doc = pa.array(np.repeat(np.arange(part.num_rows), np.diff(np.asarray(rows.offsets))))
                gram, n, at, first, last = items.flatten()
                data, offsets = text_buffer(part.column(2))
                base = offsets[:-1][doc.to_numpy()]
                raw = data.tobytes()
                starts, ends = base + first.to_numpy(), base + last.to_numpy() + length
                cut = pa.array([raw[s:e] for s, e in zip(starts.tolist(), ends.tolist())], pa.binary())
                yield pa.RecordBatch.from_arrays([gram, n, part.column(0).take(doc), part.column(1).take(doc), first, last, at, cut],
                                                 ["gram", "n", "doc_id", "place", "first", "last", "at", "piece"])

    return both.mapInArrow(run, _PIECE)


_MARK = "doc_id long, place long, start int, end int"


def _cold_marks(pieces: DataFrame, length: int) -> DataFrame:
    """Repeated strings of grams with few occurrences; whole groups of one gram are worked on together."""
    dealt = pieces.repartition("gram").sortWithinPartitions("gram")

    def work(group: pa.Table) -> pa.RecordBatch:
        first = group.column("first").to_numpy()
        lefts = (group.column("at").to_numpy() - first).astype(np.int64)
        found = repeated_windows(group.column("piece").to_pylist(), lefts, length)
        edge = np.zeros((len(found), found.shape[1] + 1), dtype=np.int8)
        edge[:, :-1] = found
        step = np.diff(edge, axis=1, prepend=np.int8(0))
        row, start = np.nonzero(step == 1)
        _, end = np.nonzero(step == -1)
        shift = first[row] - (int(lefts.max()) - lefts[row])
        own = pa.array(row)
        return pa.RecordBatch.from_arrays([
            group.column("doc_id").combine_chunks().take(own), group.column("place").combine_chunks().take(own),
            pa.array((start + shift).astype(np.int32)), pa.array((end - 1 + shift + length).astype(np.int32))],
            ["doc_id", "place", "start", "end"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                take = min(CHUNK, batch.num_rows - at)
                held.append(batch.slice(at, take))
                at, size = at + take, size + take
                if size >= CHUNK:
                    table = pa.Table.from_batches(held)
                    gram = table.column("gram").to_numpy()
                    whole = int(np.searchsorted(gram, gram[-1]))  # the last gram may go on
                    if whole:
                        yield work(table.slice(0, whole))
                        held = table.slice(whole).to_batches()
                        size -= whole
        if size:
            yield work(pa.Table.from_batches(held))

    return dealt.mapInArrow(run, _MARK)


_RANGE = ("gram long, low int, high int, core long, context long, doc_id long, place long, first int, at int, piece binary")


def _range_rows(rows: DataFrame, width: int, length: int, halve: bool) -> DataFrame:
    """Each row cut to ranges of ``width`` window offsets, with hashes of its common core and of all its windows.

    An offset is anchor - window start.  Ranges are aligned to multiples of
    ``width``; a row covers the part of a range that its own windows reach.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for r in batch.to_pylist():
                at, first, piece = r["at"], r["first"], r["piece"]
                low, high = (r["low"], r["high"]) if halve else (at - r["last"], at - first)
                for number in range(low // width, high // width + 1):
                    a, b = max(low, number * width), min(high, number * width + width - 1)
                    begin, end = at - b - first, at - a - first + length
                    top = at - number * width - first
                    core = piece[top:top + max(0, length - width + 1)]
                    out.append((r["gram"], a, b, _h(core, number), _h(piece[begin:end], number), r["doc_id"], r["place"],
                                first + begin, at, piece[begin:end]))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), _RANGE_TYPES)], _RANGE_NAMES)

    return rows.mapInArrow(run, _RANGE)


_RANGE_NAMES = [f.split()[0] for f in _RANGE.split(", ")]
_RANGE_TYPES = [{"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}[f.split()[1]] for f in _RANGE.split(", ")]


def _h(raw: bytes, number: int) -> int:
    return int(np.int64(np.uint64(xxhash.xxh3_64_intdigest(raw, seed=number))))


def _hot_marks(pieces: DataFrame, length: int, gram: int) -> list[DataFrame]:
    """Repeated strings of grams with many occurrences, without gathering a group.

    Rows with the same windows are equal to each other throughout, so all of
    them are marked and one goes on for the others' sake.  A range that is left
    with different rows is halved; a half whose key has one row is done.
    """
    marks = []
    width = 1 << (length - gram).bit_length()
    rows, halve = pieces, False
    while True:
        ranges = settle(_range_rows(rows, width, length, halve), "ranges")
        key = ["gram", "low", "high", "context"]
        owner = F.first(F.struct(*_ID, "first", "at", "piece", "core"))
        distinct = ranges.groupBy(*key).agg(owner.alias("o"), F.count(F.lit(1)).alias("n"))
        distinct = settle(distinct.select(*key, "n", "o.*"), "distinct")
        again = distinct.where("n > 1").select(*key)
        marks.append(settle(ranges.join(again, key, "left_semi").select(
            *_ID, F.col("first").alias("start"), (F.col("first") + F.col("high") - F.col("low") + length).cast("int").alias("end")),
            "marks"))
        if width == 1:
            return marks
        block = F.floor(F.col("low") / width).alias("block")
        alive = distinct.groupBy("gram", block, "core").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")
        rows = distinct.withColumn("block", F.floor(F.col("low") / width)).join(alive, ["gram", "block", "core"], "left_semi")
        rows = settle(rows.select("gram", "low", "high", *_ID, "first", "at", "piece"), "open")
        if rows.isEmpty():
            return marks
        width, halve = width // 2, True


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """(doc_id, place, spans): maximal [start, end) bytes of each text that repeated strings cover.

    ``place`` is xxhash64 of the text.  Rows with equal id and text repeat each
    other.  Texts shorter than ``length`` have no string.
    """
    if not 0 < gram <= length:
        raise ValueError("a gram must fit into a string")
    table = settle(_anchor_table(docs, length, gram), "anchors")
    # Written, so that the join is not bound to the aggregate's partitions and can split a frequent gram.
    counts = settle(table.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "counts", compression="zstd")
    chosen = table.join(counts, "gram")
    pieces = settle(_pieces(docs, chosen, length), "pieces")
    marks = [_cold_marks(pieces.where(F.col("n") <= hot), length)]
    many = pieces.where(F.col("n") > hot)
    if not many.isEmpty():
        marks += _hot_marks(many, length, gram)
    every = marks[0]
    for more in marks[1:]:
        every = every.unionByName(more)
    lists = every.groupBy(*_ID).agg(F.collect_list(F.struct("start", "end")).alias("marks"))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [_joined(m) for m in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(spans, _SPANS)], [*_ID, "spans"])

    return lists.mapInArrow(join, "doc_id long, place long, spans array<struct<start:int,end:int>>")


_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def _joined(marks: pa.ListScalar) -> list[dict]:
    """Overlapping and touching marks as maximal spans."""
    start, end = (x.to_numpy() for x in marks.values.flatten())
    order = np.argsort(start, kind="stable")
    start, reach = start[order], np.maximum.accumulate(end[order])
    first = np.flatnonzero(np.append(True, start[1:] > reach[:-1]))
    last = np.append(first[1:], len(start)) - 1
    return [{"start": s, "end": e} for s, e in zip(start[first].tolist(), reach[last].tolist())]


def drop_repeated_strings(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc_id, n_bytes, spans, kept): every row with its removed spans and the bytes that are left.

    A null text is empty.  Other columns are not read.
    """
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    spans = repeated_spans(docs, length).select(F.col("doc_id").alias("_id"), F.col("place").alias("_place"), "spans")
    rows = docs.withColumn("place", F.xxhash64("text"))
    joined = rows.join(spans, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("place") == F.col("_place")), "left")
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = batch.column(3).to_pylist()
            hit = [i for i, s in enumerate(spans) if s]
            kept = batch.column(2)
            if hit:
                new = kept.to_pylist()
                for i in hit:
                    at, out = 0, []
                    for s in spans[i]:
                        out.append(new[i][at:s["start"]])
                        at = s["end"]
                    new[i] = b"".join([*out, new[i][at:]])
                kept = pa.array(new, pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(3), kept],
                                             ["doc_id", "n_bytes", "spans", "kept"])

    return joined.select("doc_id", F.octet_length(raw).cast("long").alias("n_bytes"), raw.alias("raw"), "spans").mapInArrow(
        run, "doc_id long, n_bytes long, spans array<struct<start:int,end:int>>, kept binary")
