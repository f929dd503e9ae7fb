"""Best-fit packing by length patterns.

A sequence of ``tokens`` tokens holds whole documents; only a document that is
longer is cut, into pieces of that length and a rest.  All that the packing
needs to know is how many pieces there are of each length, a histogram of at
most ``tokens`` numbers whatever the size of the corpus:

1. patterns of few pieces that fill a sequence are enumerated: one to four
   pieces of at most two different lengths;
2. how often each is used is fitted to the histogram by non-negative least
   squares, rounded, and held to what the histogram has;
3. what is left of the histogram goes best-fit decreasing into sequences, all
   pieces of a length at once.

The result is a list of runs: so many equal sequences take so many pieces of a
length each.  A piece finds its run by its rank among the pieces of its length,
so the pieces are exchanged once, in chunks of the order (length, id), and the
ids of their tokens never move.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from ..operators.ordered import row_index
from ..session import settle
from .text import slices
from .tokens import VOCABULARY, encoder, with_end

SEQUENCE_TOKENS = 2048
END_ID = 0
#: Pieces of a pattern at most, and updates of the fit.
PATTERN_PIECES = 4
FIT_ROUNDS = 400

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, salt long"
PLACED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"

#: (times, ((length, pieces), ...)): so many sequences that hold so many pieces of each length.
Group = tuple[int, tuple[tuple[int, int], ...]]


def length_patterns(tokens: int, pieces: int = PATTERN_PIECES) -> np.ndarray:
    """Rows (a, p, b, q): p pieces of length a and q <= p of length b fill a sequence; q = 0: one length."""
    found = {(tokens // p, p, 0, 0) for p in range(1, pieces + 1) if tokens % p == 0}
    for p in range(1, pieces):
        for q in range(1, min(p, pieces - p) + 1):
            for a in range(1, tokens // p + 1):
                b, odd = divmod(tokens - a * p, q)
                if b > 0 and not odd and b != a and (p > q or a > b):
                    found.add((a, p, b, q))
    return np.array(sorted(found, reverse=True), dtype=np.int64).reshape(-1, 4)


def fitted_counts(histogram: np.ndarray, patterns: np.ndarray, rounds: int = FIT_ROUNDS) -> np.ndarray:
    """How often each pattern is used: weighted non-negative least squares against the histogram.

    Each update multiplies by the ratio of the two sides of the normal
    equations, so a count never gets negative; lengths weigh by their tokens,
    for short pieces fill gaps later anyway.
    """
    a, p, b, q = patterns.T
    weight = np.arange(len(histogram)) / (len(histogram) - 1)
    goal = weight * histogram
    usable = (histogram[a] >= p) & (histogram[b] >= q) if len(patterns) else np.zeros(0, dtype=bool)
    right = p * goal[a] + q * goal[b]
    x = np.where(usable, np.minimum(histogram[a] / p, np.where(q > 0, histogram[b] / np.maximum(q, 1), np.inf)), 0.0)
    for _ in range(rounds):
        model = weight * (np.bincount(a, p * x, len(histogram)) + np.bincount(b, q * x, len(histogram)))
        left = p * model[a] + q * model[b]
        x = np.divide(x * right, left, out=np.zeros_like(x), where=left > 0)
    return x


def best_fit(left: np.ndarray, tokens: int) -> list[Group]:
    """Best-fit decreasing of all pieces of a histogram, the pieces of one length at once.

    The next piece goes to the fullest sequence that takes it, and an equal
    piece goes there as well while it fits; so all sequences of one filling get
    the same number of pieces, but for the last of them.
    """
    open_: dict[int, list[Group]] = {}
    for length in range(tokens, 0, -1):
        n = int(left[length])
        while n:
            space = min((s for s in open_ if s >= length), default=tokens)
            times, content = open_[space].pop() if space in open_ else (n, ())
            if space in open_ and not open_[space]:
                del open_[space]
            each = min(space // length, n)
            used = min(times, n // each)
            if used < times and content:
                open_.setdefault(space, []).append((times - used, content))
            open_.setdefault(space - each * length, []).append((used, (*content, (length, each))))
            n -= used * each
    return [g for groups in open_.values() for g in groups]


def _one_plan(histogram: np.ndarray, tokens: int, pieces: int, rounds: int) -> list[Group]:
    left = histogram.astype(np.int64).copy()
    patterns = length_patterns(tokens, pieces)
    plan: list[Group] = []
    counts = np.rint(fitted_counts(left, patterns, rounds)).astype(np.int64)
    for k in np.lexsort((np.arange(len(counts)), -counts)):
        a, p, b, q = (int(v) for v in patterns[k])
        times = min(int(counts[k]), int(left[a]) // p, int(left[b]) // q if q else int(counts[k]))
        if times > 0:
            left[a] -= times * p
            left[b] -= times * q
            plan.append((times, ((a, p), (b, q)) if q else ((a, p),)))
    return plan + best_fit(left, tokens)


def packing_plan(histogram: np.ndarray, tokens: int = SEQUENCE_TOKENS, rounds: int = FIT_ROUNDS) -> list[Group]:
    """Equal sequences with their contents; every piece of the histogram (indexed by length, 0 to ``tokens``) is in one.

    Patterns of at most two, three and four pieces are fitted; the plan of fewest sequences counts.
    """
    plans = [_one_plan(histogram, tokens, k, rounds) for k in range(2, PATTERN_PIECES + 1)]
    return min(plans, key=lambda plan: sum(times for times, _ in plan))


class Slots:
    """Where the piece of a length and a rank lies: runs of ranks, found by binary search."""

    def __init__(self, plan: list[Group], tokens: int):
        rows, first, used = [], 0, np.zeros(tokens + 1, np.int64)
        for times, content in plan:
            offset = 0
            for length, each in content:
                rows.append((length, int(used[length]), first, each, offset))
                used[length] += times * each
                offset += length * each
            first += times
        rows.sort()
        self.length, self.rank, self.sequence, self.each, self.offset = np.array(rows, np.int64).reshape(-1, 5).T
        self.key = self._key(self.length, self.rank)
        self.sequences = first

    @staticmethod
    def _key(length: np.ndarray, rank: np.ndarray) -> np.ndarray:
        return (length << 45) | rank

    def find(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sequence, offset) of each piece."""
        at = np.searchsorted(self.key, self._key(length, rank), side="right") - 1
        k = rank - self.rank[at]
        return self.sequence[at] + k // self.each[at], self.offset[at] + k % self.each[at] * length


def document_pieces(docs: DataFrame, tokens: int = SEQUENCE_TOKENS, end_id: int = END_ID, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, salt): every document with its end id, cut where it is longer than ``tokens``."""
    rows = docs.select(F.col("doc_id").cast("long"), "text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt = TaskContext.get().partitionId() << 40
        for batch in batches:
            for part in slices(batch):
                ids, offsets = with_end(*encoder(vocabulary).encode(part.column(1)), end_id)
                size = np.diff(offsets)
                n = -(-size // tokens)
                doc = np.repeat(np.arange(len(size)), n)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
                start = piece * tokens
                length = np.minimum(size[doc] - start, tokens)
                raw, at = ids.astype("<u4").tobytes(), 4 * (offsets[doc] + start)
                crc = [zlib.crc32(raw[s:e]) for s, e in zip(at.tolist(), (at + 4 * length).tolist())]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length),
                     pa.array(crc, pa.int64()), pa.array(salt + np.arange(len(doc)))],
                    ["doc_id", "piece", "start", "length", "ids_crc32", "salt"])
                salt += len(doc)

    return rows.mapInArrow(cut, PIECES)


def pack_patterns(docs: DataFrame, tokens: int = SEQUENCE_TOKENS, end_id: int = END_ID, vocabulary: str = VOCABULARY) -> DataFrame:
    """One row per piece: its place in its document, and its sequence and offset there.

    A null or empty text is its end id alone.  Rows with equal or null ids are
    documents of their own.  An empty table has no sequences.  Other columns
    are not read.
    """
    pieces = settle(document_pieces(docs, tokens, end_id, vocabulary), "pieces")
    histogram = np.zeros(tokens + 1, np.int64)
    for row in pieces.groupBy("length").count().collect():  # at most ``tokens`` rows
        histogram[row["length"]] = row["count"]
    slots = Slots(packing_plan(histogram, tokens), tokens)
    # The salt parts pieces that are equal in all else, so that many copies of one row are spread as well.
    ranked = row_index(pieces, ["length"], ["doc_id", "piece", "ids_crc32", "salt"], "rank")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sequence, offset = slots.find(batch.column("length").to_numpy(), batch.column("rank").to_numpy())
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")], pa.array(sequence), pa.array(offset)],
                ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.mapInArrow(place, PLACED)
