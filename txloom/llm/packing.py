"""Packing of documents into training sequences by vector bin packing.

An example is a vector (tokens, one segment, loss-bearing tokens) and a
sequence has a limit for each.  The open sequence takes, among the examples
that a task holds, the one whose vector has the largest dot product with the
capacity that is left (both as shares of the limits); when none fits, the
largest one is cut so that the sequence becomes full.  Whole multiples of the
sequence length are cut off first.  What is left at the end of a task goes into
sequences of a power of two, which need no padding.

Tasks pack the rows of their own partition, so nothing is shuffled and no key
is hot; a task holds at most ``HELD`` examples of less than one sequence each.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .text import slices
from .tokens import END_ID, VOCABULARY, encoder, with_end

SEQUENCE_TOKENS = 4096
MAX_SEGMENTS = 512
HELD = 1024
PIECE_SCHEMA = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, "
                "offset long, loss_tokens long")


class Packer:
    """Packs examples that arrive one by one; ``take`` hands over the rows of closed sequences."""

    def __init__(self, first_sequence: int, tokens: int = SEQUENCE_TOKENS, segments: int = MAX_SEGMENTS,
                 loss: int | None = None, held: int = HELD):
        loss = tokens if loss is None else loss
        if min(tokens, segments, loss) < 1:
            raise ValueError("every limit must be at least 1")
        self.limits = np.array([tokens, segments, loss], dtype=np.int64)
        self.next_sequence, self.held = first_sequence, held
        self.rows: list[tuple] = []
        self.left, self.open = self.limits.copy(), []
        self.items: list[tuple] = []           # (doc_id, start, doc_tokens, ids, marks of loss)
        self.size = np.zeros(0, np.int64)      # tokens of the held items
        self.loss = np.zeros(0, np.int64)      # loss-bearing tokens of the held items

    def add(self, doc, ids: np.ndarray, marks: np.ndarray | None = None):
        """One document; ``marks`` says which ids bear loss (all, if None)."""
        marks = np.ones(len(ids), dtype=bool) if marks is None else marks.astype(bool)
        whole, start, total = int(self.limits[0]), 0, len(ids)
        while start < total:
            n = self._prefix(marks[start:], self.limits)
            item = (doc, start, total, ids[start:start + n], marks[start:start + n])
            if n == whole:
                self._emit([item])
            else:
                self._hold(item)
            start += n
        while len(self.items) > self.held:
            self._step()

    def _hold(self, item: tuple):
        self.items.append(item)
        self.size, self.loss = np.append(self.size, len(item[3])), np.append(self.loss, int(item[4].sum()))

    @staticmethod
    def _prefix(marks: np.ndarray, left: np.ndarray) -> int:
        """Length of the longest prefix within the tokens and loss-bearing tokens that are left."""
        n = int(min(len(marks), left[0]))
        return int(np.searchsorted(np.cumsum(marks[:n]), left[2], side="right"))

    def _emit(self, items: list[tuple]):
        """One closed sequence."""
        offset = 0
        for doc, start, total, ids, marks in items:
            self.rows.append((doc, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), total, self.next_sequence,
                              offset, int(marks.sum())))
            offset += len(ids)
        self.next_sequence += bool(items)

    def _close(self):
        self._emit(self.open)
        self.left, self.open = self.limits.copy(), []

    def _put(self, k: int, n: int):
        """The first n tokens of held item k into the open sequence."""
        doc, start, total, ids, marks = self.items[k]
        cost = int(marks[:n].sum())
        self.open.append((doc, start, total, ids[:n], marks[:n]))
        self.left -= (n, 1, cost)
        if n < len(ids):
            self.items[k] = (doc, start + n, total, ids[n:], marks[n:])
            self.size[k] -= n
            self.loss[k] -= cost
            return
        last = self.items.pop()
        if k < len(self.items):
            self.items[k], self.size[k], self.loss[k] = last, self.size[-1], self.loss[-1]
        self.size, self.loss = self.size[:-1], self.loss[:-1]

    def _step(self):
        """Put one held item, or a part of one, into the open sequence."""
        if self.left.min() == 0:
            self._close()
        fit = (self.size <= self.left[0]) & (self.loss <= self.left[2])
        if fit.any():
            weight = self.left / (self.limits * self.limits)
            k = int(np.argmax(np.where(fit, weight[0] * self.size + weight[1] + weight[2] * self.loss, -1.0)))
            self._put(k, int(self.size[k]))
            return
        k = int(np.argmax(self.size))
        n = self._prefix(self.items[k][4], self.left)
        if n:
            self._put(k, n)
        else:
            self._close()

    def finish(self):
        """Pack all that is held; less than one sequence at the end is cut into powers of two."""
        whole = int(self.limits[0])
        while self.items and self.size.sum() + whole - self.left[0] >= whole:
            self._step()
        if whole - self.left[0] == whole:
            self._close()
        for item in self.open:
            self._hold(item)
        self.left, self.open = self.limits.copy(), []
        while self.items:
            rest = int(self.size.sum())
            self.left[0] = min(whole, 1 << (rest.bit_length() - 1))
            goal = len(self.rows)
            while self.items and not (len(self.rows) > goal):
                if self.left[0] == 0:
                    self._close()
                    break
                self._step()
        self._close()

    def take(self) -> list[tuple]:
        rows, self.rows = self.rows, []
        return rows


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    names = [f.split()[0] for f in PIECE_SCHEMA.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names)


def pack_documents(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", tokens: int = SEQUENCE_TOKENS,
                   segments: int = MAX_SEGMENTS, loss: int | None = None, vocabulary: str = VOCABULARY,
                   end_id: int = END_ID) -> DataFrame:
    """One row per piece of a document in a sequence.

    A null or empty text is its end id alone.  Every id bears loss but the
    first of its document, which nothing precedes; ``loss`` limits them per
    sequence.  Rows with equal or null ids are documents of their own; other
    columns are not read.
    """
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(TaskContext.get().partitionId() << 41, tokens, segments, loss)
        for batch in batches:
            for piece in slices(batch):
                ids, offsets = with_end(*encoder(vocabulary).encode(piece.column(1)), end_id)
                for k, doc in enumerate(piece.column(0).to_pylist()):
                    own = ids[offsets[k]:offsets[k + 1]]
                    packer.add(doc, own, np.arange(len(own)) > 0)
                if packer.rows:
                    yield _batch(packer.take())
        packer.finish()
        if packer.rows:
            yield _batch(packer.take())

    return rows.mapInArrow(pack, PIECE_SCHEMA)
