"""Whole texts as byte arrays: words, lines and their hashes without a loop per document.

Arrow hands a task the texts of a batch as one buffer of UTF-8 bytes.  The
helpers here cut that buffer into documents and words with array operations;
the same code serves a text of one byte and one of many megabytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

#: Bytes of text that a task works on at once (one longer document is taken alone).
SLICE_BYTES = 1_000_000
#: Fixed by the word contract: words are runs of bytes outside \x20 and \x09-\x0D.
WHITE = b" \t\n\x0b\x0c\r"

_IS_WORD = np.ones(256, dtype=np.uint8)
_IS_WORD[list(WHITE)] = 0
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_MIX = np.uint64(0xFF51AFD7ED558CCD)
_MIX2 = np.uint64(0xC4CEB9FE1A85EC53)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread every bit of 64-bit values over all bits (a bijection)."""
    h = h ^ (h >> np.uint64(33))
    h = h * _MIX
    h ^= h >> np.uint64(29)
    h *= _MIX2
    h ^= h >> np.uint64(32)
    return h


def mapped(data: np.ndarray, table: np.ndarray) -> np.ndarray:
    """``table[data]`` for a table of 256 bytes."""
    return np.frombuffer(bytearray(data.tobytes().translate(table.tobytes())), dtype=np.uint8)


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts, offsets of len + 1); a null text is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)
    return (raw[offsets[0]:offsets[-1]], offsets - offsets[0]) if len(column) else (raw[:0], np.zeros(1, np.int64))


def slices(batch: pa.RecordBatch, text: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of about ``limit`` bytes of text."""
    if batch.num_rows == 0:
        return
    _, offsets = text_buffer(batch.column(batch.schema.get_field_index(text)))
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1)
        yield batch.slice(at, end - at)
        at = end


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of True that do not cross a document border."""
    n = len(inside)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    edge = np.zeros(n + 1, dtype=bool)
    edge[offsets] = True
    before = np.empty(n, dtype=bool)
    before[0] = False
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.empty(n, dtype=bool)
    after[-1] = False
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends


#: Runs longer than this are hashed one by one.
LONG_RUN = 256
_KEEP = np.array([(1 << (8 * k)) - 1 for k in range(9)], dtype=np.uint64)


def hash_runs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte run, read eight bytes at a time."""
    lengths = ends - starts
    h = mix(lengths.astype(np.uint64) * _STEP)
    if len(starts) == 0:
        return h
    padded = np.concatenate([data, np.zeros(8, dtype=np.uint8)])
    eight = np.lib.stride_tricks.as_strided(padded.view(np.uint8)[:8].view(np.uint64), (len(data) + 1,), (1,))
    long = lengths > LONG_RUN
    todo = np.flatnonzero(~long) if long.any() else None
    at, left = (starts, lengths) if todo is None else (starts[todo], lengths[todo])
    part = h if todo is None else h[todo]
    alive = None
    while len(at):
        word = eight[at] & _KEEP[np.minimum(left, 8)]
        fresh = mix((part if alive is None else part[alive]) * _STEP + word)
        if alive is None:
            part = fresh
        else:
            part[alive] = fresh
        more = np.flatnonzero(left > 8)
        at, left = at[more] + 8, left[more] - 8
        alive = more if alive is None else alive[more]
    if todo is None:
        return part
    h[todo] = part
    for i in np.flatnonzero(long):
        h[i] = xxhash.xxh3_64_intdigest(data[starts[i]:ends[i]].tobytes())
    return h


class Words:
    """The words of the documents of one slice."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False):
        self.data, self.offsets = (mapped(data, LOWER) if lower else data), offsets
        self.starts, self.ends = runs(mapped(data, _IS_WORD).view(bool), offsets)
        #: Number of the first word of each document, with the total at the end.
        self.first = np.searchsorted(self.starts, offsets)
        self.counts = np.diff(self.first)
        self.hashes = hash_runs(self.data, self.starts, self.ends)

    def windows(self, k: int, whole_if_shorter: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(hash of each window of k words, first word of each window, windows per document).

        With ``whole_if_shorter`` a document with 1 to k-1 words has its whole
        sequence as its only window, hashed with its length.
        """
        n = len(self.hashes)
        per_doc = np.maximum(self.counts - (k - 1), 0)
        at = np.arange(int(per_doc.sum())) + np.repeat(self.first[:-1] - (np.cumsum(per_doc) - per_doc), per_doc)
        h = np.zeros(len(at), dtype=np.uint64)
        for i in range(k):
            h = mix(h * _STEP + self.hashes[at + i])
        if whole_if_shorter and n:
            short = np.flatnonzero((self.counts > 0) & (self.counts < k))
            if len(short):
                extra = np.array([self._whole(d) for d in short], dtype=np.uint64)
                doc = np.concatenate([np.repeat(np.arange(len(per_doc)), per_doc), short])
                order = np.argsort(doc, kind="stable")
                h = np.concatenate([h, extra])[order]
                at = np.concatenate([at, self.first[short]])[order]
                per_doc = per_doc.copy()
                per_doc[short] = 1
        return h, at, per_doc

    def _whole(self, d: int) -> np.uint64:
        h = np.zeros(1, dtype=np.uint64)
        for x in self.hashes[self.first[d]:self.first[d + 1]]:
            h = mix(h * _STEP + x)
        return mix(h + self.counts[d].astype(np.uint64))[0]


def distinct_by_document(h: np.ndarray, per_doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values of each document, and how many each has."""
    doc = np.repeat(np.arange(len(per_doc)), per_doc)
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    keep = np.ones(len(h), dtype=bool)
    keep[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return h[keep], np.bincount(doc[keep], minlength=len(per_doc)).astype(np.int64)


def sums_by_document(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of ``values`` inside each [offsets[i], offsets[i + 1])."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[offsets[1:]] - total[offsets[:-1]]
