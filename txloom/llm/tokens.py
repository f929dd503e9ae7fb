"""Token ids of whole texts with a public tokenizer, once per distinct word form.

The word-level BPE tokenizer drops white space and never joins letters, digits
and other signs, so the ids of a text are the ids of its segments in order.
Segments are cut with array operations, looked up by hash in a bounded cache of
the worker, and only unseen ones go through the library.  A word with bytes
whose treatment depends on their neighbours (apostrophes, ``<``, control
bytes, letters outside ASCII and Latin-1) goes through the library whole.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa

from .text import LOWER, WHITE, hash_runs, mapped, runs, text_buffer

VOCABULARY = "word_bpe_49k.json"
END_ID = 2
#: Segments a worker keeps; beyond that the cache starts anew.
CACHE_SEGMENTS = 2_000_000

_SPACE, _LETTER, _DIGIT, _SIGN, _WHOLE = range(5)
_CLASS = np.full(256, _WHOLE, dtype=np.uint8)
_CLASS[33:127] = _SIGN
_CLASS[list(WHITE)] = _SPACE
_CLASS[48:58] = _DIGIT
_CLASS[65:91] = _LETTER
_CLASS[97:123] = _LETTER
_CLASS[[ord("'"), ord("<")]] = _WHOLE
_LATIN = 0xC3  # first byte of U+00C0 - U+00FF, letters but for the two signs below
_LATIN_SIGNS = (0x97, 0xB7)


def _byte_signs() -> dict[int, str]:
    """The sign that byte-level vocabularies print for each byte: itself if it shows, else one after U+0100."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(256 + k) for k, b in enumerate(hidden)}


_BYTE_SIGNS = _byte_signs()


def _segments(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes with safe capitals lowered, starts, ends, kept whole) of the segments of all documents."""
    kind = mapped(data, _CLASS)
    text = mapped(data, LOWER)
    lead = np.flatnonzero(data == _LATIN)
    if len(lead):
        tail = data[lead + 1]
        letter = (tail != _LATIN_SIGNS[0]) & (tail != _LATIN_SIGNS[1])
        kind[lead[letter]] = _LETTER
        kind[lead[letter] + 1] = _LETTER
        capital = lead[letter & (tail < 0x9F)] + 1
        text[capital] += 0x20
    starts, ends = runs(kind != _SPACE, offsets)
    if len(starts) == 0:
        return text, starts, ends, np.zeros(0, dtype=bool)
    whole = np.flatnonzero(np.maximum.reduceat(kind, starts) == _WHOLE)
    if len(whole):
        lengths = ends[whole] - starts[whole]
        at = np.arange(int(lengths.sum())) + np.repeat(starts[whole] - (np.cumsum(lengths) - lengths), lengths)
        kind[at] = _WHOLE
        text[at] = data[at]
    cut = np.empty(len(kind), dtype=bool)
    cut[0] = True
    cut[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT)
    cut[starts] = True
    begin = np.flatnonzero(cut)
    end = np.append(begin[1:], len(kind))
    inside = kind[begin] != _SPACE
    return text, begin[inside], end[inside], kind[begin[inside]] == _WHOLE


class SegmentCache:
    """Ids of the segments seen so far: a hash table with open addressing, and ragged ids."""

    def __init__(self):
        self.clear()

    def clear(self):
        self.size = 0
        self.at, self.lengths = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)
        self._table(1 << 16)

    def _table(self, slots: int):
        self.mask = np.uint64(slots - 1)
        self.keys, self.entry = np.zeros(slots, np.uint64), np.zeros(slots, np.int32)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Number of each entry, -1 where there is none; no hash is 0."""
        slot = h & self.mask
        key = self.keys[slot]
        found = np.where(key == h, self.entry[slot], -1)
        seek = np.flatnonzero((key != h) & (key != 0))
        slot = slot[seek]
        while len(seek):
            slot = (slot + np.uint64(1)) & self.mask
            key = self.keys[slot]
            hit = key == h[seek]
            found[seek[hit]] = self.entry[slot[hit]]
            on = ~hit & (key != 0)
            seek, slot = seek[on], slot[on]
        return found

    def _place(self, h: np.ndarray, number: np.ndarray):
        slot = h & self.mask
        while len(h):
            free = self.keys[slot] == 0
            self.keys[slot[free]] = h[free]
            won = free & (self.keys[slot] == h)
            self.entry[slot[won]] = number[won]
            h, number, slot = h[~won], number[~won], (slot[~won] + np.uint64(1)) & self.mask

    def add(self, h: np.ndarray, ids: list[list[int]]):
        """New entries; the hashes are distinct and not in the table."""
        lengths = np.fromiter(map(len, ids), np.int64, len(ids))
        at = len(self.ids) + np.cumsum(lengths) - lengths
        self.ids = np.concatenate([self.ids, np.fromiter((i for x in ids for i in x), np.uint32, int(lengths.sum()))])
        self.at, self.lengths = np.concatenate([self.at, at]), np.concatenate([self.lengths, lengths])
        number = np.arange(self.size, self.size + len(h), dtype=np.int32)
        self.size += len(h)
        if 3 * self.size > len(self.keys):
            keys, entry = self.keys, self.entry
            self._table(4 * len(keys))
            old = keys != 0
            self._place(keys[old], entry[old])
        self._place(h, number)


class Encoder:
    """Encodes Arrow columns of texts; one per worker and vocabulary (see :func:`encoder`)."""

    def __init__(self, vocabulary: str = VOCABULARY):
        import public_tokenizers
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(public_tokenizers.path(vocabulary))
        self.cache = SegmentCache()

    def _unseen(self, words: list[bytes], whole: np.ndarray) -> list[list[int]]:
        """Ids of new segments: plain ones by the model alone, others through every step of the library."""
        out: list = [None] * len(words)
        model = self.tokenizer.model
        for i in np.flatnonzero(~whole):
            out[i] = [t.id for t in model.tokenize(words[i].decode("latin-1").translate(_BYTE_SIGNS))]
        rest = np.flatnonzero(whole)
        texts = [words[i].decode("utf-8") for i in rest]
        for i, e in zip(rest, self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)):
            out[i] = e.ids
        return out

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, offsets of len + 1)."""
        data, offsets = text_buffer(column)
        text, starts, ends, whole = _segments(data, offsets)
        if len(starts) == 0:
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        h = hash_runs(text, starts, ends)
        h[h == 0] = 1
        if self.cache.size > CACHE_SEGMENTS:
            self.cache.clear()
        entry = self.cache.find(h)
        missing = np.flatnonzero(entry < 0)
        if len(missing):
            new, first = np.unique(h[missing], return_index=True)
            first = missing[first]
            raw = text.tobytes()
            words = [raw[s:e] for s, e in zip(starts[first].tolist(), ends[first].tolist())]
            self.cache.add(new, self._unseen(words, whole[first]))
            entry[missing] = self.cache.find(h[missing])
        lengths = self.cache.lengths[entry]
        filled = np.cumsum(lengths)
        source = np.repeat(self.cache.at[entry] - (filled - lengths), lengths)
        source += np.arange(len(source))
        per_segment = np.concatenate([[0], filled])
        return self.cache.ids[source], per_segment[np.searchsorted(starts, offsets)]


_ENCODERS: dict[str, Encoder] = {}


def encoder(vocabulary: str = VOCABULARY) -> Encoder:
    """The encoder of this Python worker."""
    if vocabulary not in _ENCODERS:
        _ENCODERS[vocabulary] = Encoder(vocabulary)
    return _ENCODERS[vocabulary]


def with_end(ids: np.ndarray, offsets: np.ndarray, end_id: int = END_ID) -> tuple[np.ndarray, np.ndarray]:
    """The same documents, each followed by ``end_id``."""
    n = len(offsets) - 1
    out_offsets = offsets + np.arange(n + 1)
    out = np.empty(len(ids) + n, dtype=np.uint32)
    last = np.zeros(len(out), dtype=bool)
    last[out_offsets[1:] - 1] = True
    out[last] = end_id
    out[~last] = ids
    return out, out_offsets
