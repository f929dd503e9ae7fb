"""Segmentation into the pieces of a SentencePiece model by a shared-prefix Viterbi search.

A text is marked as the model does it: a mark in front, spaces become marks.
No piece has a mark behind another sign, so marked words are independent.  The
distinct new words of a slice are sorted, which walks their trie depth-first:
the forward scores of a word are kept on a stack, and the next word goes on
from the end of the prefix it shares.  Every word form is solved once and kept
in a bounded cache of the worker.

The best segmentation has the largest sum of piece scores; of equal sums the
one with the longer last piece wins, at every prefix.  Signs without a piece
become their byte pieces at the price of the worst score less ten.

A model of merges carries merge ranks as scores, which do not add up to
anything.  There, a piece may only follow one that it stays apart from: two
pieces may be neighbours if merging their joined text gives these two again.
Exactly one segmentation of a text has only such neighbours, the one that the
merges lead to, and each of its prefixes has the same property, so the search
along shared prefixes finds it and the ids are those of the model's library.
Whether two pieces may be neighbours is worked out once per pair.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .text import hash_runs, mix, slices, text_buffer
from .tokens import CACHE_SEGMENTS, SegmentCache

MODEL = "piece_bpe_32k.model"
MARK = "▁"
UNKNOWN_PENALTY = 10.0
LONG = 4096
CACHE_PAIRS = 1 << 20
_SPACE = 32
_FIRST = np.uint64(0x5851F42D4C957F2D)


class Pieces:
    """The vocabulary as a trie for encoding and as a byte table for decoding."""

    def __init__(self, pieces: list[tuple[str, float]], byte_ids: dict[int, int], skipped: set[int] = frozenset(),
                 merges: bool = False):
        self.trie: dict = {}
        self.byte_ids = byte_ids
        self.rank = {p: s for i, (p, s) in enumerate(pieces) if i not in skipped and i not in byte_ids.values()} if merges else None
        self.apart: dict[tuple[str, str], bool] = {}
        raw, scores = [], []
        by_id = {i: b for b, i in byte_ids.items()}
        for i, (piece, score) in enumerate(pieces):
            raw.append(bytes([by_id[i]]) if i in by_id else b"" if i in skipped else piece.replace(MARK, " ").encode())
            if i in by_id or i in skipped:
                continue
            scores.append(score)
            node = self.trie
            for sign in piece:
                node = node.setdefault(sign, {})
            node[None] = (i, score)
        self.unknown = min(scores, default=0.0) - UNKNOWN_PENALTY
        self.sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.bytes = np.frombuffer(b"".join(raw), np.uint8)

    @classmethod
    def load(cls, name: str = MODEL, merges: bool = True) -> "Pieces":
        """The pieces of a model file; ``merges`` says whether it is a model of merges (as the public one is) or of likelihoods."""
        import public_tokenizers
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(name))
        size = model.vocab_size()
        byte_ids = {int(model.id_to_piece(i)[3:5], 16): i for i in range(size) if model.is_byte(i)}
        skipped = {i for i in range(size) if model.is_control(i) or model.is_unknown(i) or model.is_unused(i)}
        return cls([(model.id_to_piece(i), model.get_score(i)) for i in range(size)], byte_ids, skipped, merges)

    def merged(self, text: str) -> list[str]:
        """The text's signs, merged pair by pair: the best-scoring piece first, of equal ones the leftmost."""
        parts = list(text)
        while len(parts) > 1:
            found = [(-self.rank[x + y], i) for i, (x, y) in enumerate(zip(parts, parts[1:])) if x + y in self.rank]
            if not found:
                break
            i = min(found)[1]
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def may_follow(self, before: str, piece: str) -> bool:
        """Whether merging leaves the two apart and whole; ``before`` is empty in front of a word."""
        known = self.apart.get((before, piece))
        if known is None:
            if len(self.apart) >= CACHE_PAIRS:
                self.apart.clear()
            known = self.apart[before, piece] = self.merged(before + piece) == [p for p in (before, piece) if p]
        return known

    def solve(self, words: list[str]) -> list[list[int]]:
        """Ids of each marked word; the words are distinct and sorted.

        A word of more than ``LONG`` signs keeps no scores for the next one,
        so its open pieces are held for one place only.
        """
        out = []
        score, back, ids, active = [0.0], [0], [None], [[(0, self.trie)]]
        before = ""
        for word in words:
            shared, most = 0, min(len(before), len(word))
            while shared < most and before[shared] == word[shared]:
                shared += 1
            del score[shared + 1:], back[shared + 1:], ids[shared + 1:], active[shared + 1:]
            long = len(word) > LONG
            for i in range(shared, len(word)):
                sign, alive = word[i], []
                best, origin, piece, single = None, i, None, False
                for start, node in active[-1]:  # earlier starts, so longer last pieces, come first
                    child = node.get(sign)
                    if child is None:
                        continue
                    alive.append((start, child))
                    end = child.get(None)
                    if end is None:
                        continue
                    single = single or start == i
                    total = score[start] + end[1]
                    if (best is None or total > best) and self._allowed(word, back, start, i + 1):
                        best, origin, piece = total, start, end[0]
                if best is None or (not single and self.rank is None and score[i] + self.unknown > best):
                    best, origin, piece = score[i] + self.unknown, i, None
                alive.append((i + 1, self.trie))
                score.append(best)
                back.append(origin)
                ids.append(piece)
                active.append(alive)
                if long:
                    active[-2] = None
            out.append(self._path(word, back, ids))
            before = word
            if long:
                del score[1:], back[1:], ids[1:], active[:]
                active.append([(0, self.trie)])
                before = ""
        return out

    def _allowed(self, word: str, back: list[int], start: int, end: int) -> bool:
        return self.rank is None or self.may_follow(word[back[start]:start], word[start:end])

    def _path(self, word: str, back: list[int], ids: list) -> list[int]:
        path, at = [], len(word)
        while at:
            if ids[at] is None:
                path.extend(self.byte_ids[b] for b in reversed(word[at - 1].encode()))
            else:
                path.append(ids[at])
            at = back[at]
        return path[::-1]


class PieceEncoder:
    """Encodes and decodes Arrow columns; one per worker (see :func:`piece_encoder`)."""

    def __init__(self, pieces: Pieces):
        self.pieces, self.cache = pieces, SegmentCache()

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, offsets of len + 1); an empty or null text has none."""
        data, offsets = text_buffer(column)
        n = len(data)
        if n == 0:
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        space = data == _SPACE
        cut = np.zeros(n + 1, dtype=bool)
        cut[1:n] = space[1:] & ~space[:-1]
        cut[offsets] = True
        starts = np.flatnonzero(cut[:n])
        ends = np.append(starts[1:], n)
        h = hash_runs(data, starts, ends)
        first = np.isin(starts, offsets)
        h[first] = mix(h[first] ^ _FIRST)
        h[h == 0] = 1
        if self.cache.size > CACHE_SEGMENTS:
            self.cache.clear()
        entry = self.cache.find(h)
        missing = np.flatnonzero(entry < 0)
        if len(missing):
            new, at = np.unique(h[missing], return_index=True)
            at = missing[at]
            raw = data.tobytes()
            words = [(MARK if f else "") + raw[s:e].decode().replace(" ", MARK)
                     for f, s, e in zip(first[at].tolist(), starts[at].tolist(), ends[at].tolist())]
            distinct = sorted(set(words))
            solved = dict(zip(distinct, self.pieces.solve(distinct)))
            self.cache.add(new, [solved[w] for w in words])
            entry[missing] = self.cache.find(h[missing])
        lengths = self.cache.lengths[entry]
        filled = np.cumsum(lengths)
        source = np.repeat(self.cache.at[entry] - (filled - lengths), lengths) + np.arange(int(lengths.sum()))
        return self.cache.ids[source], np.concatenate([[0], filled])[np.searchsorted(starts, offsets)]

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> list[bytes]:
        """UTF-8 of each text: pieces joined, marks as spaces, without the mark in front."""
        sizes = self.pieces.sizes[ids]
        filled = np.cumsum(sizes)
        source = np.repeat(self.pieces.starts[ids] - (filled - sizes), sizes) + np.arange(int(sizes.sum()))
        raw = self.pieces.bytes[source].tobytes()
        at = np.concatenate([[0], filled])[offsets].tolist()
        return [raw[s + 1:e] if e > s else b"" for s, e in zip(at, at[1:])]


_ENCODERS: dict[str, PieceEncoder] = {}


def piece_encoder(name: str = MODEL) -> PieceEncoder:
    if name not in _ENCODERS:
        _ENCODERS[name] = PieceEncoder(Pieces.load(name))
    return _ENCODERS[name]


def encode_pieces(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """(doc_id, ids) of every row; a null or empty text has no ids.  Other columns are not read."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch):
                ids, offsets = piece_encoder(model).encode(piece.column(1))
                lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([piece.column(0), lists], ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, ids array<int>")


def decode_pieces(encoded: DataFrame, model: str = MODEL) -> DataFrame:
    """(doc_id, text) of rows with ids; null ids give an empty text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            texts = []
            for k in range(batch.num_rows):
                ids = lists[k].values
                ids = np.zeros(0, np.int64) if ids is None else ids.to_numpy()
                texts += piece_encoder(model).decode(ids, np.array([0, len(ids)]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([t.decode("utf-8", "replace") for t in texts])],
                                             ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def piece_summary(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """(doc_id, n_pieces, ids_crc32, decoded_crc32, same_text): every text encoded and decoded again in one pass."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch):
                coder = piece_encoder(model)
                ids, offsets = coder.encode(piece.column(1))
                raw, at = ids.astype("<u4").tobytes(), offsets.tolist()
                data, text_at = text_buffer(piece.column(1))
                texts, text_at = data.tobytes(), text_at.tolist()
                decoded = coder.decode(ids, offsets)
                yield pa.RecordBatch.from_arrays([
                    piece.column(0), pa.array(np.diff(offsets)),
                    pa.array([zlib.crc32(raw[4 * s:4 * e]) for s, e in zip(at, at[1:])], pa.int64()),
                    pa.array([zlib.crc32(d) for d in decoded], pa.int64()),
                    pa.array([d == texts[s:e] for d, s, e in zip(decoded, text_at, text_at[1:])], pa.bool_()),
                ], ["doc_id", "n_pieces", "ids_crc32", "decoded_crc32", "same_text"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        run, "doc_id long, n_pieces long, ids_crc32 long, decoded_crc32 long, same_text boolean")
