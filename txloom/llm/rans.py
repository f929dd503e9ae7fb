"""Token files: ids of documents in order, coded by a range asymmetric numeral system.

The file format is a Parquet table with one row per *segment*, a run of whole
documents with about ``SEGMENT_TOKENS`` ids.  A segment is self-contained:

* one static frequency table, shared by all blocks of the segment;
* blocks of up to ``BLOCK_TOKENS`` ids, coded independently of each other, each
  by ``LANES`` interleaved coder states that write one stream of 16-bit words;
* checkpoints: per block its first id, its first word and the states of its
  lanes, so that any block can be decoded alone or all at once;
* a CRC-32 of the ids of each block, verified when it is decoded;
* the ids and the lengths of its documents.

``part`` is the place of the file in the order of doc_id and ``segment`` the
place inside it.  Segments close at the end of a document, so a task holds one
segment (or one longer document) at a time.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..session import scratch_path
from .text import slices
from .tokens import END_ID, VOCABULARY, encoder, with_end

SEGMENT_TOKENS = 2_000_000
BLOCK_TOKENS = 65_536
LANES = 256
#: Coder states lie in [2**31, 2**47): quotients of doubles are exact there.
_LOW, _WORD_BITS = 1 << 31, 16

SEGMENT_SCHEMA = ("part int, segment int, n_docs int, n_tokens long, scale_bits int, lanes int, steps int, "
                  "symbols binary, frequencies binary, block_words binary, states binary, block_crc32 binary, "
                  "payload binary, doc_ids binary, null_ids binary, doc_tokens binary")
DOCUMENT_SCHEMA = "part int, segment int, doc_id long, local_start long, n_tokens long, ids_crc32 long"


def frequency_table(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(symbols, frequencies that add up to 2**bits, bits); every symbol keeps at least 1."""
    counts = np.bincount(ids)
    symbols = np.flatnonzero(counts)
    counts = counts[symbols]
    bits = _WORD_BITS  # one word per step then always brings a state back into its range
    total = 1 << bits
    if len(symbols) > total:
        raise ValueError(f"a segment holds {len(symbols)} different ids, a table at most {total}: use smaller segments")
    share = np.maximum(1, np.floor(counts * (total / max(1, counts.sum())))).astype(np.int64)
    spare = total - int(share.sum())
    order = np.argsort(-share, kind="stable")
    while spare:
        if spare > 0:
            share[order[0]] += spare
            spare = 0
        else:
            rich = order[share[order] > 1][:-spare]
            cut = np.minimum(share[rich] - 1, max(1, -spare // max(1, len(rich))))
            share[rich] -= cut
            spare += int(cut.sum())
            if spare > 0:
                share[order[0]] += spare
                spare = 0
    return symbols.astype(np.uint32), share.astype(np.uint32), bits


def _layout(n: int, block_tokens: int) -> tuple[int, int]:
    """(blocks, steps of every block) for n ids."""
    blocks = max(1, -(-n // block_tokens))
    return blocks, -(-n // (blocks * LANES))


def encode_ids(ids: np.ndarray, block_tokens: int = BLOCK_TOKENS) -> dict:
    """Code one segment; the fields are those of ``SEGMENT_SCHEMA``."""
    n = len(ids)
    if n == 0:
        empty = np.zeros(0, np.uint32).tobytes()
        return dict(n_tokens=0, scale_bits=16, lanes=LANES, steps=0, symbols=empty, frequencies=empty, block_words=empty,
                    states=empty, block_crc32=empty, payload=empty)
    symbols, share, bits = frequency_table(ids)
    blocks, steps = _layout(n, block_tokens)
    width = blocks * LANES
    number = np.zeros(int(symbols[-1]) + 1, dtype=np.int32)
    number[symbols] = np.arange(len(symbols))
    filled = np.full(blocks * steps * LANES, np.argmax(share), dtype=np.int32)
    filled[:n] = number[ids]
    grid = filled.reshape(blocks, steps, LANES).transpose(1, 0, 2).reshape(steps, width)
    wide = share.astype(np.int64)
    start = np.cumsum(wide) - wide
    state = np.full(width, _LOW, dtype=np.int64)
    words, where = [None] * steps, [None] * steps
    for step in range(steps - 1, -1, -1):
        s = grid[step].astype(np.intp)
        f = wide.take(s)
        full = np.flatnonzero(state >= f << (31 - bits + _WORD_BITS))
        out = state.take(full)
        words[step] = out.astype(np.uint16)
        where[step] = full
        state[full] = out >> _WORD_BITS
        state += (state / f).astype(np.int64) * ((1 << bits) - f)
        state += start.take(s)
    words, where = np.concatenate(words), (np.concatenate(where) // LANES).astype(np.uint16)
    payload = words[np.argsort(where, kind="stable")]
    per_block = steps * LANES
    crc = [zlib.crc32(ids[b * per_block:(b + 1) * per_block].astype("<u4").tobytes()) for b in range(blocks)]
    return dict(n_tokens=n, scale_bits=bits, lanes=LANES, steps=steps, symbols=symbols.astype("<u4").tobytes(),
                frequencies=share.astype("<u4").tobytes(), block_words=np.bincount(where, minlength=blocks).astype("<u4").tobytes(),
                states=state.astype("<i8").tobytes(), block_crc32=np.array(crc, dtype="<u4").tobytes(),
                payload=payload.astype("<u2").tobytes())


def decode_ids(row: dict, first_block: int = 0, last_block: int | None = None) -> np.ndarray:
    """Ids of the blocks [first_block, last_block) of a segment, checked against their checksums."""
    n, steps, lanes, bits = row["n_tokens"], row["steps"], row["lanes"], row["scale_bits"]
    if n == 0:
        return np.zeros(0, np.uint32)
    symbols = np.frombuffer(row["symbols"], "<u4")
    share = np.frombuffer(row["frequencies"], "<u4").astype(np.int64)
    start = np.cumsum(share) - share
    slot_symbol = np.repeat(np.arange(len(symbols), dtype=np.int32), share)
    slot_share, slot_rest = share[slot_symbol], np.arange(1 << bits) - start[slot_symbol]
    block_words = np.frombuffer(row["block_words"], "<u4").astype(np.int64)
    last_block = len(block_words) if last_block is None else last_block
    chosen = slice(first_block, last_block)
    payload = np.frombuffer(row["payload"], "<u2").astype(np.int64)
    pointer = (np.cumsum(block_words) - block_words)[chosen].copy()
    blocks = len(pointer)
    state = np.frombuffer(row["states"], "<i8").reshape(-1, lanes)[chosen].ravel().copy()
    mask = (1 << bits) - 1
    grid = np.empty((steps, blocks * lanes), dtype=np.int32)
    for step in range(steps):
        slot = state & mask
        grid[step] = slot_symbol.take(slot)
        state >>= bits
        state *= slot_share.take(slot)
        state += slot_rest.take(slot)
        need = np.flatnonzero(state < _LOW)
        of = need // lanes
        taken = np.bincount(of, minlength=blocks)
        at = np.arange(len(need)) + np.repeat(pointer - (np.cumsum(taken) - taken), taken)
        state[need] = (state.take(need) << _WORD_BITS) | payload.take(at)
        pointer += taken
    if (state != _LOW).any():
        raise ValueError(f"segment {row.get('part')}/{row.get('segment')}: a lane does not end where its encoder began")
    ids = symbols[grid.reshape(steps, blocks, lanes).transpose(1, 0, 2).reshape(blocks, steps * lanes)]
    per_block = steps * lanes
    crc = np.frombuffer(row["block_crc32"], "<u4")
    out = []
    for k in range(blocks):
        b = first_block + k
        piece = ids[k, :max(0, min(per_block, n - b * per_block))]
        if zlib.crc32(piece.astype("<u4").tobytes()) != crc[b]:
            raise ValueError(f"segment {row.get('part')}/{row.get('segment')}: checksum of block {b} differs")
        out.append(piece)
    return np.concatenate(out) if out else np.zeros(0, np.uint32)


def _segment_row(part: int, segment: int, docs: list, nulls: list, lengths: list, ids: list) -> dict:
    coded = encode_ids(np.concatenate(ids) if ids else np.zeros(0, np.uint32))
    return dict(part=part, segment=segment, n_docs=sum(map(len, docs)), **coded,
                doc_ids=np.concatenate(docs).astype("<i8").tobytes(), null_ids=np.packbits(np.concatenate(nulls)).tobytes(),
                doc_tokens=np.concatenate(lengths).astype("<i8").tobytes())


def _arrow_schema():
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    return pa.schema([(name, kinds[kind]) for name, kind in (f.split() for f in SEGMENT_SCHEMA.split(", "))])


def write_token_files(docs: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text",
                      vocabulary: str = VOCABULARY, end_id: int = END_ID, segment_tokens: int = SEGMENT_TOKENS) -> None:
    """Encode every text and write the token files below ``path`` in ascending id order.

    A null text has the end id alone.  Null ids come first; rows with equal
    ids follow the order of their texts.  Other columns are not read.
    """
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    placed = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    schema = _arrow_schema()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, segment = TaskContext.get().partitionId(), 0
        docs, nulls, lengths, ids, held = [], [], [], [], 0
        for batch in batches:
            for piece in slices(batch):
                doc = piece.column(0)
                piece_ids, offsets = with_end(*encoder(vocabulary).encode(piece.column(1)), end_id)
                docs.append(doc.fill_null(0).to_numpy(zero_copy_only=False))
                nulls.append(doc.is_null().to_numpy(zero_copy_only=False))
                lengths.append(np.diff(offsets))
                ids.append(piece_ids)
                held += len(piece_ids)
                if held >= segment_tokens:
                    yield pa.RecordBatch.from_pylist([_segment_row(part, segment, docs, nulls, lengths, ids)], schema)
                    segment, docs, nulls, lengths, ids, held = segment + 1, [], [], [], [], 0
        if docs:
            yield pa.RecordBatch.from_pylist([_segment_row(part, segment, docs, nulls, lengths, ids)], schema)

    placed.mapInArrow(encode, SEGMENT_SCHEMA).write.option("compression", "uncompressed").parquet(path)


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SEGMENT_SCHEMA).parquet(path)


def _decoded_documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(batch.num_rows):
            row = batch.slice(k, 1).to_pylist()[0]
            ids = decode_ids(row)
            n = row["n_docs"]
            doc = np.frombuffer(row["doc_ids"], "<i8")
            null = np.unpackbits(np.frombuffer(row["null_ids"], np.uint8), count=n).astype(bool)
            lengths = np.frombuffer(row["doc_tokens"], "<i8")
            ends = np.cumsum(lengths)
            raw = ids.astype("<u4").tobytes()
            crc = [zlib.crc32(raw[4 * s:4 * e]) for s, e in zip((ends - lengths).tolist(), ends.tolist())]
            yield pa.RecordBatch.from_arrays([
                pa.array(np.full(n, row["part"], np.int32)), pa.array(np.full(n, row["segment"], np.int32)),
                pa.array(doc, mask=null), pa.array(ends - lengths), pa.array(lengths), pa.array(crc, pa.int64()),
            ], ["part", "segment", "doc_id", "local_start", "n_tokens", "ids_crc32"])


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the decoded files.

    ``start`` adds the ids of the segments before: totals per part first, then
    places inside a part, so no task orders more rows than there are parts or
    segments of one part.
    """
    segments = read_segments(spark, path)
    sizes = segments.select("part", "segment", "n_tokens")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy("part").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    parts = sizes.groupBy("part").agg(F.sum("n_tokens").alias("_n")).select(
        "part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_part_base"))
    base = sizes.withColumn("_base", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).join(parts, "part").select(
        "part", "segment", (F.col("_base") + F.col("_part_base")).alias("_base"))
    rows = segments.mapInArrow(_decoded_documents, DOCUMENT_SCHEMA)
    return rows.join(base, ["part", "segment"], "left").select(
        "doc_id", (F.col("_base") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32")


def token_files(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Write the token files of ``docs`` and read every document back from them."""
    spark = docs.sparkSession
    path = path or scratch_path(spark, "tokens")
    write_token_files(docs, path)
    return read_documents(spark, path)
