"""Duplicate lines: one unit kept of all equal ones, the rest cut out of the texts.

A unit is a line (or, with ``paragraphs``, a block between blank lines).  It is
normalised to its words in lower case (A-Z), so spacing does not matter.  The
128-bit digests of all units are grouped; of equal units the one with the
smallest (doc_id, text hash, place) stays.  Units under ``min_words`` words are
never removed.  With ``passage`` words given, repeated runs of as many words
(:mod:`passages`) go as well, wherever their lines break.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .passages import joined_spans, packed_span, passage_spans, span_end, span_start
from .text import Words, mix, runs, slices, text_buffer

MIN_WORDS = 5
_SEEDS = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1B54A32D192ED03))


def text_units(column: pa.Array, paragraphs: bool = False) -> tuple[np.ndarray, ...]:
    """(document, start, end, words, digest high, digest low) of every unit with a word; bytes, end without the break."""
    data, offsets = text_buffer(column)
    inside = data != 10
    if paragraphs:
        # a break inside a paragraph is one that stands alone
        near = np.zeros(len(data), dtype=bool)
        near[1:] |= ~inside[:-1]
        near[:-1] |= ~inside[1:]
        inside = inside | ~near
    starts, ends = runs(inside, offsets)
    words = Words(data, offsets, lower=True)
    first, last = np.searchsorted(words.starts, starts), np.searchsorted(words.starts, ends)
    used = last > first
    starts, ends, first, last = starts[used], ends[used], first[used], last[used]
    count = last - first
    place = np.arange(len(words.hashes)) - np.repeat(first, count) if len(first) else np.zeros(0, np.int64)
    digests = []
    for seed in _SEEDS:
        if len(first) == 0:
            digests.append(np.zeros(0, np.int64))
            continue
        spread = mix(words.hashes ^ mix(place.astype(np.uint64) * seed + seed))
        digests.append(mix(np.add.reduceat(spread, first) + count.astype(np.uint64)).view(np.int64))
    doc = np.searchsorted(offsets, starts, side="right") - 1
    return doc, starts - offsets[doc], ends - offsets[doc], count, digests[0], digests[1]


def unit_table(docs: DataFrame, paragraphs: bool = False) -> DataFrame:
    """(doc_id, place, start, end, words, high, low): one row per unit; ``place`` is a hash of the whole text."""
    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("place"), "text").where("text is not null")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch):
                doc, *rest = text_units(piece.column(2), paragraphs)
                at = pa.array(doc)
                yield pa.RecordBatch.from_arrays(
                    [piece.column(0).take(at), piece.column(1).take(at), *(pa.array(x.astype(np.int64)) for x in rest)],
                    ["doc_id", "place", "start", "end", "words", "high", "low"])

    return rows.mapInArrow(cut, "doc_id long, place long, start long, end long, words long, high long, low long")


def unit_spans(docs: DataFrame, min_words: int = MIN_WORDS, paragraphs: bool = False) -> DataFrame:
    """(doc_id, place, start, end): the bytes of every unit that an earlier one equals.

    Groups are aggregated before anything is joined, so a line that most
    documents share is one row per task; its occurrences are joined back on
    the digest, which adaptive execution splits.
    """
    units = unit_table(docs, paragraphs).where(F.col("words") >= min_words)
    rank = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "place", "start")
    first = units.groupBy("high", "low").agg(F.min(rank).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    later = units.select("high", "low", "doc_id", "place", packed_span()).join(first.drop("n"), ["high", "low"]).where(
        ~(F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("place") == F.col("first.place"))
          & (span_start() == F.col("first.start"))))
    return later.select("doc_id", "place", span_start(), span_end())


def repeated_units(docs: DataFrame, min_words: int = MIN_WORDS, paragraphs: bool = False) -> DataFrame:
    """(doc_id, place, spans): the [start, end) bytes of every unit that an earlier one equals, per text."""
    return joined_spans(unit_spans(docs, min_words, paragraphs))


def _without(raw: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The text without the spans and, for each that begins a line, the line break behind it."""
    out, at = [], 0
    for start, end in spans:
        out.append(raw[at:start])
        at = end + (raw[end:end + 1] == b"\n" and raw[start - 1:start] in (b"", b"\n"))
    return b"".join([*out, raw[at:]])


def spans_name(columns: list[str]) -> str:
    """``removed``, or the first of ``removed_1``, ``removed_2``, ... that no column has."""
    taken, name, k = {c.lower() for c in columns}, "removed", 0
    while name in taken:
        k += 1
        name = f"removed_{k}"
    return name


def drop_repeated_units(docs: DataFrame, min_words: int = MIN_WORDS, paragraphs: bool = False,
                        passage: int | None = None) -> DataFrame:
    """``docs`` with the text that is left and ``removed``, the spans cut out of the original (bytes).

    Where ``docs`` has a column of that name, whatever its case, it stays and the
    spans come last under the name that :func:`spans_name` gives.  A null text stays null, a text of repeated units alone becomes empty.  Rows
    with equal id and text are one text here and keep the same units; rows with
    null ids rank last.  All other columns are carried along, whatever their names.
    """
    columns = docs.columns
    inner = [f"_c{i}" for i in range(len(columns))]
    lower = [c.lower() for c in columns]
    doc, text = inner[lower.index("doc_id")], inner[lower.index("text")]
    spans = unit_spans(docs.select("doc_id", "text"), min_words, paragraphs)
    if passage:
        spans = spans.unionByName(passage_spans(docs.select("doc_id", "text"), passage))
    spans = joined_spans(spans).select(
        F.col("doc_id").alias("_id"), F.col("place").alias("_place"), F.col("spans").alias("_spans"))
    renamed = docs.toDF(*inner)
    joined = renamed.join(spans, F.col(doc).cast("long").eqNullSafe(F.col("_id"))
                          & (F.xxhash64(text) == F.col("_place")), "left").select(*inner, "_spans")
    schema = joined.drop("_spans").schema.add("_removed", joined.schema["_spans"].dataType)
    where = inner.index(text)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [[(x["start"], x["end"]) for x in s or ()] for s in batch.column(len(inner)).to_pylist()]
            texts = batch.column(where)
            hit = [i for i, s in enumerate(spans) if s]
            if hit:
                new = texts.to_pylist()
                for i in hit:
                    new[i] = _without(new[i].encode(), spans[i]).decode()
                texts = pa.array(new, texts.type)
            removed = pa.array([[{"start": start, "end": end} for start, end in s] for s in spans], _SPANS)
            arrays = [*batch.columns[:where], texts, *batch.columns[where + 1:len(inner)], removed]
            yield pa.RecordBatch.from_arrays(arrays, [*inner, "_removed"])

    return joined.mapInArrow(cut, schema).toDF(*columns, spans_name(columns))


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
