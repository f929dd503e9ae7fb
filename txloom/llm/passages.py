"""Repeated passages: runs of words that an earlier text has, wherever lines break.

A passage is a window of ``PASSAGE`` words in lower case (A-Z), so spacing and
wrapping do not matter.  Of equal windows the one with the smallest (doc_id,
text hash, place) stays; all bytes under the others are found, but for those
of the first window itself where a copy overlaps it.

Not every window is a row.  The smallest hash among the ``ANCHOR``-word runs
of a window is its anchor, and neighbouring windows with one anchor form a
stretch.  Equal stretches are grouped as a whole; single windows are compared
only among the first ones of different stretches with one anchor, and where
windows of a stretch repeat inside it or overlap their first ones.  Equal
windows have equal anchors and each has its first one in the first one of a
stretch, so no repeated window is missed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import settle
from .text import Words, mix, slices, text_buffer

PASSAGE = 51
ANCHOR = 16
_STEP = np.uint64(0x9E3779B97F4A7C15)
_SEEDS = (np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB))


def run_hashes(h: np.ndarray, width: int, seed: np.uint64) -> np.ndarray:
    """Hash of every run of ``width`` values, by doubling."""
    h, size = mix(h ^ seed), 1
    while size < width:
        step = min(size, width - size)
        h = mix(h[:-step] * _STEP + h[step:]) if len(h) > step else h[:0]
        size += step
    return h


def least_of(x: np.ndarray, width: int) -> np.ndarray:
    """Smallest of every run of ``width`` values, by doubling."""
    size = 1
    while size < width:
        step = min(size, width - size)
        x = np.minimum(x[:-step], x[step:]) if len(x) > step else x[:0]
        size += step
    return x


def windows(words: Words, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, first word, document) of every window that lies in one document."""
    anchor = least_of(run_hashes(words.hashes, ANCHOR, _SEEDS[0]), size - ANCHOR + 1)
    doc = np.repeat(np.arange(len(words.counts)), words.counts)[:len(anchor)]
    at = np.flatnonzero(np.arange(len(anchor)) + size <= words.first[1:][doc])
    return anchor[at], at, doc[at]


def packed_span() -> Column:
    """``start`` and ``end`` as one number: rows that are shuffled by digest take less room than with both."""
    return F.shiftleft("start", 32).bitwiseOR(F.col("end")).alias("span")


def span_start() -> Column:
    return F.shiftright("span", 32).alias("start")


def span_end() -> Column:
    return F.col("span").bitwiseAND(F.lit(0xFFFFFFFF)).alias("end")


def _text_rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("place"), "text").where("text is not null")


def _digests(words: Words, at: np.ndarray, size: int) -> list[np.ndarray]:
    return [run_hashes(words.hashes, size, seed)[at] for seed in _SEEDS]


def stretch_table(docs: DataFrame, size: int = PASSAGE) -> DataFrame:
    """One row per stretch: anchor and digest (128 bits in all), place in the text in bytes and words, windows, whether windows repeat in it.

    ``until`` is the end of the first window.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch):
                words = Words(*text_buffer(piece.column(2)), lower=True)
                anchor, at, doc = windows(words, size)
                if len(at) == 0:
                    continue
                new = np.ones(len(at), dtype=bool)
                new[1:] = (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])
                begin, own = np.flatnonzero(new), np.cumsum(new) - 1
                n = np.diff(np.append(begin, len(at)))
                inside = (np.arange(len(at)) - begin[own]).astype(np.uint64)
                digest, seed = run_hashes(words.hashes, size, _SEEDS[1])[at], _SEEDS[1]
                whole = mix(np.add.reduceat(mix(digest ^ mix(inside * seed + seed)), begin) + n.astype(np.uint64))
                keys = mix(digest ^ mix(own.astype(np.uint64) + np.uint64(1)))
                order = np.argsort(keys)
                again = np.zeros(len(begin), dtype=bool)
                again[own[order[1:]][keys[order[1:]] == keys[order[:-1]]]] = True
                at, doc = at[begin], doc[begin]
                base, row = words.offsets[doc], pa.array(doc)
                numbers = [anchor[begin].view(np.int64), whole.view(np.int64), words.starts[at] - base,
                           words.ends[at + n + size - 2] - base, words.ends[at + size - 1] - base,
                           ((at - words.first[doc]) << 32) | n]
                yield pa.RecordBatch.from_arrays(
                    [piece.column(0).take(row), piece.column(1).take(row), *(pa.array(x.astype(np.int64)) for x in numbers),
                     pa.array(again)],
                    ["doc_id", "place", "anchor", "whole", "start", "end", "until", "at", "again"])

    return _text_rows(docs).mapInArrow(cut, "doc_id long, place long, anchor long, whole long, start long, end long, "
                                            "until long, at long, again boolean")


def window_table(rows: DataFrame, size: int = PASSAGE) -> DataFrame:
    """(doc_id, place, start, end, high, low) of the windows in the stretches ``ats`` of each row; bytes."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch):
                words = Words(*text_buffer(piece.column(2)), lower=True)
                lists = piece.column(3)
                owner = np.repeat(np.arange(piece.num_rows), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
                packed = lists.flatten().to_numpy(zero_copy_only=False)
                n = packed & 0xFFFFFFFF
                first = words.first[owner] + (packed >> 32)
                at = np.arange(int(n.sum())) + np.repeat(first - (np.cumsum(n) - n), n)
                doc = np.repeat(owner, n)
                base, row = words.offsets[doc], pa.array(doc)
                yield pa.RecordBatch.from_arrays(
                    [piece.column(0).take(row), piece.column(1).take(row), pa.array(words.starts[at] - base),
                     pa.array(words.ends[at + size - 1] - base), *(pa.array(d.view(np.int64)) for d in _digests(words, at, size))],
                    ["doc_id", "place", "start", "end", "high", "low"])

    return rows.select("doc_id", "place", "text", "ats").mapInArrow(
        cut, "doc_id long, place long, start long, end long, high long, low long")


def joined_spans(spans: DataFrame) -> DataFrame:
    """(doc_id, place, spans): the distinct [start, end) of each text in order, overlapping ones as one.

    One exchange by text; equal rows collapse and overlapping ones join in the
    order of the text, so many thousand spans of one text cost a sort and not
    a comparison of all pairs.
    """
    rows = spans.repartition("doc_id", "place").select("doc_id", "place", "start", "end").distinct()
    order = Window.partitionBy("doc_id", "place").orderBy("start", "end")
    reached = rows.withColumn("_reach", F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1)))
    new = F.when(F.col("start") < F.col("_reach"), 0).otherwise(1)
    numbered = reached.withColumn("_run", F.sum(new).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    one = numbered.groupBy("doc_id", "place", "_run").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    return one.groupBy("doc_id", "place").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("spans"))


def repeated_passages(docs: DataFrame, size: int = PASSAGE) -> DataFrame:
    """(doc_id, place, spans): the [start, end) bytes under windows that an earlier one equals, per text."""
    return joined_spans(passage_spans(docs, size))


def passage_spans(docs: DataFrame, size: int = PASSAGE) -> DataFrame:
    """(doc_id, place, start, end): the bytes under windows that an earlier one equals; spans may overlap and repeat.

    As for lines, groups are aggregated before anything is joined.
    """
    if size < ANCHOR:
        raise ValueError(f"a passage has {ANCHOR} words or more")
    same = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("place") == F.col("first.place"))
    itself = same & (F.col("start") == F.col("first.start"))
    # Of one text the place in words orders stretches as the one in bytes does, in fewer bytes.
    word, first_word = (F.shiftright(c, 32) for c in ("at", "first.at"))
    no_id = F.col("doc_id").isNull().alias("no_id")

    # Cut twice rather than written: the rows of all stretches take more room than the texts.
    stretches = stretch_table(docs, size)
    rank = F.struct(no_id, "doc_id", "place", "at")
    grouped = stretches.groupBy("anchor", "whole").agg(
        F.min(rank).alias("first"), F.max("again").alias("again"), F.count(F.lit(1)).alias("n"))
    # Classes of one stretch are joined by nothing: their digest need not be written.
    classes = settle(grouped.withColumn("whole", F.expr("case when n > 1 then whole end")), "classes", compression="zstd")
    later = settle(stretches.select("doc_id", "place", "anchor", "whole", packed_span(), "at").join(
        classes.where("n > 1").select("anchor", "whole", "first"), ["anchor", "whole"]).where(
        ~(same & (word == first_word))).select(
        "doc_id", "place", span_start(), span_end(), "at", (same & (word < first_word + size)).alias("close")), "later")

    several = classes.groupBy("anchor").agg(F.count(F.lit(1)).alias("k"), F.max("again").alias("some")).where(
        "k > 1 or some").select("anchor")
    opened = classes.join(several, "anchor").select("first.doc_id", "first.place", "first.at").unionByName(
        later.where("close").select("doc_id", "place", "at"))
    lists = opened.groupBy("doc_id", "place").agg(F.collect_set("at").alias("ats")).select(
        F.col("doc_id").alias("_id"), F.col("place").alias("_place"), "ats")
    texts = _text_rows(docs)
    held = texts.join(lists, texts["doc_id"].eqNullSafe(F.col("_id")) & (texts["place"] == F.col("_place")))
    found = settle(window_table(held, size), "windows", compression="zstd")
    first = found.groupBy("high", "low").agg(
        F.min(F.struct(no_id, "doc_id", "place", "start", "end")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    single = found.join(first.drop("n"), ["high", "low"]).where(~itself).select(
        "doc_id", "place", F.when(same, F.greatest("start", F.col("first.end"))).otherwise(F.col("start")).alias("start"), "end")
    return single.unionByName(later.where("not close").select("doc_id", "place", "start", "end"))
