"""Document fingerprints: threshold-scaled sketches of word shingles.

A sketch keeps every shingle hash below a fixed fraction of the hash range, so
its size grows with the text, the union of two sketches is the sketch of the
union, and the containment of a short text in a long one is estimated without
bias.  A non-empty text none of whose hashes is below the limit keeps its
smallest one, so that no such text has an empty sketch; a merge drops it again
as soon as a hash below the limit is there.

As text, a sketch is its sorted 48-bit hashes in base64, eight signs each.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .minhash import shingle_sets
from .text import slices

SHINGLE = 5
HASH_BITS = 48
#: Share of all shingles that a sketch keeps.
FRACTION = 1 / 4
LIMIT = int((1 << HASH_BITS) * FRACTION)


def canonical(hashes: np.ndarray) -> np.ndarray:
    """Distinct sorted hashes below the limit, or the smallest one if there is none."""
    hashes = np.unique(hashes)
    below = hashes[:np.searchsorted(hashes, LIMIT)]
    return below if len(below) else hashes[:1]


def sketches(texts: pa.Array, k: int = SHINGLE) -> list[np.ndarray]:
    sets, sizes = shingle_sets(texts, k)
    sets = sets >> np.uint64(64 - HASH_BITS)
    ends = np.cumsum(sizes)
    return [canonical(sets[s:e]) for s, e in zip((ends - sizes).tolist(), ends.tolist())]


def to_text(sketch: np.ndarray) -> str:
    return base64.b64encode(sketch.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 2:].tobytes()).decode()


def from_text(fingerprint: str) -> np.ndarray:
    six = np.frombuffer(base64.b64decode(fingerprint), np.uint8).reshape(-1, 6)
    wide = np.zeros((len(six), 8), np.uint8)
    wide[:, 2:] = six
    return wide.view(">u8").ravel().astype(np.uint64)


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sketch of the union of both shingle sets."""
    return canonical(np.concatenate([a, b]))


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated Jaccard similarity; equal sketches give 1, one empty sketch gives 0."""
    common = len(np.intersect1d(a, b, assume_unique=True))
    union = len(a) + len(b) - common
    return common / union if union else 1.0


def containment(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated share of the shingles of ``a`` that ``b`` has; an empty ``a`` is contained."""
    return len(np.intersect1d(a, b, assume_unique=True)) / len(a) if len(a) else 1.0


def fingerprints(docs: DataFrame, k: int = SHINGLE) -> DataFrame:
    """(doc_id, fingerprint) of every row; a null or blank text has an empty one."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch):
                yield pa.RecordBatch.from_arrays(
                    [piece.column(0), pa.array([to_text(s) for s in sketches(piece.column(1), k)])],
                    ["doc_id", "fingerprint"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, fingerprint string")


def _edited(text: str, following: str) -> str:
    k = len(text) // 3
    return text[:len(text) - k] + following[:k]


#: Stretches of the descending order per shuffle partition.
STRETCHES = 4
EDIT_SCHEMA = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
               "near_edited double, near_next double")


def edit_test(docs: DataFrame, k: int = SHINGLE) -> DataFrame:
    """Fingerprints of every text, of its edited text, and of the next one in descending id order.

    The last third of a text is replaced by as many leading code points of the
    next text (after the last: the first).  Null texts are empty, null ids come
    last, equal ids follow the order of their texts.

    Texts are dealt into stretches of the order, and each stretch also gets the
    first text of the one after it, so a stretch is worked on alone.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    stretches = max(1, STRETCHES * int(spark.conf.get("spark.sql.shuffle.partitions")))
    # The borders only place rows, the result does not depend on them.
    share = [i / stretches for i in range(1, stretches)]
    borders = rows.agg(F.percentile_approx("doc_id", share or [0.5], 10000).alias("b")).first().b or []
    borders = sorted(set(borders), reverse=True)
    ascending = np.array(borders[::-1], dtype=np.int64)

    # stretch 0 holds the largest ids; a null id is in the last one
    @F.pandas_udf("int")
    def stretch(ids: pd.Series) -> pd.Series:
        known = ids.notna()
        out = np.full(len(ids), len(ascending), dtype=np.int32)
        out[known] = len(ascending) - np.searchsorted(ascending, ids[known].to_numpy(np.int64), side="right")
        return pd.Series(out)

    placed = rows.withColumn("stretch", stretch("doc_id"))
    rank = F.struct(F.col("doc_id").isNotNull().alias("has"), "doc_id")
    # first row of each stretch: largest id, then smallest text
    top = placed.groupBy("stretch").agg(F.max(rank).alias("top"))
    heads = placed.join(F.broadcast(top), "stretch").where(F.col("doc_id").eqNullSafe(F.col("top.doc_id"))).groupBy(
        "stretch", "doc_id").agg(F.min("text").alias("text"))
    order = Window.orderBy("stretch")
    before = heads.select("stretch", "text", F.lag("stretch").over(order).alias("earlier"),
                          F.max("stretch").over(Window.partitionBy()).alias("last"))
    ahead = before.select(F.lit(None).cast("long").alias("doc_id"), "text",
                          F.coalesce("earlier", "last").alias("stretch"), F.lit(True).alias("ahead"))
    dealt = placed.withColumn("ahead", F.lit(False)).unionByName(ahead).repartition("stretch").sortWithinPartitions(
        "stretch", "ahead", F.col("doc_id").desc_nulls_last(), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            for piece in slices(batch.select(["doc_id", "text", "ahead"])):
                doc, texts, ahead = (c.to_pylist() for c in piece.columns)
                marks = sketches(piece.column(1), k)
                current = ([held] if held else []) + list(zip(doc, texts, ahead, marks))
                held = current[-1]
                pairs = [(a, b) for a, b in zip(current, current[1:]) if not a[2]]
                if not pairs:
                    continue
                edited = [_edited(a[1], b[1]) for a, b in pairs]
                after = sketches(pa.array(edited, pa.large_string()), k)
                yield pa.RecordBatch.from_arrays([
                    pa.array([a[0] for a, _ in pairs], pa.int64()),
                    pa.array([len(a[1]) for a, _ in pairs], pa.int64()),
                    pa.array([hashlib.sha256(e.encode()).hexdigest() for e in edited]),
                    pa.array([to_text(a[3]) for a, _ in pairs]),
                    pa.array([to_text(s) for s in after]),
                    pa.array([likeness(a[3], s) for (a, _), s in zip(pairs, after)], pa.float64()),
                    pa.array([likeness(a[3], b[3]) for a, b in pairs], pa.float64()),
                ], ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    return dealt.mapInArrow(run, EDIT_SCHEMA)
