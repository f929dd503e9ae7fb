"""Near-duplicate documents: banded MinHash with sequential Bayesian verification.

1. Every text becomes its set of five-word shingles, a digest of the set and a
   signature of ``HASHES`` minima.  Texts with equal sets form one class.
2. Classes meet in the buckets of ``BANDS`` bands.  The smallest class of a
   bucket is compared with all others; links that this finds are joined to
   components.  Where the rest of a bucket still lies in several components,
   its classes are compared across components in pairs of bounded blocks; a
   pair of blocks keeps joining components and gives only the links that do.
3. A comparison reads the signatures in batches.  After each batch the
   posterior of the similarity (uniform prior) decides: if it gives less than
   ``miss`` to a similarity at or above the threshold, the pair is dropped.
4. Survivors are verified exactly on the full shingle sets.

A link of similarity 0.85 shares no band with probability (1 - 0.85**4)**24 =
2e-8 (3e-6 at the 0.80 of the pipeline stage), and is dropped by a batch with
about ``miss``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from ..session import settle
from .components import connected_components
from .text import Words, mix, slices, text_buffer

SHINGLE = 5
BANDS, ROWS = 24, 4
HASHES = BANDS * ROWS
BATCH = 16
MISS = 1e-6
#: Classes of one bucket that a task compares with each other at once.
BLOCK = 512

_SEEDS = mix(np.arange(1, 2 * HASHES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_FACTOR = (_SEEDS[:HASHES] >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
_SHIFT = (_SEEDS[HASHES:] >> np.uint64(32)).astype(np.uint32)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def shingle_sets(column: pa.Array, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct shingle hashes of every text, how many each has)."""
    words = Words(*text_buffer(column), lower=True)
    h, _, per_doc = words.windows(k, whole_if_shorter=True)
    ends = np.cumsum(per_doc)
    for s, e in zip((ends - per_doc).tolist(), ends.tolist()):
        h[s:e].sort()
    keep = np.ones(len(h), dtype=bool)
    keep[1:] = h[1:] != h[:-1]
    keep[(ends - per_doc)[per_doc > 0]] = True
    doc = np.repeat(np.arange(len(per_doc)), per_doc)
    return h[keep], np.bincount(doc[keep], minlength=len(per_doc)).astype(np.int64)


def signatures(sets: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """HASHES minima of each non-empty set, one row per such set."""
    sizes = sizes[sizes > 0]
    out = np.empty((len(sizes), HASHES), dtype=np.uint32)
    if len(sizes):
        starts = np.cumsum(sizes) - sizes
        x = (sets >> np.uint64(32)).astype(np.uint32) ^ sets.astype(np.uint32)
        work = np.empty_like(x)
        for k in range(HASHES):
            np.multiply(x, _FACTOR[k], out=work)
            work += _SHIFT[k]
            out[:, k] = np.minimum.reduceat(work, starts)
    return out


def band_hashes(signature: np.ndarray) -> np.ndarray:
    """One 64-bit value per band, different bands never meant to meet."""
    h = np.broadcast_to(np.arange(BANDS, dtype=np.uint64) * _STEP, (len(signature), BANDS)).copy()
    rows = signature.reshape(-1, BANDS, ROWS).astype(np.uint64)
    for r in range(ROWS):
        h = mix(h * _STEP + rows[:, :, r] + np.uint64(1))
    return h.view(np.int64)


@lru_cache
def least_matches(threshold: float, miss: float) -> tuple[int, ...]:
    """After each batch, the matches below which P(similarity >= threshold) < miss.

    With a uniform prior and m matches of n the posterior is Beta(m+1, n-m+1),
    whose upper tail is a sum of binomial terms.
    """
    out = []
    for n in range(BATCH, HASHES + 1, BATCH):
        tail, m = 0.0, 0
        while m <= n:
            tail += math.comb(n + 1, m) * threshold ** m * (1 - threshold) ** (n + 1 - m)
            if tail >= miss:
                break
            m += 1
        out.append(m)
    return tuple(out)


def posterior_keeps(a: np.ndarray, b: np.ndarray, threshold: float, miss: float) -> np.ndarray:
    """Which pairs of signature rows survive all batches; later batches read only survivors."""
    alive, matches = np.arange(len(a)), np.zeros(len(a), dtype=np.int64)
    for k, least in enumerate(least_matches(threshold, miss)):
        part = slice(k * BATCH, (k + 1) * BATCH)
        matches[alive] += (a[alive, part] == b[alive, part]).sum(axis=1)
        alive = alive[matches[alive] >= least]
    keep = np.zeros(len(a), dtype=bool)
    keep[alive] = True
    return keep


def _matrix(column: pa.Array) -> np.ndarray:
    return text_buffer(column)[0].view(np.uint32).reshape(-1, HASHES)


def document_sets(docs: DataFrame, k: int) -> DataFrame:
    """(doc_id, place, n_shingles, digest, signature, bands) of every row; ``place`` is a hash of the text."""
    rows = docs.select(F.col("doc_id").cast("long"), F.md5(F.coalesce("text", F.lit(""))).alias("place"), "text")

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch):
                sets, sizes = shingle_sets(piece.column(2), k)
                sign = signatures(sets, sizes)
                bands = band_hashes(sign)
                ends = np.cumsum(sizes)
                raw = sets.tobytes()
                digest = [xxhash.xxh3_128_digest(raw[8 * s:8 * e]) if e > s else None
                          for s, e in zip((ends - sizes).tolist(), ends.tolist())]
                row = np.cumsum(sizes > 0) - 1
                has = (sizes > 0).tolist()
                yield pa.RecordBatch.from_arrays([
                    piece.column(0), piece.column(1), pa.array(sizes), pa.array(digest, pa.binary()),
                    pa.array([sign[r].tobytes() if h else None for r, h in zip(row, has)], pa.binary()),
                    pa.array([bands[r] if h else None for r, h in zip(row, has)], pa.list_(pa.int64())),
                ], ["doc_id", "place", "n_shingles", "digest", "signature", "bands"])

    return rows.mapInArrow(describe, "doc_id long, place string, n_shingles long, digest binary, signature binary, "
                                     "bands array<long>")


def _bayes(pairs: DataFrame, classes: DataFrame, threshold: float, miss: float) -> DataFrame:
    """Pairs (a, b) of classes whose signatures do not rule out a link."""
    sign = classes.select("digest", "signature")
    both = pairs.join(sign.select(F.col("digest").alias("a"), F.col("signature").alias("sa")), "a").join(
        sign.select(F.col("digest").alias("b"), F.col("signature").alias("sb")), "b").select("a", "b", "sa", "sb")

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = posterior_keeps(_matrix(batch.column(2)), _matrix(batch.column(3)), threshold, miss)
            yield batch.select([0, 1]).filter(pa.array(keep))

    return both.mapInArrow(test, "a binary, b binary")


def _texts(nodes: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """(digest, text) of one row of each class in ``nodes``."""
    keyed = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("rep_id"),
                        F.md5(F.coalesce("text", F.lit(""))).alias("rep_place"), "text")
    wanted = classes.join(nodes, "digest", "left_semi").select("digest", "rep_id", "rep_place")
    return keyed.join(wanted, ["rep_id", "rep_place"]).select("digest", "text")


def linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """100 * |x & y| >= percent * |x | y| for sorted distinct arrays."""
    common = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum()) if len(y) else 0
    return 100 * common >= percent * (len(x) + len(y) - common)


def _exact(pairs: DataFrame, classes: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """Pairs that are linked on their full sets."""
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("digest")).distinct()
    texts = settle(_texts(nodes, classes, docs), "texts")
    both = pairs.join(texts.select(F.col("digest").alias("a"), F.col("text").alias("ta")), "a").join(
        texts.select(F.col("digest").alias("b"), F.col("text").alias("tb")), "b").select("a", "b", "ta", "tb")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, "ta"):
                left, nl = shingle_sets(piece.column(2), k)
                right, nr = shingle_sets(piece.column(3), k)
                el, er = np.cumsum(nl), np.cumsum(nr)
                keep = [linked(left[el[i] - nl[i]:el[i]], right[er[i] - nr[i]:er[i]], percent) for i in range(piece.num_rows)]
                yield piece.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(verify, "a binary, b binary").distinct()


def cross_links(sign: np.ndarray, sets: list[np.ndarray], component: np.ndarray, one: np.ndarray, two: np.ndarray,
                band: int, percent: int, miss: float) -> list[tuple[int, int]]:
    """Verified links between the members ``one`` and ``two`` of a bucket that join different components.

    Pairs that also share an earlier band are left to its bucket, and pairs
    that links found here have already joined are not compared.
    """
    now = component.copy()
    bands = sign.reshape(len(sign), BANDS, ROWS)
    out = []
    for r in one.tolist():
        rest = two[now[two] != now[r]]
        rest = rest[posterior_keeps(np.broadcast_to(sign[r], (len(rest), HASHES)), sign[rest], percent / 100, miss)]
        if band:
            rest = rest[~(bands[rest, :band] == bands[r, :band]).all(axis=2).any(axis=1)]
        for g in rest.tolist():
            if now[g] != now[r] and linked(sets[r], sets[g], percent):
                now[now == now[g]] = now[r]
                out.append((r, g))
    return out


def _across(members: DataFrame, classes: DataFrame, docs: DataFrame, k: int, percent: int, miss: float) -> DataFrame:
    """Links inside buckets that join different components, found block by block.

    ``members``: (bucket, band, digest, component, size).  The members of a
    bucket are dealt into blocks by hash; each pair of blocks is one small
    group, which gives at most one link per member.
    """
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    dealt = members.withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("digest", "bucket"), "blocks").cast("int"))
    copies = dealt.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)"))).select(
        "bucket", "band", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "digest", "component")
    texts = _texts(members.select("digest").distinct(), classes, docs)
    described = settle(texts.join(classes.select("digest", "signature"), "digest"), "described")
    rows = copies.join(described, "digest")

    def compare(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        sign = np.frombuffer(b"".join(frame["signature"]), np.uint32).reshape(-1, HASHES)
        flat, sizes = shingle_sets(pa.array(frame["text"], pa.string()), k)
        ends = np.cumsum(sizes)
        sets = [flat[e - n:e] for e, n in zip(ends.tolist(), sizes.tolist())]
        component = pd.factorize(frame["component"])[0]
        own, digest = frame["own"].to_numpy(), frame["digest"].to_numpy()
        one, two = np.flatnonzero(own == key[2]), np.flatnonzero(own == key[3])
        found = cross_links(sign, sets, component, one, two, int(key[1]), percent, miss)
        return pd.DataFrame([(min(digest[x], digest[y]), max(digest[x], digest[y])) for x, y in found], columns=["a", "b"])

    return rows.groupBy("bucket", "band", "i", "j").applyInPandas(compare, "a binary, b binary").distinct()


_NO_ID = -(1 << 63)


def near_duplicates(docs: DataFrame, percent: int = 85, k: int = SHINGLE, miss: float = MISS) -> DataFrame:
    """(doc_id, place, n_shingles, component_id, kept) of every row; ``place`` is a hash of its text.

    A null, empty or blank text has no shingle and is linked with nothing.
    Rows that share an id keep their own row; a null id is never the smallest
    of a component, and a component of null ids alone has a null
    ``component_id`` and keeps all its rows.  Other columns are not read.
    """
    docs = docs.select("doc_id", "text")
    threshold = percent / 100
    rows = settle(document_sets(docs, k), "sets")
    rep = F.min(F.struct(F.coalesce("doc_id", F.lit(_NO_ID)).alias("id"), "place"))
    classes = settle(rows.where("digest is not null").groupBy("digest").agg(
        rep.alias("rep"), F.first("signature").alias("signature"), F.first("bands").alias("bands")).select(
        "digest", F.col("rep.id").alias("rep_id"), F.col("rep.place").alias("rep_place"), "signature", "bands"), "classes")

    members = classes.select("digest", F.posexplode("bands").alias("band", "bucket"))
    buckets = members.groupBy("bucket").agg(F.min("digest").alias("pivot"), F.count(F.lit(1)).alias("size")).where("size > 1")
    shared = settle(members.join(buckets, "bucket").where("digest != pivot"), "buckets")
    first = settle(shared.select(F.col("pivot").alias("a"), F.col("digest").alias("b")).distinct(), "pairs")
    likely = settle(_bayes(first, classes, threshold, miss), "likely")
    links = settle(_exact(likely, classes, docs, k, percent), "links")
    parts = connected_components(links)

    labelled = shared.where("size > 2").join(parts.withColumnRenamed("node", "digest"), "digest", "left").select(
        "bucket", "band", "digest", "size", F.coalesce("component", "digest").alias("component"))
    labelled = settle(labelled, "labelled")
    mixed = labelled.groupBy("bucket").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x != y")
    open_rows = labelled.join(mixed.select("bucket"), "bucket", "left_semi")
    if not mixed.isEmpty():
        links = links.unionByName(settle(_across(open_rows, classes, docs, k, percent, miss), "across"))
        parts = connected_components(links)

    of_class = rows.where("digest is not null").groupBy("digest").agg(F.min("doc_id").alias("lowest"))
    named = of_class.join(parts.withColumnRenamed("node", "digest"), "digest", "left").withColumn(
        "component", F.coalesce("component", "digest"))
    lowest = named.groupBy("component").agg(F.min("lowest").alias("component_id"))
    label = named.select("digest", "component").join(lowest, "component").select("digest", "component_id")
    out = rows.select("doc_id", "place", "n_shingles", "digest").join(label, "digest", "left")
    component = F.when(F.col("digest").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "place", "n_shingles", component.alias("component_id"),
                      F.col("doc_id").eqNullSafe(component).alias("kept"))


def one_of_each_group(docs: DataFrame, percent: int = 85) -> DataFrame:
    """The rows of ``docs`` that near-duplicate removal keeps, with all their columns.

    Rows that repeat both the id and the text of a kept one go, too, but for
    null ids and texts without words, which are linked with nothing.
    """
    columns, lower = docs.columns, [c.lower() for c in docs.columns]
    inner = [f"_c{i}" for i in range(len(columns))]
    renamed = docs.toDF(*inner)
    doc, text = F.col(inner[lower.index("doc_id")]), F.col(inner[lower.index("text")])
    found = near_duplicates(renamed.select(doc.alias("doc_id"), text.alias("text")), percent)
    kept = found.where("kept").select(F.col("doc_id").alias("_id"), F.col("place").alias("_place"),
                                      ((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()).alias("_one")).distinct()
    rows = renamed.withColumns({"_key": doc.cast("long"), "_hash": F.md5(F.coalesce(text, F.lit("")))}).join(
        kept, F.col("_key").eqNullSafe(F.col("_id")) & (F.col("_hash") == F.col("_place")))
    inside = Window.partitionBy("_id", "_place").orderBy(F.lit(0))
    numbered = rows.withColumn("_n", F.row_number().over(inside))
    return numbered.where("_n = 1 or not _one").select(*inner).toDF(*columns)
