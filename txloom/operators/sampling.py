"""Seeded down-sampling of one class."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..schema import KEY, LABEL
from .ordered import row_index

BUCKETS = 65536


def seeded_hash(key: str = KEY, seed: int = 0) -> Column:
    """A number below 2**40 that orders keys at random for a seed."""
    return F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(1 << 40))


def portable_hash(key: str = KEY, seed: int = 0) -> Column:
    """Plain integer arithmetic in place of a hash, for results that other engines must repeat."""
    return F.pmod(F.pmod(F.col(key), F.lit(10007)) * 7919 + seed * 104729, F.lit(10007))


def smallest(df: DataFrame, mark: Column, limit: int, key: str = KEY, span: int = 1 << 40) -> DataFrame:
    """The ``limit`` rows with the smallest (mark, key), without sorting the table.

    The marks are counted in at most 65,536 equal intervals; rows below the
    interval in which the limit falls stay, and only that one is ranked, in
    chunks that spread over the tasks.
    """
    width = max(1, span // BUCKETS)
    marked = df.withColumns({"_mark": mark, "_bucket": F.floor(mark / width)})
    counts = marked.groupBy("_bucket").agg(F.count(F.lit(1)).alias("n")).orderBy("_bucket").collect()
    seen = 0
    for row in counts:
        if seen + row["n"] > limit:
            edge, room = row["_bucket"], limit - seen
            break
        seen += row["n"]
    else:
        return df
    below = marked.where(F.col("_bucket") < edge)
    ranked = row_index(marked.where(F.col("_bucket") == edge), [], ["_mark", key], "_rn")
    return below.unionByName(ranked.where(F.col("_rn") < room).drop("_rn")).drop("_mark", "_bucket")


def downsample_negatives(df: DataFrame, fraction: float = 0.2, label: str = LABEL, key: str = KEY, seed: int = 0,
                         portable: bool = False) -> DataFrame:
    """All positives and exactly round(fraction * n) of the n negatives."""
    negatives = df.where(F.col(label) == 0)
    limit = round(fraction * negatives.count())
    mark = portable_hash(key, seed) if portable else seeded_hash(key, seed)
    kept = smallest(negatives, mark, limit, key, 10007 if portable else 1 << 40)
    return df.where(F.col(label) == 1).unionByName(kept)


def sample_negatives(df: DataFrame, fraction: float = 0.2, label: str = LABEL, seed: int = 0) -> DataFrame:
    """All positives and about ``fraction`` of the negatives, in one pass."""
    return df.sampleBy(label, {1: 1.0, 0: fraction}, seed)
