"""Token counts as rollups maintained by signed changes.

Totals by source, language and tokenizer version are never recomputed: a batch
of changes is reduced to signed sums per group and committed under its batch
id, and the totals are the sum over all batches.  An insert adds a count, a
delete takes it back, a revision takes back the old count and adds the new one.

A batch is a folder of its own, written by Spark's committer, which leaves its
success mark last.  Committing a batch id again is a no-op once the mark is
there, and overwrites what a failed attempt left behind, so batches may be
retried and arrive in any order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .text import slices
from .tokens import VOCABULARY, encoder

GROUP = ["source", "lang", "tokenizer"]
SUMS = ["n_docs", "n_tokens", "n_chars"]
_SCHEMA = ", ".join([*(f"{g} string" for g in GROUP), *(f"{s} long" for s in SUMS)])


def token_counts(docs: DataFrame, vocabulary: str = VOCABULARY, version: str = "word_bpe_49k/1") -> DataFrame:
    """(doc_id, place, source, lang, tokenizer, n_tokens, n_chars) of every row; a null text counts nothing.

    ``place`` is a hash of the text.  Null sources and languages are groups of their own.
    """
    rows = docs.select(F.col("doc_id").cast("long"), F.md5(F.coalesce("text", F.lit(""))).alias("place"),
                       F.col("source").cast("string"), F.col("lang").cast("string"), F.lit(version).alias("tokenizer"),
                       F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n_chars"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch):
                _, offsets = encoder(vocabulary).encode(piece.column(6))
                yield pa.RecordBatch.from_arrays([*piece.columns[:6], pa.array(np.diff(offsets))],
                                                 [*piece.schema.names[:6], "n_tokens"])

    return rows.mapInArrow(run, "doc_id long, place string, source string, lang string, tokenizer string, n_chars long, "
                                "n_tokens long")


def signed(counts: DataFrame, sign: int) -> DataFrame:
    """Counts of documents as changes: ``sign`` +1 inserts them, -1 deletes them."""
    return counts.select(*GROUP, F.lit(sign).cast("long").alias("n_docs"),
                         *[(F.col(c) * sign).alias(c) for c in ("n_tokens", "n_chars")])


def revised(old: DataFrame, new: DataFrame) -> DataFrame:
    """Changes that replace old counts by new ones, whatever group either is in."""
    return signed(old, -1).unionByName(signed(new, 1))


def _folder(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def is_committed(spark: SparkSession, path: str, batch: str) -> bool:
    files, place = _folder(spark, f"{path}/batch={batch}/_SUCCESS")
    return files.exists(place)


def commit(changes: DataFrame, path: str, batch: str) -> bool:
    """Add one batch to the rollups below ``path``; False if it was there already.

    Groups are summed on the map side first, so a source that holds most rows is
    a few partial sums.
    """
    if not batch or set(batch) & set("/=: "):
        raise ValueError(f"not a batch id: {batch!r}")
    spark = changes.sparkSession
    if is_committed(spark, path, batch):
        return False
    sums = changes.groupBy(*GROUP).agg(*[F.sum(s).cast("long").alias(s) for s in SUMS])
    sums.write.mode("overwrite").parquet(f"{path}/batch={batch}")
    return True


def batches(spark: SparkSession, path: str) -> list[str]:
    files, place = _folder(spark, path)
    if not files.exists(place):
        return []
    names = sorted(s.getPath().getName() for s in files.listStatus(place) if s.isDirectory())
    ids = [n.removeprefix("batch=") for n in names if n.startswith("batch=")]
    return [b for b in ids if is_committed(spark, path, b)]


def totals(spark: SparkSession, path: str) -> DataFrame:
    """Totals of all committed batches; groups that changes have emptied are left out."""
    known = batches(spark, path)
    if not known:
        return spark.createDataFrame([], _SCHEMA)
    rows = spark.read.schema(_SCHEMA).parquet(*[f"{path}/batch={b}" for b in known])
    summed = rows.groupBy(*GROUP).agg(*[F.sum(s).cast("long").alias(s) for s in SUMS])
    return summed.where(" or ".join(f"{s} != 0" for s in SUMS))
