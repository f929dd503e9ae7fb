"""Shared storage used to hold intermediate results of a job.

Results that are read more than once (fitted lookup tables, rows placed in a
global order) are written as Parquet under the checkpoint folder of the
session.  A written table survives the loss of executors, cuts the lineage,
and has a known size: Catalyst broadcasts it on its own when the files are
smaller than ``spark.sql.autoBroadcastJoinThreshold`` and shuffles it
otherwise, so no broadcast hint is needed for a table that grows with the data.
"""

from __future__ import annotations

import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Paths handed out in this process, for :func:`clear_scratch`.
_GIVEN: list[str] = []
#: The open :func:`scratch` blocks of a thread.
_OPEN = threading.local()


def shared_dir(spark: SparkSession) -> str:
    """Folder for intermediate tables: ``spark.checkpoint.dir``, or one below the warehouse where that is unset.

    Both are storage that all nodes see; no setting of the session is changed.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    current = named or spark.sparkContext.getCheckpointDir()
    return current or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_txloom"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nobody has used before."""
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _GIVEN.append(path)
    for block in getattr(_OPEN, "blocks", []):
        block.paths.append(path)
    return path


def _delete(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def clear_scratch(spark: SparkSession) -> int:
    """Delete the intermediate tables made so far by this process; results that still read them must be done."""
    done = 0
    while _GIVEN:
        done += _delete(spark, _GIVEN.pop())
    return done


class Scratch:
    """Intermediate tables of a block, and which of them outlive it."""

    def __init__(self):
        self.paths, self.kept = [], []

    def keep(self, df: DataFrame) -> DataFrame:
        """``df``, which must be what :func:`settle` returned; its files stay."""
        self.kept += [p for p in self.paths if any(f"/{p.rsplit('/', 1)[1]}/" in f for f in df.inputFiles())]
        return df


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Scratch]:
    """At its end, the tables that this thread wrote in the block and did not keep are deleted.

    Nothing that leaves the block may still read them.
    """
    block = Scratch()
    blocks = _OPEN.blocks = [*getattr(_OPEN, "blocks", []), block]
    try:
        yield block
    finally:
        _OPEN.blocks = [b for b in blocks if b is not block]
    gone = [p for p in block.paths if p not in block.kept]
    for path in gone:
        _delete(spark, path)
        if path in _GIVEN:
            _GIVEN.remove(path)
    if gone:
        release(spark)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of jobs that are done.

    It does so when the plans of those jobs are collected in the driver, which
    for a small heap of a long run may be late: this asks for it.
    """
    spark._jvm.System.gc()


def parallelism(spark: SparkSession) -> int:
    """Tasks over which rows that came in few large files are spread before heavy work per row."""
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def settle(df: DataFrame, name: str = "stage", partition_by: str | None = None, compression: str | None = None,
           rebalance: bool = True) -> DataFrame:
    """Write ``df`` once and return a reader of the written table.

    With ``partition_by`` every value gets files of its own, so that the size
    Catalyst sees for one value is its own size; the rebalance hint keeps the
    number of files low and still splits a value that holds most rows.
    ``rebalance=False`` saves its exchange where the values are few and share
    the rows evenly.  ``compression`` may name a codec for tables whose size
    counts.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    if partition_by:
        (df.hint("rebalance", partition_by) if rebalance else df).write.partitionBy(partition_by).parquet(path, compression=compression)
    else:
        df.write.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)
