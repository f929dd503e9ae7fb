"""Prediction sinks and the history of search trials."""

from __future__ import annotations

import threading
import time
from urllib.parse import quote

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..schema import KEY, LABEL
from .tables import exists

TRIALS = "study string, trial int, params map<string,double>, score double"


def submission(template: DataFrame, predictions: DataFrame, key: str = KEY) -> DataFrame:
    """Template keys with their prediction, 0 where there is none."""
    found = predictions.select(key, F.col("prediction").alias("_p"))
    return template.select(key).join(found, key, "left").select(
        key, F.coalesce("_p", F.lit(0.0)).alias(LABEL))


def write_submission(df: DataFrame, folder: str, auc: float, now: int | None = None) -> str:
    """Write ``<unix time>_submission_<auc>.csv`` (a folder of part files) and return its path."""
    path = f"{folder.rstrip('/')}/{now or int(time.time())}_submission_{round(auc, 5)}.csv"
    df.write.option("header", True).csv(path)
    return path


def write_oof(oof: DataFrame, path: str, mode: str = "append") -> None:
    """Out-of-fold predictions, one folder per model and fold.

    The rebalance hint gathers a fold's rows before the write, and still cuts
    a large fold into several files.
    """
    oof.hint("rebalance", "model", "fold").write.mode(mode).partitionBy("model", "fold").parquet(path)


def _trial_path(path: str, study: str, trial: int) -> str:
    if not study:
        raise ValueError("a study needs a name")
    return f"{path.rstrip('/')}/study={quote(study, safe='')}/trial={trial}"


def append_trials(spark: SparkSession, path: str, rows) -> None:
    """Put (study, trial, params, score) rows into the history.

    Every trial is a folder of its own, so runs that write at the same time do
    not meet, and a trial that is put twice is there once.
    """
    for study, trial, params, score in rows:
        row = spark.createDataFrame([(params, score)], "params map<string,double>, score double")
        row.coalesce(1).write.mode("overwrite").parquet(_trial_path(path, study, trial))


def read_trials(spark: SparkSession, path: str, study: str | None = None) -> DataFrame:
    if not exists(spark, path):
        return spark.createDataFrame([], TRIALS)
    history = spark.read.schema(TRIALS).parquet(path).select("study", "trial", "params", "score")
    return history if study is None else history.where(F.col("study") == study)


def next_trial(history: DataFrame) -> int:
    last = history.agg(F.max("trial")).first()[0]
    return 0 if last is None else last + 1


def _claims(spark: SparkSession, path: str, study: str):
    """(file system, folder) of the claimed numbers; readers of the history pass over folders with an underscore."""
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/_claims/{quote(study, safe='')}")
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def claimed_trials(spark: SparkSession, path: str, study: str) -> list[int]:
    files, place = _claims(spark, path, study)
    return sorted(int(f.getPath().getName()) for f in files.listStatus(place)) if files.exists(place) else []


_CLAIMING = threading.Lock()


def _created(files, place) -> bool:
    """Whether this call made the file; False where it was there."""
    try:
        files.create(place, False).close()
    except Py4JJavaError as error:
        if "FileAlreadyExists" in error.java_exception.getClass().getName():
            return False
        raise
    return True


def claim_trial(spark: SparkSession, path: str, study: str) -> int:
    """A trial number that no other run has or gets: the one that creates its file owns it.

    Between processes that holds where the store refuses to create a file
    twice in one step, as HDFS does; threads of a process take turns.  Numbers
    of the history count as taken.
    """
    files, place = _claims(spark, path, study)
    with _CLAIMING:
        number = max([next_trial(read_trials(spark, path, study)) - 1, *claimed_trials(spark, path, study)]) + 1
        while not _created(files, spark._jvm.org.apache.hadoop.fs.Path(place, str(number))):
            number += 1
    return number
