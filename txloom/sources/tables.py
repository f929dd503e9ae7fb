"""Reading of keyed tables and reuse of intermediate ones."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from ..operators.impute import nan_to_null
from ..operators.lookup import join_identity
from ..schema import SPLIT, SUBMISSION_SCHEMA, identity_schema, transaction_schema


def read_csv(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """CSV with a header under a declared schema; no inference pass over the data."""
    return spark.read.schema(schema).option("header", True).option("enforceSchema", False).csv(path)


def read_table(spark: SparkSession, path: str, schema: StructType | None = None) -> DataFrame:
    """Parquet or, with a schema, CSV; NaN becomes null."""
    df = read_csv(spark, path, schema) if path.endswith(".csv") else spark.read.parquet(path)
    return nan_to_null(df)


def preview(df: DataFrame, n: int = 5) -> DataFrame:
    """Some n rows, read from as few partitions as hold them."""
    return df.limit(n)


def head(df: DataFrame, n: int = 5, key: str | None = None) -> DataFrame:
    """The first n rows by key (a distributed top-n, not a sort of the table)."""
    return df.orderBy(key).limit(n) if key else df.limit(n)


def union_splits(train: DataFrame, test: DataFrame) -> DataFrame:
    """One table with a ``split`` column; columns that the test rows lack become null."""
    return train.withColumn(SPLIT, F.lit("train")).unionByName(
        test.withColumn(SPLIT, F.lit("test")), allowMissingColumns=True)


def import_data(spark: SparkSession, path: str, suffix: str = ".csv") -> tuple[DataFrame, DataFrame]:
    """(transactions with identity and split, submission template) from the five input files."""
    def one(name, schema):
        return read_table(spark, f"{path}/{name}{suffix}", schema)

    parts = [join_identity(one(f"{s}_transaction", transaction_schema(s == "train")),
                           one(f"{s}_identity", identity_schema())) for s in ("train", "test")]
    return union_splits(*parts), one("sample_submission", SUBMISSION_SCHEMA)


def exists(spark: SparkSession, path: str) -> bool:
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jvm_path)


def reuse_or_build(spark: SparkSession, path: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The table at ``path``; it is built and written first when no finished write is there."""
    if not exists(spark, f"{path}/_SUCCESS"):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
