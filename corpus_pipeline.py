"""The corpus pipeline: quality classifier, quality rules, near-duplicates, repeated lines, packing.

A stage takes (spark, docs, folder of the tables) and returns a DataFrame; it
is written as Parquet and read again as the ``docs`` of the next one.  All
stages but the last keep the columns of ``documents``, and all handle empty
tables, null texts and ids and further columns as their operators define.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from txloom.llm import ledger, lines, minhash, packing, passages, rules
from txloom.session import scratch_path


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble accepts."""
    return rules.accepted_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the current rule policy."""
    return ledger.kept_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, linked at a similarity of 0.80 or more."""
    return minhash.one_of_each_group(docs, percent=80)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines (of any length) and passages that an earlier document has; a text may become empty, no document goes."""
    return lines.drop_repeated_units(docs, min_words=1, passage=passages.PASSAGE).select(*[f"`{c}`" for c in docs.columns])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in training sequences."""
    return packing.pack_documents(docs, loss=packing.SEQUENCE_TOKENS)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("substring_dedup", substring_dedup),
    ("packing", pack),
]

#: SQL can express neither the fitted classifier nor the tokenizer; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
