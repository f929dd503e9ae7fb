"""Scores of predictions as aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .ordered import CHUNK


def auc(df: DataFrame, score: str = "prediction", label: str = "label", by=(), weight: str | None = None,
        name: str = "auc") -> DataFrame:
    """Area under the ROC curve per group, ties counted half; null when a class is absent.

    Equal scores are combined first, then range-partitioned; each chunk counts
    its own ordered pairs, and pairs across chunks follow from chunk totals.
    One job, no task holds a group.
    """
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    is_positive = F.col(label) == 1
    by = list(by)
    scores = df.where(F.col(label).isNotNull() & F.col(score).isNotNull()).groupBy(*by, score).agg(
        F.sum(F.when(is_positive, w).otherwise(0.0)).alias("_p"),
        F.sum(F.when(~is_positive, w).otherwise(0.0)).alias("_n"),
    )
    placed = scores.repartitionByRange(*by, score).withColumn(CHUNK, F.spark_partition_id())
    inside = Window.partitionBy(*by, CHUNK).orderBy(score).rowsBetween(Window.unboundedPreceding, -1)
    below = F.coalesce(F.sum("_n").over(inside), F.lit(0.0))
    chunks = placed.withColumn("_area", F.col("_p") * (below + F.col("_n") / 2)).groupBy(*by, CHUNK).agg(
        F.sum("_area").alias("_area"), F.sum("_p").alias("_p"), F.sum("_n").alias("_n"))
    earlier = Window.partitionBy(*by).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    lower = F.coalesce(F.sum("_n").over(earlier), F.lit(0.0))
    return chunks.withColumn("_area", F.col("_area") + F.col("_p") * lower).groupBy(*by).agg(
        F.try_divide(F.sum("_area"), F.sum("_p") * F.sum("_n")).alias(name))


def auc_value(df: DataFrame, score: str = "prediction", label: str = "label", weight: str | None = None):
    row = auc(df, score, label, weight=weight).first()
    return row["auc"] if row else None


def weighted_mean(value: Column, weight: str | None = None) -> Column:
    if weight is None:
        return F.avg(value)
    w = F.col(weight).cast("double")
    return F.try_divide(F.sum(value * w), F.sum(F.when(value.isNotNull(), w)))


def errors(df: DataFrame, prediction: str = "prediction", label: str = "label", by=(), weight: str | None = None,
           cut: float = 0.5) -> DataFrame:
    """mse, mae and accuracy (class = prediction above ``cut``) per group, optionally weighted."""
    gap = F.col(prediction).cast("double") - F.col(label).cast("double")
    hit = ((F.col(prediction) > cut).cast("int") == F.col(label).cast("int")).cast("double")
    return df.groupBy(*by).agg(
        weighted_mean(gap * gap, weight).alias("mse"),
        weighted_mean(F.abs(gap), weight).alias("mae"),
        weighted_mean(hit, weight).alias("accuracy"),
    )


METRICS = ("mse", "mae", "accuracy", "auc")


def metric_value(df: DataFrame, metric: str, prediction: str = "prediction", label: str = "label",
                 weight: str | None = None) -> float:
    if metric not in METRICS:
        raise ValueError(f"metric must be one of {METRICS}")
    if metric == "auc":
        return auc_value(df, prediction, label, weight)
    return errors(df, prediction, label, weight=weight).first()[metric]
