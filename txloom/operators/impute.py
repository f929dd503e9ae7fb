"""Filling of missing and infinite values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..schema import LABEL, SPLIT, is_floating, numeric_columns
from .ordered import group_quantile


def _cleared(df: DataFrame, name: str, on_null, on_inf) -> Column:
    kind = df.schema[name].dataType
    null, infinite = (f"cast({v!r} as {kind.simpleString()})" for v in (on_null, on_inf))
    if not is_floating(kind):
        return F.expr(f"coalesce(`{name}`, {null})")
    return F.expr(f"case when `{name}` is null or isnan(`{name}`) then {null} "
                  f"when abs(`{name}`) = double('infinity') then {infinite} else `{name}` end")


def fill_constant(df: DataFrame, on_null: float = -999.0, on_inf: float = -999.0, columns=None) -> DataFrame:
    """Replace null and NaN by one constant and infinities by another, in one projection."""
    names = [c for c in (columns or numeric_columns(df)) if c in numeric_columns(df)]
    return df.withColumns({c: _cleared(df, c, on_null, on_inf) for c in names})


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN is a missing value from here on."""
    names = [f.name for f in df.schema.fields if is_floating(f.dataType)]
    return df.withColumns({c: F.nanvl(c, F.lit(None).cast("double")).cast(df.schema[c].dataType) for c in names})


def impute(df: DataFrame, columns, strategy: str = "mean", indicator: bool = False, train=None,
           compat: bool = False) -> DataFrame:
    """Replace nulls by the mean or median of the training rows, with an optional ``<c>_missing`` flag.

    ``compat=True`` leaves the values as they are (the original threw the result away).
    """
    if compat:
        return df
    if strategy not in ("mean", "median"):
        raise ValueError("strategy must be 'mean' or 'median'")
    train = train if train is not None else (df.where(F.col(SPLIT) == "train") if SPLIT in df.columns else df)
    doubles = {c: F.col(c).cast("double") for c in columns}
    values = train.select(*[e.alias(c) for c, e in doubles.items()])
    if strategy == "mean":
        value = values.agg(*[F.avg(c).alias(c) for c in columns]).first().asDict()
    else:
        medians = group_quantile(values.unpivot([], list(columns), "column", "x"), ["column"], "x", 0.5)
        value = {r["column"]: r["quantile"] for r in medians.collect()}
    out = {f"{c}_missing": F.col(c).isNull().cast("int") for c in columns} if indicator else {}
    out.update({c: F.coalesce(doubles[c], F.lit(value.get(c))) for c in columns})
    return df.withColumns(out)


def unlabelled(df: DataFrame, label: str = LABEL) -> DataFrame:
    """Labels of the test rows removed."""
    return df.withColumn(label, F.when(F.col(SPLIT) == "train", F.col(label)))
