"""Category encoders.

Each encoder is a pair of functions: one fits a small (column, value, ...)
table in a single scan of the listed columns, the other attaches it to rows.
"""

from __future__ import annotations

import math

from pyspark.ml.feature import OneHotEncoder
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.canon import family
from ..schema import LABEL, SPLIT, UNKNOWN
from ..session import settle
from .groupstats import COLUMN, VALUE, attach_long, key_text, long_values
from .lookup import attach
from .ordered import row_index

MISSING_CODE = -999


def _replaced(df: DataFrame, table: DataFrame, columns, source: str, value, old: bool = False) -> DataFrame:
    """Listed columns replaced by ``value(name, found)``; ``found`` is the table's ``source`` column.

    ``old``: the expression reads the column it replaces as well.
    """
    kept = df.columns if old else [c for c in df.columns if c not in columns]
    found = attach_long(df, table, {c: {f"_f_{c}": source} for c in columns}, null_safe=False, kept=kept)
    new = {c: value(c, F.col(f"_f_{c}")).alias(c) for c in columns}
    return found.select(*[new.get(c, F.col(c)) for c in df.columns])


# -- rare categories ---------------------------------------------------------

def limited_values(df: DataFrame, columns, limit: int = 0, most: int | None = None,
                   both: bool = True) -> DataFrame:
    """(column, value, kept): categories with more than ``limit`` (and at most ``most``) training
    rows that, when ``both``, also occur in the test rows."""
    counts = long_values(df, columns, [SPLIT]).where(F.col(VALUE).isNotNull()).groupBy(COLUMN, VALUE).agg(
        F.count_if(F.col(SPLIT) == "train").alias("train_n"), F.count_if(F.col(SPLIT) == "test").alias("test_n"))
    wanted = F.col("train_n") > limit
    if both:
        wanted = wanted & (F.col("train_n") > 0) & (F.col("test_n") > 0)
    if most is not None:
        wanted = wanted & (F.col("train_n") <= most)
    return counts.where(wanted).select(COLUMN, VALUE, F.lit(True).alias("kept"))


def split_category_counts(df: DataFrame, column: str) -> DataFrame:
    """(value, train_n, test_n) for the categories that occur in both splits."""
    return df.where(F.col(column).isNotNull()).groupBy(column).agg(
        F.count_if(F.col(SPLIT) == "train").alias("train_n"),
        F.count_if(F.col(SPLIT) == "test").alias("test_n"),
    ).where("train_n > 0 and test_n > 0")


def apply_limit(df: DataFrame, table: DataFrame, columns, unknown: str = UNKNOWN) -> DataFrame:
    return _replaced(df, table, columns, "kept", lambda c, kept: F.when(kept, F.col(c).cast("string")).otherwise(
        unknown), old=True)


def category_limit(df: DataFrame, columns, limit: int = 0, most: int | None = None, both: bool = True,
                   unknown: str = UNKNOWN) -> DataFrame:
    """Replace rare, unshared and null categories by ``unknown``."""
    table = settle(limited_values(df, columns, limit, most, both), "limits", COLUMN)
    return apply_limit(df, table, columns, unknown)


# -- one dictionary for all columns ------------------------------------------

def shared_dictionary(df: DataFrame, columns, limit: int = 0) -> DataFrame:
    """(column, value, code): categories that pass the limit, numbered from 1.

    Equal values of different columns share a code; numbers and texts never
    do.  Codes follow (kind, text) order, so they are the same on every run.
    """
    kinds = {c: family(df.schema[c].dataType) for c in columns}
    numbers = [c for c in columns if kinds[c] == "n"]
    kind = F.when(F.col(COLUMN).isin(numbers), "n").otherwise("s") if numbers else F.lit("s")
    kept = settle(limited_values(df, columns, limit).select(COLUMN, VALUE, kind.alias("kind"))
                  .where(~((F.col("kind") == "s") & (F.col(VALUE) == UNKNOWN))), "kept")
    codes = row_index(kept.select("kind", VALUE).distinct(), [], ["kind", VALUE], "_at")
    keyed = codes.select("kind", VALUE, (F.col("_at") + 1).alias("code"))
    return kept.join(keyed, ["kind", VALUE]).select(COLUMN, VALUE, "code")


def apply_codes(df: DataFrame, table: DataFrame, columns, miss: int | None = MISSING_CODE) -> DataFrame:
    """Replace each listed column by its code; a value without code becomes ``miss``."""
    return _replaced(df, table, columns, "code", lambda c, code: (
        code if miss is None else F.coalesce(code, F.lit(miss))).cast("bigint"))


def encode_categories(df: DataFrame, columns, limit: int = 0) -> DataFrame:
    return apply_codes(df, settle(shared_dictionary(df, columns, limit), "dictionary", COLUMN), columns)


# -- label codes --------------------------------------------------------------

def label_codes(df: DataFrame, columns) -> DataFrame:
    """(column, value, code): position of the value among the column's sorted distinct values.

    Numbers sort as numbers, texts by character.  Codes are per column.
    """
    numbers = [c for c in columns if family(df.schema[c].dataType) == "n"]
    as_number = F.when(F.col(COLUMN).isin(numbers), F.col(VALUE).try_cast("double")) if numbers else F.lit(
        None).cast("double")
    distinct = long_values(df, columns).where(F.col(VALUE).isNotNull()).distinct().withColumn("_num", as_number)
    return row_index(distinct, [COLUMN], ["_num", VALUE], "code").select(COLUMN, VALUE, "code")


def label_encode(df: DataFrame, columns, fill: str | None = "-999") -> DataFrame:
    """Label codes over train and test together; nulls take part as the text ``fill``."""
    texts = [c for c in columns if family(df.schema[c].dataType) == "s"]
    if fill is not None and texts:
        df = df.withColumns({c: F.coalesce(c, F.lit(fill)) for c in texts})
    table = settle(label_codes(df, columns), "labels", COLUMN)
    return apply_codes(df, table, columns, None)


# -- supplied vocabulary --------------------------------------------------------

def vocabulary(entries: DataFrame, word: str = "key", code: str = "code", position: str = "pos") -> DataFrame:
    """(value, code) of a vocabulary table; of entries with the same key the last one counts."""
    return entries.groupBy(F.col(word).alias(VALUE)).agg(F.max_by(code, position).alias("code"))


def vocabulary_encode(df: DataFrame, entries: DataFrame, column: str, out: str, unknown_code: int = 10000,
                      **names) -> DataFrame:
    """Code from a supplied vocabulary; 'unknown' has a fixed code, null and misses give null."""
    words = settle(vocabulary(entries, **names).withColumnRenamed("code", "_code"), "vocabulary")
    coded = attach(df, words, {VALUE: F.col(column)})
    code = F.when(F.col(column) == UNKNOWN, F.lit(unknown_code)).otherwise(F.col("_code"))
    return coded.withColumn(out, code.cast("bigint")).drop("_code")


# -- target, frequency, evidence ---------------------------------------------------

def target_means(df: DataFrame, columns, label: str = LABEL) -> DataFrame:
    """(column, value, mean): mean label of each non-null category."""
    return long_values(df, columns, [label]).where(F.col(VALUE).isNotNull()).groupBy(COLUMN, VALUE).agg(
        F.avg(label).alias("mean"))


def apply_means(df: DataFrame, table: DataFrame, columns) -> DataFrame:
    """Replace categories by means; unseen and null ones get the mean of the column so mapped."""
    found = attach_long(df.select(*columns), table, {c: {f"_m_{c}": "mean"} for c in columns}, null_safe=False)
    fallback = found.agg(*[F.avg(f"_m_{c}").alias(c) for c in columns]).first()
    return _replaced(df, table, columns, "mean", lambda c, mean: F.coalesce(mean, F.lit(fallback[c]).cast("double")))


def target_encode(df: DataFrame, columns, label: str = LABEL, fit_on: Column | None = None) -> DataFrame:
    fitted = df.where(fit_on) if fit_on is not None else df
    return apply_means(df, settle(target_means(fitted, columns, label), "targets", COLUMN), columns)


def frequency_counts(df: DataFrame, columns, compat: bool = False) -> DataFrame:
    """(column, value, count): rows of the category whose first other column is not null.

    ``compat=True`` leaves the last listed column out, as the original did.
    """
    columns = list(columns)
    first, second = columns[0], columns[1] if len(columns) > 1 else columns[0]
    present = df.select(*columns, F.col(first).isNotNull().alias("_first"), F.col(second).isNotNull().alias("_second"))
    long = long_values(present, columns[:-1] if compat else columns, ["_first", "_second"])
    other = F.when(F.col(COLUMN) == first, F.col("_second")).otherwise(F.col("_first"))
    return long.where(F.col(VALUE).isNotNull()).groupBy(COLUMN, VALUE).agg(F.count_if(other).alias("count"))


def apply_counts(df: DataFrame, table: DataFrame, columns) -> DataFrame:
    return _replaced(df, table, columns, "count", lambda c, n: F.coalesce(n, F.lit(0)).cast("bigint"))


def frequency_encode(df: DataFrame, columns, fit_on: Column | None = None, compat: bool = False) -> DataFrame:
    fitted = df.where(fit_on) if fit_on is not None else df
    table = settle(frequency_counts(fitted, columns, compat), "frequencies", COLUMN)
    return apply_counts(df, table, list(columns)[:-1] if compat else columns)


def evidence_table(df: DataFrame, columns, label: str = LABEL, smoothing: float = 0.5) -> DataFrame:
    """(column, value, woe): ln of the category's share of positives over its share of negatives."""
    totals = df.agg(F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) == 0).alias("n")).first()
    counts = long_values(df, columns, [label]).where(F.col(VALUE).isNotNull()).groupBy(COLUMN, VALUE).agg(
        F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) == 0).alias("n"))
    base = math.log((totals["p"] + smoothing) / (totals["n"] + smoothing))
    woe = F.ln((F.col("p") + smoothing) / (F.col("n") + smoothing)) - base
    return counts.select(COLUMN, VALUE, woe.alias("woe"))


def evidence_encode(df: DataFrame, columns, label: str = LABEL, fit_on: Column | None = None,
                    smoothing: float = 0.5) -> DataFrame:
    """``<c>_woe``; unseen and null categories carry no evidence (0)."""
    fitted = df.where(fit_on) if fit_on is not None else df
    table = settle(evidence_table(fitted, columns, label, smoothing), "evidence", COLUMN)
    df = attach_long(df, table, {c: {f"{c}_woe": "woe"} for c in columns}, null_safe=False)
    return df.withColumns({f"{c}_woe": F.coalesce(f"{c}_woe", F.lit(0.0)) for c in columns})


def one_hot(df: DataFrame, columns, suffix: str = "_onehot") -> DataFrame:
    """One-hot vectors of discrete columns such as counts; null has a slot of its own.

    Slots follow the sorted texts, one more is spare; only the number of slots per column reaches the driver.
    """
    texts = df.withColumns({f"_t_{c}": F.coalesce(key_text(df, c), F.lit("nan")) for c in columns})
    names = [f"_t_{c}" for c in columns]
    table = settle(label_codes(texts, names), "slots", COLUMN)
    slots = {r[COLUMN]: r["n"] for r in table.groupBy(COLUMN).agg(F.count(F.lit(1)).alias("n")).collect()}
    coded = attach_long(texts, table, {f"_t_{c}": {f"_x_{c}": "code"} for c in columns}, null_safe=False)
    coded = coded.withColumns({f"_x_{c}": F.col(f"_x_{c}").cast("double") for c in columns})
    for c in columns:
        coded = coded.withMetadata(f"_x_{c}", {"ml_attr": {"type": "nominal", "num_vals": slots.get(f"_t_{c}", 0) + 1}})
    hot = OneHotEncoder(inputCols=[f"_x_{c}" for c in columns], outputCols=[f"{c}{suffix}" for c in columns],
                        dropLast=False)
    return hot.fit(coded).transform(coded).drop(*names, *[f"_x_{c}" for c in columns])


def pooled_values(df: DataFrame, columns, without: str | None = None) -> DataFrame:
    """(value): distinct values of all listed columns together, minus one value."""
    pool = long_values(df, columns).select(VALUE).where(F.col(VALUE).isNotNull()).distinct()
    return pool if without is None else pool.where(F.col(VALUE) != without)


