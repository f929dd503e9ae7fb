"""Lossless type narrowing, category codes, column profiles and column drops."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import NumericType, StringType

from ..schema import is_floating, is_integral
from ..session import settle

# Whole types in the order they are tried, with their ranges; float comes after them.
RANGES = {"tinyint": (-2**7, 2**7 - 1), "smallint": (-2**15, 2**15 - 1), "int": (-2**31, 2**31 - 1)}
BYTES = {"tinyint": 1, "smallint": 2, "int": 4, "bigint": 8, "float": 4, "double": 8}


@dataclass(frozen=True)
class Limits:
    """What a narrower type may lose: largest and mean gap, nulls, distinct values."""

    max_loss: float = 0.001
    avg_loss: float = 0.001
    na_loss: int = 0
    unique_loss: int = 0

    def close(self, largest: float | None, total: float | None, count: int) -> bool:
        """Whether the gaps of a column stay within the limits; a column without values has none."""
        return not count or (largest is not None and largest <= self.max_loss and total / count <= self.avg_loss)


def _long_numbers(df: DataFrame, names) -> DataFrame:
    """(column, real, whole) of every row and listed column; ``whole`` is null in floating columns and has all digits elsewhere."""
    def entry(c: str) -> str:
        name, quoted = c.replace("\\", "\\\\").replace("'", "\\'"), c.replace("`", "``")
        whole = "null" if is_floating(df.schema[c].dataType) else f"`{quoted}`"
        return f"struct('{name}' as column, cast(`{quoted}` as double) as real, cast({whole} as bigint) as whole)"

    return df.selectExpr(f"inline(array({', '.join(map(entry, names))}))")


def _single(v: Column) -> Column:
    """The value that a float would hold, as double; from a double, since whole -> float -> double is optimized to whole -> double."""
    return v.cast("float").cast("double")


def _gaps() -> dict[str, Column]:
    """Aggregates that settle a column's type; a task sends one row per column, whatever the number of rows.

    Per target type ``t`` of :data:`RANGES` and float: ``n_t`` values that it can hold,
    largest gap ``max_t`` and sum of the gaps ``sum_t`` to the value it would hold.
    """
    v = F.col("real")
    nearest = F.when(F.col("whole").isNull(), F.round(v)).otherwise(v)
    out = {"rows": F.count(F.lit(1)), "filled": F.count(v)}
    for kind, (low, high) in RANGES.items():
        held = F.when(nearest.between(low, high), nearest)
        out |= {f"n_{kind}": F.count(held), f"max_{kind}": F.max(F.abs(held - v)), f"sum_{kind}": F.sum(F.abs(held - v))}
    gap = F.abs(_single(v) - v)
    # a double, and with it the gap, is exact for whole numbers below 2**53 only
    safe = F.count_if(v.isNotNull() & (F.col("whole").isNull() | (F.abs(v) < 2.0**53)))
    return out | {"n_float": F.count(v), "max_float": F.max(gap), "sum_float": F.sum(gap), "safe": safe}


def _settled(stats, started: str, limits: Limits) -> list[str]:
    """Types that a column may take, in order.

    The last is certain: it holds every value without a gap, or is the type the
    column has.  Those before it move values a little, so they are taken only
    if the distinct values, still to be counted, stay apart.
    """
    nulls, out = stats["rows"] - stats["filled"], []
    for kind in [*(RANGES if nulls <= limits.na_loss else ()), "float"]:
        held, largest, total = (stats[f"{what}_{kind}"] for what in ("n", "max", "sum"))
        if stats["filled"] - held > limits.na_loss or not limits.close(largest, total, held):
            continue
        out.append(kind)
        if held == stats["filled"] and not largest and (kind != "float" or stats["safe"] == held):
            return out
    return [*out, started]


def _kept_distincts(df: DataFrame, names, open_kinds: dict[str, list[str]]) -> DataFrame:
    """(column, nulls, distincts, left): distinct values before and, per open type, after narrowing.

    Rows become distinct values with counts first, combined before the shuffle;
    values that the nearest whole number or float cannot tell apart meet in one
    more aggregate of those.  Columns without an open type skip it.
    """
    values = _long_numbers(df, names).groupBy("column", "real", "whole").agg(F.count(F.lit(1)).alias("n"))
    is_null = F.col("real").isNull()
    counts = values.groupBy("column").agg(
        F.sum(F.when(is_null, F.col("n")).otherwise(0)).alias("nulls"), F.count(F.lit(1)).alias("distincts"))
    if not open_kinds:
        return counts.withColumn("left", F.create_map().cast("map<string,bigint>"))
    kinds = F.create_map(*[x for c, ks in open_kinds.items() for x in (F.lit(c), F.array(*map(F.lit, ks)))])
    met = F.lit(None).cast("double")
    for kind, (low, high) in RANGES.items():
        nearest = F.round("real")
        met = F.when((F.col("kind") == kind) & nearest.between(low, high), nearest).otherwise(met)
    met = F.when(F.col("kind") == "float", _single(F.col("real"))).otherwise(met)
    after = values.where(F.col("column").isin(list(open_kinds))).select("column", "real", F.explode(
        F.try_element_at(kinds, F.col("column"))).alias("kind")).select("column", "kind", met.alias("met")).distinct().groupBy(
        "column", "kind").agg(F.count(F.lit(1)).alias("n")).groupBy("column").agg(
        F.map_from_entries(F.collect_list(F.struct("kind", "n"))).alias("left"))  # at most four entries a column
    return counts.join(after, "column", "left")


def _candidates(df: DataFrame, columns, limits: Limits) -> tuple[dict[str, str], dict[str, list[str]]]:
    """Started type and candidate types per numeric column, from one aggregate over the table (a row per column to the driver)."""
    fields = {f.name: f.dataType for f in df.schema.fields if isinstance(f.dataType, NumericType)}
    names = [c for c in (columns or fields) if c in fields and (is_integral(fields[c]) or is_floating(fields[c]))]
    if not names:
        return {}, {}
    stats = _long_numbers(df, names).groupBy("column").agg(*[e.alias(n) for n, e in _gaps().items()]).collect()
    started = {c: fields[c].simpleString() for c in names}
    return started, {r["column"]: _settled(r, started[r["column"]], limits) for r in stats}


def _profiled(df: DataFrame, started: dict[str, str], tried: dict[str, list[str]], limits: Limits) -> DataFrame:
    counted = _kept_distincts(df, list(tried), {c: kinds[:-1] for c, kinds in tried.items() if len(kinds) > 1})

    def per_column(values: dict[str, str]) -> Column:
        return F.try_element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), F.col("column"))

    chosen = per_column({c: kinds[-1] for c, kinds in tried.items()})
    for kind in reversed([*RANGES, "float"]):
        asked = [c for c, kinds in tried.items() if kind in kinds[:-1]]
        lost = F.abs(F.col("distincts") - F.try_element_at("left", F.lit(kind)))
        chosen = F.when(F.col("column").isin(asked) & (lost <= limits.unique_loss), F.lit(kind)).otherwise(chosen)
    return counted.select("column", per_column(started).alias("from_type"), chosen.alias("to_type"),
                          F.col("nulls").cast("bigint").alias("nulls"), F.col("distincts").cast("bigint").alias("distincts"))


def narrowing_profile(df: DataFrame, columns=None, **limits) -> DataFrame:
    """(column, from_type, to_type, nulls, distincts): the narrowest type that loses no more than :class:`Limits` allows.

    Whole types are tried for columns without nulls only.  One aggregate settles
    every type that holds its values exactly; distinct values are counted
    afterwards, and compared only where a type moves values a little.
    """
    allowed = Limits(**limits)
    started, tried = _candidates(df, columns, allowed)
    if not tried:
        return df.sparkSession.createDataFrame([], "column string, from_type string, to_type string, nulls bigint, distincts bigint")
    return _profiled(df, started, tried, allowed)


def cast_to(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """One projection of casts; floating values are rounded before they become whole."""
    out = {}
    for c, kind in types.items():
        whole = is_floating(df.schema[c].dataType) and kind in ("tinyint", "smallint", "int", "bigint")
        out[c] = (F.round(c) if whole else F.col(c)).cast(kind)
    return df.withColumns(out)


def narrowed_types(df: DataFrame, columns=None, **limits) -> dict[str, str]:
    """Column to new type, for the columns whose type changes; only columns with open types are read a second time."""
    allowed = Limits(**limits)
    started, tried = _candidates(df, columns, allowed)
    types = {c: kinds[0] for c, kinds in tried.items() if len(kinds) == 1}
    left = {c: kinds for c, kinds in tried.items() if c not in types}
    if left:
        types |= {r["column"]: r["to_type"] for r in _profiled(df, started, left, allowed).collect()}
    return {c: types[c] for c in started if c in types and types[c] != started[c]}


def narrow(df: DataFrame, columns=None, **limits) -> DataFrame:
    """Cast every numeric column to its narrowest type within the limits (a row per column reaches the driver)."""
    return cast_to(df, narrowed_types(df, columns, **limits))


def text_categories(df: DataFrame, columns=None) -> tuple[DataFrame, DataFrame]:
    """Text columns as codes of the narrowest whole type, and the dictionary (column, value, code).

    Codes number the sorted distinct texts of a column from 0; null stays null.
    The dictionary is written once and joined part by part (:func:`encoders.apply_codes`).
    """
    from .encoders import apply_codes, label_codes
    from .groupstats import COLUMN
    names = list(columns) if columns is not None else [f.name for f in df.schema.fields if isinstance(f.dataType, StringType)]
    empty = "column string, value string, code bigint"
    if not names:
        return df, df.sparkSession.createDataFrame([], empty)
    table = settle(label_codes(df, names).withColumn("code", F.col("code").cast("bigint")), "categories", COLUMN)
    most = {r[COLUMN]: r["most"] for r in table.groupBy(COLUMN).agg(F.max("code").alias("most")).collect()}
    kinds = {c: next((k for k, (_, high) in RANGES.items() if most.get(c, 0) <= high), "bigint") for c in names}
    coded = apply_codes(df, table, names, None)
    return coded.withColumns({c: F.col(c).cast(k) for c, k in kinds.items()}), table.select(COLUMN, "value", "code")


def category_texts(coded: DataFrame, words: DataFrame, columns, suffix: str = "_text") -> DataFrame:
    """The texts behind the codes of :func:`text_categories`, as columns ``<c><suffix>``."""
    from .groupstats import COLUMN, VALUE, attach_long, key_text
    by_code = settle(words.select(COLUMN, key_text(words, "code").alias(VALUE), F.col("value").alias("text")), "texts", COLUMN)
    return attach_long(coded, by_code, {c: {f"{c}{suffix}": "text"} for c in columns}, null_safe=False)


def reduce_table(df: DataFrame, columns=None, text_codes: bool = False, **limits) -> tuple[DataFrame, DataFrame]:
    """Narrowed numbers and, with ``text_codes``, texts as codes; returned with their dictionary (empty without)."""
    texts = [f.name for f in df.schema.fields if text_codes and isinstance(f.dataType, StringType) and (
        columns is None or f.name in columns)]
    return text_categories(narrow(df, columns, **limits), texts)


def narrowing_report(df: DataFrame, columns=None, **limits) -> DataFrame:
    """Per numeric column: types, bytes per value, nulls and distinct values before and after."""
    before = settle(narrowing_profile(df, columns, **limits), "profile")
    rows = before.collect()
    if not rows:
        return before.selectExpr("column", "from_type", "to_type", "0 as bytes_before", "0 as bytes_after", "nulls",
                                 "nulls as nulls_after", "distincts", "distincts as distincts_after",
                                 "false as lost_nulls", "false as lost_values")
    after = cast_to(df, {r["column"]: r["to_type"] for r in rows})
    counted = _kept_distincts(after, [r["column"] for r in rows], {}).select(
        F.col("column"), F.col("nulls").alias("nulls_after"), F.col("distincts").alias("distincts_after"))
    size = F.create_map(*[F.lit(x) for kv in BYTES.items() for x in kv])
    return before.join(counted, "column").select(
        "column", "from_type", "to_type", F.try_element_at(size, F.col("from_type")).alias("bytes_before"),
        F.try_element_at(size, F.col("to_type")).alias("bytes_after"), "nulls", "nulls_after", "distincts",
        "distincts_after", (F.col("nulls") != F.col("nulls_after")).alias("lost_nulls"),
        (F.col("distincts") != F.col("distincts_after")).alias("lost_values"))


def column_counts(df: DataFrame, columns) -> DataFrame:
    """(column, nulls, distincts, distincts_not_null); null is one distinct value of ``distincts``."""
    from .groupstats import COLUMN, VALUE, long_values
    values = long_values(df, columns).groupBy(COLUMN, VALUE).agg(F.count(F.lit(1)).alias("n"))
    return values.groupBy(COLUMN).agg(
        F.sum(F.when(F.col(VALUE).isNull(), F.col("n")).otherwise(0)).alias("nulls"),
        F.count(F.lit(1)).alias("distincts"), F.count(VALUE).alias("distincts_not_null"))


def null_counts(df: DataFrame, columns) -> DataFrame:
    """(column, nulls): one aggregate row over the table, turned into one row per column."""
    return df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns]).unpivot([], list(columns), "column", "nulls")


def constant_columns(df: DataFrame, columns=None) -> list[str]:
    """Columns with exactly one distinct non-null value: smallest equals largest."""
    names = list(columns or df.columns)
    row = df.agg(*[(F.min(c).eqNullSafe(F.max(c)) & F.min(c).isNotNull()).alias(c) for c in names]).first()
    return [c for c in names if row[c]]


def drop_constant(df: DataFrame, columns=None) -> DataFrame:
    return df.drop(*constant_columns(df, columns))


def select_columns(df: DataFrame, columns, as_vector: str | None = None) -> DataFrame:
    """Projection by list; with ``as_vector`` the columns become one ML vector."""
    if as_vector is None:
        return df.select(*columns)
    from pyspark.ml.feature import VectorAssembler
    return VectorAssembler(inputCols=list(columns), outputCol=as_vector, handleInvalid="keep").transform(df).select(
        as_vector)


def drop_empty(df: DataFrame, columns) -> DataFrame:
    """Without the rows in which all listed columns are null."""
    return df.na.drop(how="all", subset=list(columns))
