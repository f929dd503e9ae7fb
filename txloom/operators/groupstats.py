"""Frequency tables and group statistics attached to rows.

A group value is never computed with a window over the rows of the group: the
statistics are aggregated first (hot keys combine on the map side) and the
small result is joined back.  All key columns of one call share one scan.
"""

from __future__ import annotations

from collections.abc import Iterable

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StructField, StructType

from ..functions.canon import canonical
from ..functions.ratios import ratio
from ..schema import ADDRS, AMOUNT, CARDS, ID_COLS, KEY, ROW, SPLIT, TIME, is_floating
from ..session import settle
from .lookup import attach, attach_found

COLUMN, VALUE = "column", "value"
#: Rows of a key column's table up to which values are looked up inside the task.
FEW = 10_000


def key_text(df: DataFrame, name: str) -> Column:
    return canonical(F.col(name), df.schema[name].dataType)


def long_values(df: DataFrame, columns: Iterable[str], keep=()) -> DataFrame:
    """One row per (row, listed column): the kept columns, ``column`` and ``value`` as text."""
    columns = list(columns)
    kept = [F.col(k).alias(f"_keep_{k}") for k in keep]
    wide = df.select(*kept, *[key_text(df, c).alias(c) for c in columns])
    long = wide.unpivot([f"_keep_{k}" for k in keep], columns, COLUMN, VALUE)
    return long.select(*[F.col(f"_keep_{k}").alias(k) for k in keep], COLUMN, VALUE)


def frequency_table(df: DataFrame, columns, within=()) -> DataFrame:
    """(within, column, value, n); null counts as a value."""
    return long_values(df, columns, within).groupBy(*within, COLUMN, VALUE).agg(F.count(F.lit(1)).alias("n"))


def _joined(keyed: DataFrame, table: DataFrame, outputs: dict, places: dict, within, null_safe: bool, how: str = "left") -> DataFrame:
    for c, wanted in outputs.items():
        i = places[c]
        part = table.where(F.col(COLUMN) == c).select(
            *[F.col(w).alias(f"_on_{i}_{w}") for w in within], F.col(VALUE).alias(f"_on_{i}"),
            *[F.col(src).alias(dst) for dst, src in wanted.items()])
        left, right = F.col(f"_key_{i}"), F.col(f"_on_{i}")
        test = left.eqNullSafe(right) if null_safe else left == right
        for w in within:
            same = F.col(w).eqNullSafe(F.col(f"_on_{i}_{w}")) if null_safe else F.col(w) == F.col(f"_on_{i}_{w}")
            test = test & same
        keyed = keyed.join(part, test, how)
    return keyed


def _shuffled(table: DataFrame, column: str) -> bool:
    """Whether the part of a key column is too large for a broadcast."""
    spark = table.sparkSession
    size = table.where(F.col(COLUMN) == column)._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return int(str(size)) > spark._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()


def _by_row(df: DataFrame, source: DataFrame, table: DataFrame, outputs: dict, within, null_safe: bool) -> DataFrame:
    """The parts of large key columns: number and key alone are shuffled by key, what is found goes to the row."""
    found = []
    for c, wanted in outputs.items():
        cells = source.select(ROW, *within, key_text(source, c).alias("_key_0"))
        hits = _joined(cells, table, {c: wanted}, {c: 0}, within, null_safe, "inner")
        found.append(hits.select(ROW, *wanted))
    return attach_found(df, found)


def _found(parts: list, width: int):
    """Task side: the values that the keys of whole Arrow batches have in small tables, as one struct per row.

    A part is (place of its key, columns of its table, values, whether null is a
    key); the first ``width`` columns, and arguments, are the ``within`` ones.
    """
    def run(*args: pa.Array) -> pa.Array:
        made = []
        for at, keys, values, null_safe in parts:
            row, entry = pa.scalar(0, pa.int64()), pa.scalar(0, pa.int64())
            for mine, theirs in zip([*args[:width], args[at]], keys):
                distinct = theirs.unique()
                row, entry = (pc.add(pc.multiply(place, max(len(distinct), 1)), pc.cast(
                    pc.index_in(each, distinct, skip_nulls=not null_safe), pa.int64())) for place, each in ((row, mine), (entry, theirs)))
            here = pc.index_in(row, entry, skip_nulls=True)
            made += [v.take(here) for v in values]
        return pa.StructArray.from_arrays(made, [f"f{i}" for i in range(len(made))])

    return run


def _looked_up(keyed: DataFrame, table: DataFrame, few: list, outputs: dict, places: dict, within, null_safe: bool) -> DataFrame:
    """The parts of at most ``FEW`` rows: one pass over the rows for all of them."""
    kinds = {f.name: f.dataType for f in table.schema.fields}
    sources = list(dict.fromkeys(src for c in few for src in outputs[c].values()))
    small = table.where(F.col(COLUMN).isin(few)).select(COLUMN, *within, VALUE, *sources).toArrow()  # bounded by FEW and the columns
    parts, fields, names = [], [], []
    for i, c in enumerate(few):
        part = small.filter(pc.equal(small[COLUMN], c)).combine_chunks()
        column = {n: pa.concat_arrays(part[n].chunks) if part[n].num_chunks else pa.array([], part[n].type) for n in part.column_names}
        parts.append((len(within) + i, [column[w] for w in [*within, VALUE]], [column[src] for src in outputs[c].values()], null_safe))
        for dst, src in outputs[c].items():
            fields.append(StructField(f"f{len(fields)}", kinds[src]))
            names.append(dst)
    look = F.arrow_udf(_found(parts, len(within)), StructType(fields))
    rows = keyed.withColumn("_found", look(*[F.col(w) for w in within], *[F.col(f"_key_{places[c]}") for c in few]))
    return rows.select(*keyed.columns, *[F.col(f"_found.f{i}").alias(dst) for i, dst in enumerate(names)])


def attach_long(df: DataFrame, table: DataFrame, outputs: dict[str, dict[str, str]], within=(),
                null_safe: bool = True, source: DataFrame | None = None, kept=None) -> DataFrame:
    """Join a (within, column, value, ...) table, once for each key column.

    ``outputs`` names, per key column of ``df``, the new columns and the table
    columns they come from.  The key texts are made in one projection before
    the joins and left out in one after them.  Key columns with at most ``FEW``
    rows in the table are looked up together, batch by batch, so that the rows
    do not pass a join for each of them; the others are joined, and Catalyst
    broadcasts the parts that are small enough.  Where the rows have numbers
    (a column ``ROW``), they do not pass the joins that need a shuffle
    either; ``source`` may give the same numbers and key columns by a cheaper
    plan.  ``kept`` are the columns of ``df`` to return, all if not given.  A key
    must be in the table once.
    """
    names = df.columns if kept is None else list(kept)
    places = {c: i for i, c in enumerate(outputs)}
    sizes = {r[COLUMN]: r["n"] for r in table.groupBy(COLUMN).agg(F.count(F.lit(1)).alias("n")).collect()}  # one row per key column
    plain = not any(is_floating(table.schema[w].dataType) for w in within)  # 0.0 and -0.0 are one key of a join
    few = [c for c in outputs if plain and sizes.get(c, 0) <= FEW]
    large = [c for c in outputs if c not in few and ROW in names and _shuffled(table, c)]
    keyed = df.select("*", *[key_text(df, c).alias(f"_key_{i}") for c, i in places.items() if c not in large])
    if few:
        keyed = _looked_up(keyed, table, few, outputs, places, within, null_safe)
    wide = _joined(keyed, table, {c: o for c, o in outputs.items() if c not in [*few, *large]}, places, within, null_safe)
    if large:
        wide = wide.select(*names, *[dst for c, wanted in outputs.items() if c not in large for dst in wanted])
        wide = _by_row(wide, df if source is None else source, table, {c: outputs[c] for c in large}, within, null_safe)
    return wide.select(*names, *[dst for wanted in outputs.values() for dst in wanted])


def count_encode(df: DataFrame, columns, suffix: str = "_count_full", within=(), counted=None) -> DataFrame:
    """``<c><suffix>`` = number of rows (per ``within`` group) with the row's value; null is a value.

    ``counted`` may give the same rows by a cheaper plan that has just these columns (and ``ROW``, if ``df`` has it).
    """
    columns = [c for c in columns if c in df.columns]
    table = settle(frequency_table(df if counted is None else counted, columns, within), "counts", COLUMN)
    return attach_long(df, table, {c: {c + suffix: "n"} for c in columns}, within, source=counted)


def card_counts(df: DataFrame, counted=None) -> DataFrame:
    return count_encode(df, [*CARDS, *ADDRS], counted=counted)


# Columns counted per split, and over both splits.
COUNT_PER_SPLIT = ["id_01", "id_31", "id_33", "id_35"]
COUNT_OVERALL = ["ProductCD", "P_emaildomain", "R_emaildomain", *[f"M{i}" for i in range(1, 10)], "DeviceType",
                 "DeviceInfo", *[f"id_{i}" for i in range(12, 31)], "id_32", "id_34", "id_36", "id_37", "id_38"]


def split_counts(df: DataFrame, columns=COUNT_PER_SPLIT, counted=None) -> DataFrame:
    return count_encode(df, columns, "_count_dist", [SPLIT], counted)


def categorical_counts(df: DataFrame, columns=COUNT_OVERALL, compat: bool = False, counted=None) -> DataFrame:
    """Counts over both splits; ``compat`` keeps the original result, where only id_35 was counted."""
    return count_encode(df, ["id_35"] if compat else columns, counted=counted)


AGGREGATES = {
    "count": lambda c: F.count(c).cast("bigint"),
    "mean": F.avg,
    "std": F.stddev_samp,
    "var": F.var_samp,
    "sum": F.sum,
    "min": F.min,
    "max": F.max,
}


def group_stats(df: DataFrame, keys, values, stats=("mean", "std"), within=()) -> DataFrame:
    """(within, column, value, <v>_<stat>...) for each key column; rows with a null key are left out."""
    numbers = [F.col(v).cast("double").alias(v) for v in values]
    kept = df.select(*within, *[F.col(k) for k in keys if k not in values and k not in within], *numbers)
    long = long_values(kept, keys, [*within, *values]).where(F.col(VALUE).isNotNull())
    return long.groupBy(*within, COLUMN, VALUE).agg(
        *[AGGREGATES[s](F.col(v)).alias(f"{v}_{s}") for v in values for s in stats])


# The (value, key) pairs of the ratio-to-group features.
GROUP_RATIOS = [(AMOUNT, "card1"), (AMOUNT, "card4"), ("id_02", "card1"), ("id_02", "card4"), ("D15", "card1"),
                ("D15", "card4"), ("D15", "addr1")]


def group_ratios(df: DataFrame, pairs=GROUP_RATIOS, within=(SPLIT,), on_zero: str = "null", counted=None) -> DataFrame:
    """``<v>_to_mean_<k>`` and ``<v>_to_std_<k>``, the statistics taken per split.

    ``counted`` may give the same rows by a cheaper plan.
    """
    pairs = [(v, k) for v, k in pairs if v in df.columns and k in df.columns]
    keys = list(dict.fromkeys(k for _, k in pairs))
    values = list(dict.fromkeys(v for v, _ in pairs))
    table = settle(group_stats(df if counted is None else counted, keys, values, ("mean", "std"), within), "groupstats", COLUMN)
    columns, ratios = df.columns, {}
    outputs = {k: {f"_{v}_{s}_{k}": f"{v}_{s}" for v in values for s in ("mean", "std") if (v, k) in pairs}
               for k in keys}
    df = attach_long(df, table, outputs, within, null_safe=False, source=counted)
    for v, k in pairs:
        for s in ("mean", "std"):
            ratios[f"{v}_to_{s}_{k}"] = ratio(v, f"_{v}_{s}_{k}", on_zero)
    return df.select(*columns, *[e.alias(n) for n, e in ratios.items()])


def group_broadcast(df: DataFrame, key: str, values, stats=("mean", "std"), within=(SPLIT,)) -> DataFrame:
    """Statistics of the row's group as columns ``<v>_<stat>_<key>``; null where the key is null."""
    table = settle(group_stats(df, [key], values, stats, within), "groupstats", COLUMN)
    outputs = {f"{v}_{s}_{key}": f"{v}_{s}" for v in values for s in stats}
    return attach_long(df, table, {key: outputs}, within, null_safe=False)


def fingerprint(columns) -> Column:
    """Hash of several columns that keeps nulls in place; null when all are null."""
    text = F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})
    return F.when(F.coalesce(*[F.col(c).cast("string") for c in columns]).isNotNull(), F.sha2(text, 256))


def user_stats(df: DataFrame, ids=None, amount: str = AMOUNT, time: str = TIME, key: str = KEY, counted=None) -> DataFrame:
    """Count, mean and deviation of the amount over all rows with the same identity columns.

    Rows without identity get nulls.  There may be many: where the rows have
    numbers (``ROW``), only those with an identity are shuffled, and without their other
    columns; ``counted`` may give the same rows by a cheaper plan.  Otherwise, for the join, a
    missing fingerprint is replaced by a text of the row's own that matches
    nothing, so that they do not meet in one task.
    """
    ids = [c for c in (ids or ID_COLS) if c in df.columns]
    marked = (df if counted is None else counted).withColumn("_user", fingerprint(ids))
    named = marked.where(F.col("_user").isNotNull())
    if ROW in df.columns:
        named = named.select(ROW, time, amount, F.unhex("_user").alias("_user"))
    stats = named.groupBy("_user").agg(
        F.count(time).cast("bigint").alias("user_trx_cnt"),
        F.avg(amount).alias("user_TransactionAmt_mean"),
        F.stddev_samp(amount).alias("user_TransactionAmt_std"),
    )
    if ROW in df.columns:
        return attach_found(df, [attach(named.select(ROW, "_user"), stats, {"_user": "_user"}, how="inner").drop("_user")])
    nobody = F.concat(F.lit("none-"), F.xxhash64(key, time, amount).cast("string"))
    spread = df.withColumn("_user", F.coalesce(fingerprint(ids), nobody))
    return attach(spread, stats, {"_user": "_user"}).drop("_user")
