"""Running totals and previous values over a global or per-group order.

A window partitioned by a client, a column name or nothing at all puts all
rows of one group into one task, and one group may hold a third of the table.
Here the rows are cut into chunks of the order (group, order) instead, so that
a large group spans many chunks.  The borders come from a sample of the keys
and stand in the plan as a literal, so the chunk number is an expression of
the row: the rows are exchanged once, by that number, and windows inside
(chunk, group) need no second exchange.  What the chunks before hold is added
from a table of chunk totals when the written rows are read.  At most one
group per chunk began in an earlier chunk, so the table of carried totals has
fewer rows than there are chunks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import settle

CHUNK = "_chunk"
#: Keys drawn per chunk to find the borders.
DRAWN = 100


def _key(names) -> Column:
    return F.struct(*[F.col(c).alias(f"k{i}") for i, c in enumerate(names)])


def chunked(df: DataFrame, by, order, chunks: int | None = None, drawn_from: DataFrame | None = None) -> DataFrame:
    """``df`` with its chunk number, one partition per chunk of the order (by, order); nulls first.

    ``chunks`` is the number of shuffle partitions if not given, fewer for a
    table of under ``DRAWN`` rows a chunk.  The keys with the smallest hashes
    are the sample, so the borders are the same in every run; rows with equal
    keys share a chunk.  ``drawn_from`` may give a fair part of the keys by a
    cheaper plan.
    """
    spark, names = df.sparkSession, [*by, *order]
    most = chunks or int(spark.conf.get("spark.sql.shuffle.partitions"))
    drawn = []
    if most > 1:
        keys = (df if drawn_from is None else drawn_from).select(_key(names).alias("k"))
        hashed = F.xxhash64(*[F.col(f"k.k{i}") for i in range(len(names))])
        kind = keys.schema["k"].dataType.simpleString()
        drawn = [r["j"] for r in keys.orderBy(hashed).limit(DRAWN * most).sortWithinPartitions("k").select(
            F.to_json("k").alias("j")).collect()]  # bounded by the number of chunks, not by the rows
    count = most if chunks else min(most, 1 + len(drawn) // DRAWN)
    cuts = [drawn[len(drawn) * i // count] for i in range(1, count)] if drawn else []
    if not cuts:
        return df.withColumn(CHUNK, F.lit(0)).repartitionById(1, CHUNK)
    borders = F.from_json(F.lit(f"[{','.join(cuts)}]"), f"array<{kind}>")
    halves = F.array(*[F.lit(1 << j) for j in reversed(range(len(cuts).bit_length()))])
    # Binary search: the number of borders that are not above the key.
    number = F.aggregate(halves, F.lit(0), lambda low, step: F.when(
        F.get(borders, low + step - 1) <= _key(names), low + step).otherwise(low))
    return df.withColumn(CHUNK, number).repartitionById(count, CHUNK)


def _carry(local: DataFrame, carried: DataFrame, by) -> DataFrame:
    """Join the carried values; fewer rows than chunks, so a broadcast is safe."""
    keys = [*by, CHUNK]
    right = F.broadcast(carried.select(*[F.col(k).alias(f"_r_{k}") for k in keys],
                                       *[c for c in carried.columns if c not in keys]))
    on = None
    for k in keys:
        test = F.col(k).eqNullSafe(F.col(f"_r_{k}"))
        on = test if on is None else on & test
    return local.join(right, on, "left").drop(*[f"_r_{k}" for k in keys])


def running_totals(df: DataFrame, by, order, sums: dict[str, Column], chunks: int | None = None) -> DataFrame:
    """Per row, the total of each expression over the rows before it in its group.

    ``by`` are the group columns (none = one global order) and ``order`` must
    make the order inside a group total.  The row itself is not included.
    """
    work = chunked(df.withColumns({f"_in_{n}": c for n, c in sums.items()}), by, order, chunks)
    inside = Window.partitionBy(CHUNK, *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = settle(work.withColumns({f"_l_{n}": F.sum(f"_in_{n}").over(inside) for n in sums}), "ordered")
    totals = local.groupBy(*by, CHUNK).agg(*[F.sum(f"_in_{n}").alias(f"_t_{n}") for n in sums])
    earlier = Window.partitionBy(*by).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(
        *by, CHUNK, F.count(F.lit(1)).over(earlier).alias("_before"),
        *[F.sum(f"_t_{n}").over(earlier).alias(f"_c_{n}") for n in sums],
    ).where("_before > 0").drop("_before")
    zero = {n: F.lit(0).cast(local.schema[f"_in_{n}"].dataType) for n in sums}
    return _carry(local, carried, by).select(
        *df.columns,
        *[(F.coalesce(f"_l_{n}", zero[n]) + F.coalesce(f"_c_{n}", zero[n])).alias(n) for n in sums],
    )


def row_index(df: DataFrame, by, order, name: str = "row_index", chunks: int | None = None) -> DataFrame:
    """Number of the row in its group, from 0."""
    return running_totals(df, by, order, {name: F.lit(1).cast("bigint")}, chunks)


def average_rank(df: DataFrame, by, value: str, name: str = "avg_rank", chunks: int | None = None) -> DataFrame:
    """(by, value, n, rank): mean rank of each distinct non-null value in its group, from 1.

    Equal values are counted before anything is ordered.
    """
    distinct = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("n"))
    before = running_totals(distinct, by, [value], {"_before": F.col("n")}, chunks)
    return before.select(*by, value, "n", (F.col("_before") + (F.col("n") + 1) / 2).alias(name))


def previous_value(df: DataFrame, by, order, value: str, name: str, chunks: int | None = None) -> DataFrame:
    """``value`` of the row before in the group's order, null on the first row."""
    inside = Window.partitionBy(CHUNK, *by).orderBy(*order)
    local = settle(chunked(df, by, order, chunks).withColumns(
        {"_pos": F.row_number().over(inside), "_prev": F.lag(value).over(inside)}), "ordered")
    # Held in a struct: the last row counts even when its value is null.
    last = local.groupBy(*by, CHUNK).agg(F.max_by(F.struct(F.col(value).alias("v")), "_pos").alias("_last"))
    across = Window.partitionBy(*by).orderBy(CHUNK)
    carried = last.select(*by, CHUNK, F.lag("_last").over(across).alias("_carried")).where("_carried is not null")
    return _carry(local, carried, by).select(
        *df.columns, F.when(F.col("_pos") > 1, F.col("_prev")).otherwise(F.col("_carried.v")).alias(name))


def group_quantile(df: DataFrame, by, value: str, q: float, name: str = "quantile",
                   chunks: int | None = None) -> DataFrame:
    """(by, quantile): linearly interpolated quantile of the non-null values of each group.

    Exact: the two order statistics are found by position among the counted
    distinct values, so no task has to hold the values of a group.
    """
    distinct = settle(df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("_n")))
    sizes = settle(distinct.groupBy(*by).agg(F.sum("_n").alias("_size")), "sizes")
    placed = running_totals(distinct, by, [value], {"_before": F.col("_n")}, chunks)
    joined = placed.join(sizes.select(*[F.col(b).alias(f"_s_{b}") for b in by], "_size"),
                         [F.col(b).eqNullSafe(F.col(f"_s_{b}")) for b in by])
    target = q * (F.col("_size") - 1)
    low = F.floor(target)
    high = F.least(low + 1, F.col("_size") - 1)

    def at(position: Column) -> Column:
        here = (F.col("_before") <= position) & (position < F.col("_before") + F.col("_n"))
        return F.max(F.when(here, F.col(value)))

    ends = joined.groupBy(*by).agg(at(low).alias("_a"), at(high).alias("_b"), F.max(target - low).alias("_part"))
    return ends.select(*by, (F.col("_a") + (F.col("_b") - F.col("_a")) * F.col("_part")).alias(name))
