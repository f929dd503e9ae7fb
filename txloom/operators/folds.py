"""Assignment of rows to validation folds."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from ..schema import KEY, LABEL
from ..session import settle
from .lookup import attach
from .ordered import row_index
from .sampling import portable_hash, seeded_hash


def block_fold(index: Column, n: Column, k: int) -> Column:
    """Fold of position ``index`` among ``n`` in contiguous blocks; the first n mod k blocks hold one more."""
    size, extra = F.floor(n / k), F.pmod(n, F.lit(k))
    edge = extra * (size + 1)
    late = extra + F.floor(F.try_divide((index - edge).cast("double"), size.cast("double")))
    return F.when(index < edge, F.floor(index / (size + 1))).otherwise(late).cast("int")


def _order(df: DataFrame, key: str, shuffle: bool, seed: int, portable: bool) -> tuple[DataFrame, list[str]]:
    if not shuffle:
        return df, [key]
    mark = portable_hash(key, seed) if portable else seeded_hash(key, seed)
    return df.withColumn("_mark", mark), ["_mark", key]


def kfold(df: DataFrame, k: int, key: str = KEY, shuffle: bool = False, seed: int = 0,
          portable: bool = False) -> DataFrame:
    """(key, fold): contiguous blocks in key order, or in a seeded random order."""
    keyed, order = _order(df.select(key), key, shuffle, seed, portable)
    indexed = row_index(keyed, [], order, "_index")
    return indexed.select(key, block_fold(F.col("_index"), F.lit(df.count()), k).alias("fold"))


def stratified_kfold(df: DataFrame, k: int, label: str = LABEL, key: str = KEY, shuffle: bool = False,
                     seed: int = 0, portable: bool = False, compat: bool = False) -> DataFrame:
    """(key, fold): every class is cut into k blocks on its own.

    ``compat=True`` gives plain folds, which is what the name stood for in one
    of the original entry points.
    """
    if compat:
        return kfold(df, k, key, shuffle, seed, portable)
    keyed, order = _order(df.select(key, label), key, shuffle, seed, portable)
    indexed = row_index(keyed, [label], order, "_index")
    sizes = settle(df.groupBy(label).agg(F.count(F.lit(1)).alias("_n")), "sizes")
    return attach(indexed, sizes, {label: label}, null_safe=True).select(
        key, block_fold(F.col("_index"), F.col("_n"), k).alias("fold"))


def lightest_first(histogram: list[tuple[int, int]], k: int) -> list[tuple[int, int, int, list[int]]]:
    """Runs (size, from, to, folds) that give groups, largest first, to the lightest fold.

    ``histogram`` lists (group size, number of groups of that size).  Group
    number r of a size (from <= r < to) goes to folds[(r - from) mod len].
    Groups of equal size are dealt in whole rounds, so the work depends on the
    number of different sizes and not on the number of groups.
    """
    loads, runs = [0] * k, []
    for size, groups in sorted(histogram, reverse=True):
        done = 0
        while done < groups:
            low = min(loads)
            dealt = sorted((f for f in range(k) if loads[f] < low + size), key=lambda f: (loads[f], f))
            others = [loads[f] for f in range(k) if loads[f] >= low + size]
            rounds = max(1, (min(others) - low) // size) if others else math.ceil((groups - done) / len(dealt))
            count = min(groups - done, rounds * len(dealt))
            for i, f in enumerate(dealt):
                loads[f] += size * (count // len(dealt) + (i < count % len(dealt)))
            runs.append((size, done, done + count, dealt))
            done += count
    return runs


def group_kfold(df: DataFrame, k: int, group: str, key: str = KEY) -> DataFrame:
    """(key, fold): groups stay whole; the largest group goes first, always to the lightest fold.

    Only the histogram of group sizes reaches the driver, never the groups.
    """
    sizes = df.groupBy(group).agg(F.count(F.lit(1)).alias("_size"))
    ranked = settle(row_index(sizes, ["_size"], [group], "_rank"), "groups")
    histogram = [(r["_size"], r["n"]) for r in ranked.groupBy("_size").agg(F.count(F.lit(1)).alias("n")).collect()]
    runs = settle(df.sparkSession.createDataFrame(
        lightest_first(histogram, k), "run_size bigint, run_from bigint, run_to bigint, folds array<int>"), "runs")
    inside = (F.col("_size") == F.col("run_size")) & (F.col("_rank") >= F.col("run_from")) & (
        F.col("_rank") < F.col("run_to"))
    turn = F.pmod(F.col("_rank") - F.col("run_from"), F.size("folds")).cast("int")
    folds = ranked.join(runs, inside).select(group, F.get("folds", turn).alias("fold"))
    return attach(df.select(key, group), folds, {group: group}, null_safe=True).select(key, "fold")


# Named time schemes, months numbered from 0 as (training months, validation months).
TIME_SCHEMES = {
    "train2_skip2_predict2": [((0, 1), (4, 5))],
    "train4_skip1_predict1": [((0, 1, 2, 3), (5,))],
    "train3_gap1_predict2": [((0, 1, 2), (4, 5))],
    "expanding": [((0, 1, 2, 3), (4,)), ((0, 1, 2, 3, 4), (5,)), ((0, 1, 2, 3, 4, 5), (6,))],
}


# Weights of the folds of the expanding scheme, the last one trained on all rows.
EXPANDING_WEIGHTS = {0: 0.1, 1: 0.1, 2: 0.25, 3: 0.55}


def time_folds(df: DataFrame, period: str, splits, key: str = KEY, whole: bool = False) -> DataFrame:
    """(key, fold, role) for splits given as (training periods, validation periods); map-only.

    ``whole`` adds a last fold that trains on all rows and validates none.
    """
    roles = []
    for i, (train, valid) in enumerate(splits):
        role = F.when(F.col(period).isin(*train), "train").when(F.col(period).isin(*valid), "valid")
        roles.append(F.struct(F.lit(i).alias("fold"), role.alias("role")))
    if whole:
        roles.append(F.struct(F.lit(len(splits)).alias("fold"), F.lit("train").alias("role")))
    return df.select(key, F.explode(F.array(*roles)).alias("_f")).select(key, "_f.fold", "_f.role").where(
        F.col("role").isNotNull())
