"""Checked queries: aggregates, group features, set operations and sampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.correlation import correlated_later, spearman_pairs
from ..operators.encoders import label_codes, pooled_values
from ..operators.groupstats import (
    GROUP_RATIOS, frequency_table, group_broadcast, group_ratios, group_stats, user_stats,
)
from ..operators.metrics import auc, errors
from ..operators.narrow import cast_to, column_counts, null_counts
from ..operators.sampling import downsample_negatives
from ..operators.training import mean_score
from ..schema import KEY, SPLIT
from ..sources.tables import union_splits
from .fixtures import IDENTITY, joined, oof, sql, table, tx, vmat
from .registry import query
from .tools import tidy


@query("d1_frequency_table", sql(
    "select 'card2' as \"column\", cast(card2 as varchar) as v, count(*) as n from tx group by card2 union all "
    "select 'card4', card4, count(*) from tx group by card4", "tx"))
def d1(spark, folder):
    counts = frequency_table(tx(spark, folder), ["card2", "card4"])
    return counts.select("column", F.regexp_replace("value", r"\.0$", "").alias("v"), "n")


@query("d2_grouped_count", sql("select card2, count(D15) as n from tx where card2 is not null group by card2", "tx"))
def d2(spark, folder):
    rows = tx(spark, folder)
    stats = group_stats(rows, ["card2"], ["D15"], ["count"])
    return stats.select(F.col("value").cast("double").cast("bigint").alias("card2"), F.col("D15_count").alias("n"))


@query("d3_grouped_mean", sql("select card4, round(avg(TransactionAmt), 6) as m from tx where card4 is not null "
                              "group by card4", "tx"))
def d3(spark, folder):
    stats = group_stats(tx(spark, folder), ["card4"], ["TransactionAmt"], ["mean"])
    return tidy(stats.select(F.col("value").alias("card4"), F.col("TransactionAmt_mean").alias("m")))


@query("d4_grouped_std", sql("select card1, round(stddev_samp(TransactionAmt), 6) as s from tx group by card1", "tx"))
def d4(spark, folder):
    stats = group_stats(tx(spark, folder), ["card1"], ["TransactionAmt"], ["std"])
    return tidy(stats.select(F.col("value").cast("double").cast("bigint").alias("card1"),
                             F.col("TransactionAmt_std").alias("s")))


_COUNTED = ["card1", "card2", "card4", "dist1", "R_emaildomain", "D8"]


@query("d5_distinct_counts", sql(" union all ".join(
    f"select '{c}' as \"column\", count(distinct {c}) + max(case when {c} is null then 1 else 0 end) as distincts, "
    f"count(distinct {c}) as distincts_not_null from tx" for c in _COUNTED), "tx"))
def d5(spark, folder):
    return column_counts(tx(spark, folder), _COUNTED).select("column", "distincts", "distincts_not_null")


@query("d6_null_counts", sql(" union all ".join(
    f"select '{c}' as \"column\", count(*) filter ({c} is null) as nulls from joined" for c in [*_COUNTED, *IDENTITY]),
    "joined"))
def d6(spark, folder):
    return null_counts(joined(spark, folder), [*_COUNTED, *IDENTITY])


@query("d7_column_means", sql("select round(avg(TransactionAmt), 6) as TransactionAmt, round(avg(D15), 6) as D15, "
                              "round(avg(dist1), 6) as dist1 from tx", "tx"))
def d7(spark, folder):
    return tidy(tx(spark, folder).agg(*[F.avg(c).alias(c) for c in ("TransactionAmt", "D15", "dist1")]))


@query("d8_cast_difference", sql(
    "select round(max(abs(cast(cast(TransactionAmt as float) as double) - TransactionAmt)), 9) as max_gap, "
    "round(avg(abs(cast(cast(TransactionAmt as float) as double) - TransactionAmt)), 9) as mean_gap from tx", "tx"))
def d8(spark, folder):
    rows = tx(spark, folder).select("TransactionAmt", F.col("TransactionAmt").alias("tried"))
    gap = F.abs(F.col("tried").cast("double") - F.col("TransactionAmt"))
    return tidy(cast_to(rows, {"tried": "float"}).agg(F.max(gap).alias("max_gap"), F.avg(gap).alias("mean_gap")), 9)


@query("d9_pooled_values", sql("select distinct v from (select P_emaildomain as v from tx union all select R_emaildomain "
                               "from tx union all select card4 from tx) where v is not null", "tx"))
def d9(spark, folder):
    return pooled_values(tx(spark, folder), ["P_emaildomain", "R_emaildomain", "card4"]).select(
        F.col("value").alias("v"))


def long_sql(source: str, columns, key: str) -> str:
    """(id, pos, col, x) rows of the listed columns, null values left out."""
    return " union all ".join(f"select {key} as id, {i} as pos, '{c}' as col, cast({c} as double) as x from {source} "
                              f"where {c} is not null" for i, c in enumerate(columns))


def spearman_sql(long: str, extra: str = "") -> str:
    """Pairwise complete rank correlation of a long table, by ranking each pair anew."""
    return f"""select col_i, col_j, pos_i, pos_j, count(*) as n, corr(ri, rj) as rho from (
      select col_i, col_j, pos_i, pos_j,
        rank() over (partition by pos_i, pos_j order by xi) + (count(*) over (partition by pos_i, pos_j, xi) - 1) / 2.0 as ri,
        rank() over (partition by pos_i, pos_j order by xj) + (count(*) over (partition by pos_i, pos_j, xj) - 1) / 2.0 as rj
      from (select a.col as col_i, b.col as col_j, a.pos as pos_i, b.pos as pos_j, a.x as xi, b.x as xj
            from {long} a join {long} b on a.id = b.id and a.pos < b.pos {extra}) p) r
      group by col_i, col_j, pos_i, pos_j"""


_VCOLS = [f"V{i}" for i in range(1, 68)]


@query("d10_spearman", sql(f"+ long as ({long_sql('vmat', _VCOLS, 'vec_id')}) select col_i, col_j, n, round(rho, 6) "
                           f"as rho from ({spearman_sql('long')})", "vmat"))
def d10(spark, folder):
    return tidy(spearman_pairs(vmat(spark, folder), _VCOLS))


def auc_sql(source: str, by: str, score: str = "prediction", label: str = "label") -> str:
    part = f"partition by {by} " if by else ""
    tie = f"partition by {by}, {score}" if by else f"partition by {score}"
    group = f"group by {by}" if by else ""
    cols = f"{by}, " if by else ""
    return f"select {cols}(sum(case when {label} = 1 then r end) - sum({label}) * (sum({label}) + 1) / 2.0) / " \
           f"(sum({label}) * sum(1 - {label})) as auc from (select {cols}{label}, rank() over ({part}order by {score}) " \
           f"+ (count(*) over ({tie}) - 1) / 2.0 as r from {source}) z {group}"


@query("d11_auc", sql(f"select model, fold, round(auc, 6) as auc from ({auc_sql('oof', 'model, fold')})", "oof"))
def d11(spark, folder):
    return tidy(auc(oof(spark, folder), by=["model", "fold"]))


@query("d12_weighted_errors", sql(
    "select model, round(sum(w * pow(prediction - label, 2)) / sum(w), 6) as mse, round(sum(w * abs(prediction - label)) "
    "/ sum(w), 6) as mae, round(sum(w * case when (prediction > 0.5) = (label = 1) then 1 else 0 end) / sum(w), 6) as "
    "accuracy from (select *, cast(1 + TransactionID % 3 as double) as w from oof) group by model", "oof"))
def d12(spark, folder):
    rows = oof(spark, folder).withColumn("w", 1.0 + F.col(KEY) % 3)
    return tidy(errors(rows, by=["model"], weight="w"))


@query("d13_mean_fold_score", sql(f"select model, round(avg(auc), 6) as auc from ({auc_sql('oof', 'model, fold')}) "
                                  "group by model", "oof"))
def d13(spark, folder):
    folds = auc(oof(spark, folder), by=["model", "fold"], name="valid_auc")
    return tidy(mean_score(folds))


def _over(agg: str, v: str, k: str, part: str) -> str:
    return f"case when {k} is not null then {agg}({v}) over (partition by {part}{k}) end"


@query("e1_group_mean", sql(
    f"select TransactionID, round({_over('avg', 'TransactionAmt', 'card4', 'split, ')}, 6) as m from tx", "tx"))
def e1(spark, folder):
    rows = tx(spark, folder).select(KEY, SPLIT, "card4", "TransactionAmt")
    out = group_broadcast(rows, "card4", ["TransactionAmt"], ["mean"])
    return tidy(out.select(KEY, F.col("TransactionAmt_mean_card4").alias("m")))


@query("e2_group_std", sql(
    f"select TransactionID, round({_over('stddev_samp', 'D15', 'card1', 'split, ')}, 6) as s from tx", "tx"))
def e2(spark, folder):
    rows = tx(spark, folder).select(KEY, SPLIT, "card1", "D15")
    return tidy(group_broadcast(rows, "card1", ["D15"], ["std"]).select(KEY, F.col("D15_std_card1").alias("s")))


RATIO_SQL = ", ".join(
    f"round({v} / nullif({_over(f, v, k, 'split, ')}, 0), 6) as {v}_to_{s}_{k}"
    for v, k in GROUP_RATIOS for s, f in (("mean", "avg"), ("std", "stddev_samp")))


@query("e3_group_ratios", sql(f"select TransactionID, {RATIO_SQL} from joined", "joined"))
def e3(spark, folder):
    rows = joined(spark, folder).select(KEY, SPLIT, "TransactionAmt", "id_02", "D15", "card1", "card4", "addr1")
    out = group_ratios(rows)
    return tidy(out.select(KEY, *[c for c in out.columns if "_to_" in c]))


_SOME_ID = f"coalesce({', '.join(f'cast({c} as varchar)' for c in IDENTITY)}) is not null"
_BY_ID = f"over (partition by {', '.join(IDENTITY)})"
USER_SQL = f"case when {_SOME_ID} then count(*) {_BY_ID} end as user_trx_cnt, round(case when {_SOME_ID} then " \
           f"avg(TransactionAmt) {_BY_ID} end, 6) as user_TransactionAmt_mean, round(case when {_SOME_ID} then " \
           f"stddev_samp(TransactionAmt) {_BY_ID} end, 6) as user_TransactionAmt_std"


@query("e4_user_stats", sql(f"select TransactionID, {USER_SQL} from joined", "joined"))
def e4(spark, folder):
    rows = joined(spark, folder).select(KEY, "TransactionDT", "TransactionAmt", *IDENTITY)
    return tidy(user_stats(rows, IDENTITY).drop("TransactionDT", "TransactionAmt", *IDENTITY))


# With all identity columns most users have few rows; these four are shared by many.
_SHARED = ["id_20", "id_30", "id_33", "id_35"]


@query("e4_shared_user_stats", sql("select TransactionID, " + USER_SQL.replace(", ".join(IDENTITY), ", ".join(_SHARED)).replace(
    _SOME_ID, f"coalesce({', '.join(f'cast({c} as varchar)' for c in _SHARED)}) is not null") + " from joined", "joined"))
def e4_shared(spark, folder):
    rows = joined(spark, folder).select(KEY, "TransactionDT", "TransactionAmt", *_SHARED)
    return tidy(user_stats(rows, _SHARED).drop("TransactionDT", "TransactionAmt", *_SHARED))


@query("f1_union_by_name", sql("select TransactionID, split, card1, case when split = 'train' then isFraud end as isFraud "
                               "from tx", "tx"))
def f1(spark, folder):
    rows = tx(spark, folder).select(KEY, SPLIT, "card1", "isFraud")
    return union_splits(rows.where("split = 'train'").drop(SPLIT), rows.where("split = 'test'").drop(SPLIT, "isFraud"))


@query("f2_values_without_one", sql("select distinct v from (select P_emaildomain as v from tx union all select "
                                    "R_emaildomain from tx) where v is not null and v <> 'gmail.com'", "tx"))
def f2(spark, folder):
    return pooled_values(tx(spark, folder), ["P_emaildomain", "R_emaildomain"], "gmail.com").select(
        F.col("value").alias("v"))


@query("f3_sorted_codes", sql(
    "select 'card1' as \"column\", cast(card1 as varchar) as v, dense_rank() over (order by card1) - 1 as code from "
    "(select distinct card1 from tx) union all select 'ProductCD', ProductCD, dense_rank() over (order by ProductCD) - "
    "1 from (select distinct ProductCD from tx)", "tx"))
def f3(spark, folder):
    codes = label_codes(tx(spark, folder), ["card1", "ProductCD"])
    return codes.select("column", F.regexp_replace("value", r"\.0$", "").alias("v"), "code")


@query("f4_negative_sampling", sql(
    "+ ranked as (select TransactionID, isFraud, row_number() over (partition by isFraud order by "
    "(TransactionID % 10007 * 7919 + 3 * 104729) % 10007, TransactionID) as rn, count(*) over (partition by isFraud) as "
    "n from tx) select TransactionID, isFraud from ranked where isFraud = 1 or rn <= round_even(0.2 * n, 0)", "tx"))
def f4(spark, folder):
    return downsample_negatives(tx(spark, folder).select(KEY, "isFraud"), 0.2, seed=3, portable=True)


@query("f5_correlated_later", sql(
    f"+ long as ({long_sql('vmat', _VCOLS, 'vec_id')}) select distinct col_j as \"column\" from "
    f"({spearman_sql('long')}) where abs(rho) > 0.99", "vmat"))
def f5(spark, folder):
    return correlated_later(spearman_pairs(vmat(spark, folder), _VCOLS))


@query("panel_group_ratios", "with p as (select l_partkey, l_returnflag, l_extendedprice as v from lineitem) "
       "select l_partkey, count(*) as n, round(sum(v / nullif(m, 0)), 6) as total_to_mean, round(max(v / nullif(s, "
       "0)), 6) as top_to_std from (select l_partkey, v, avg(v) over (partition by l_returnflag, l_partkey) as m, "
       "stddev_samp(v) over (partition by l_returnflag, l_partkey) as s from p) group by l_partkey")
def panel(spark, folder):
    """Ratios to group statistics on the largest table."""
    rows = table(spark, folder, "lineitem").select("l_partkey", "l_returnflag", F.col("l_extendedprice").alias("v"))
    out = group_ratios(rows, [("v", "l_partkey")], ["l_returnflag"])
    return tidy(out.groupBy("l_partkey").agg(
        F.count(F.lit(1)).alias("n"), F.sum("v_to_mean_l_partkey").alias("total_to_mean"),
        F.max("v_to_std_l_partkey").alias("top_to_std")))
