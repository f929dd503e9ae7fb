"""Checked queries: client histories, interactions, evidence, time splits and post-processing."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F
from pyspark.ml.functions import vector_to_array

from ..functions.dates import DAY, day_number, is_december, month_index
from ..functions.rows import interactions, joined_text, missing_pattern, row_extreme, row_extreme_column
from ..operators import blend
from ..operators.clients import (
    CLIENT_KEYS, client_id, client_quality, client_stats, mark_seen, past_target_mean, previous_label, reference_day,
    seen_rows, seen_share, sequence_features, trailing_activity,
)
from ..operators.correlation import kolmogorov_smirnov, spearman_pairs
from ..operators.encoders import category_limit, evidence_encode, one_hot
from ..operators.folds import TIME_SCHEMES, time_folds
from ..operators.groupstats import count_encode
from ..operators.impute import impute
from ..schema import KEY
from ..session import settle
from .fixtures import MODELS, joined, oof, sql, tx
from .groups import auc_sql, long_sql, spearman_sql
from .registry import query
from .tools import tidy

_REF = "cast(floor(TransactionDT / 86400) as bigint) - D1"


@query("k1_reference_day", sql(f"select TransactionID, {_REF} as reference_day from tx", "tx"))
def k1(spark, folder):
    return tidy(tx(spark, folder).select(KEY, reference_day().alias("reference_day")))


def text_sql(*columns: str) -> str:
    return " || '_' || ".join(f"coalesce(cast({c} as varchar), 'nan')" for c in columns)


@query("k2_client_id", sql(
    f"select TransactionID, {text_sql('card1', 'card6', 'addr1', 'addr2', 'reference_day')} as client from (select *, "
    f"{_REF} as reference_day from tx) t", "tx"))
def k2(spark, folder):
    rows = tx(spark, folder).withColumn("reference_day", reference_day())
    return rows.select(KEY, client_id(rows, CLIENT_KEYS["cards_and_addresses"]).alias("client"))


def with_client(spark, folder):
    """Transactions with a client column; there are about 150 clients at the smaller scales."""
    return tx(spark, folder).withColumn("client", F.col("card1"))


_PREV = "select TransactionID, isFraud, lag(isFraud) over (partition by card1 order by TransactionDT, TransactionID) as " \
        "previous_isfraud from tx"


@query("k3_previous_label", sql(_PREV, "tx"))
def k3(spark, folder):
    rows = with_client(spark, folder).select(KEY, "TransactionDT", "client", "isFraud")
    return previous_label(rows, "client").select(KEY, "isFraud", "previous_isfraud")


@query("k3_client_quality", sql(f"select previous_isfraud, round(avg(isFraud), 6) as mean_label, count(*) as n from "
                                f"({_PREV}) where previous_isfraud is not null group by previous_isfraud", "tx"))
def k3_quality(spark, folder):
    return tidy(client_quality(with_client(spark, folder), "client"))


_STAT = {"count": "count({})", "mean": "round(avg({}), 6)", "var": "round(var_samp({}), 6)"}


@query("k4_client_stats", sql("select TransactionID, " + ", ".join(
    f"{f.format(v).replace(v + ')', v + ') over (partition by card1)', 1)} as {v}_{s}_client"
    for v in ("TransactionAmt", "C1", "D15") for s, f in _STAT.items()) + " from tx", "tx"))
def k4(spark, folder):
    rows = with_client(spark, folder).select(KEY, "client", "TransactionAmt", "C1", "D15")
    out = client_stats(rows, "client", ["TransactionAmt", "C1", "D15"])
    return tidy(out.drop("client", "TransactionAmt", "C1", "D15"))


_SIMILAR = ["C1", "C2", "D11", "D15"]


@query("k5_row_extremes", sql(
    f"select TransactionID, cast(greatest({', '.join(_SIMILAR)}) as double) as top, "
    f"cast(least({', '.join(_SIMILAR)}) as double) as low, case " + " ".join(
        f"when {c} = greatest({', '.join(_SIMILAR)}) then '{c}'" for c in _SIMILAR) + " end as top_column, case " +
    " ".join(f"when {c} = least({', '.join(_SIMILAR)}) then '{c}'" for c in _SIMILAR) + " end as low_column from tx", "tx"))
def k5(spark, folder):
    return tx(spark, folder).select(
        KEY, row_extreme(_SIMILAR).alias("top"), row_extreme(_SIMILAR, False).alias("low"),
        row_extreme_column(_SIMILAR).alias("top_column"), row_extreme_column(_SIMILAR, False).alias("low_column"))


_HOLES = ["card2", "card4", "card5", "addr1", "addr2", "dist1", "D8", "D11", "D15"]
_HOLES_SQL = " || ".join(f"case when {c} is null then '1' else '0' end" for c in _HOLES)


@query("k6_missing_pattern", sql(f"select TransactionID, {_HOLES_SQL} as pattern, count(*) over (partition by {_HOLES_SQL}) "
                                 "as pattern_count from tx", "tx"))
def k6(spark, folder):
    rows = tx(spark, folder)
    coded = rows.select(KEY, missing_pattern(rows, _HOLES).alias("pattern"))
    return count_encode(coded, ["pattern"], "_count")


@query("k7_december_flag", sql("select TransactionID, cast(month(date '2017-11-15' + cast(floor(TransactionDT / 86400) as "
                               "integer)) = 12 as bigint) as is_december from tx", "tx"))
def k7(spark, folder):
    return tidy(tx(spark, folder).select(KEY, is_december(start="2017-11-15 00:00:00").alias("is_december")))


@query("k9_sequence_features", sql(
    "select TransactionID, row_number() over w as seq_position, count(*) over p as seq_length, round(row_number() over w / "
    "cast(count(*) over p as double), 6) as seq_share, TransactionDT - min(TransactionDT) over p as since_first, "
    "max(TransactionDT) over p - TransactionDT as to_last from tx window p as (partition by card1), w as (partition by "
    "card1 order by TransactionDT, TransactionID)", "tx"))
def k9(spark, folder):
    rows = with_client(spark, folder).select(KEY, "TransactionDT", "client")
    return tidy(sequence_features(rows, "client").drop("TransactionDT", "client"))


_LOOK = {"day": 1, "week": 7, "month": 30}


@query("k10_trailing_activity", sql("select TransactionID, " + ", ".join(
    f"count(*) over w{n} as prev_{n}_count, round(coalesce(sum(TransactionAmt) over w{n}, 0), 6) as prev_{n}_amount"
    for n in _LOOK) + " from tx window " + ", ".join(
        f"w{n} as (partition by card1 order by TransactionDT range between {d * DAY} preceding and 1 preceding)"
        for n, d in _LOOK.items()), "tx"))
def k10(spark, folder):
    rows = with_client(spark, folder).select(KEY, "TransactionDT", "client", "TransactionAmt")
    return tidy(trailing_activity(rows, "client").drop("TransactionDT", "client", "TransactionAmt"))


@query("k11_past_target_mean", sql(
    "select TransactionID, case when card4 is not null then round(avg(isFraud) over (partition by card4 order by "
    "TransactionDT, TransactionID rows between unbounded preceding and 1 preceding), 6) end as card4_past_mean from tx", "tx"))
def k11(spark, folder):
    rows = tx(spark, folder).select(KEY, "TransactionDT", "card4", "isFraud")
    return tidy(past_target_mean(rows, "card4").select(KEY, "card4_past_mean"))


@query("k12_impute_with_flag", sql(
    "+ m as (select avg(D15) as a from tx where split = 'train') select TransactionID, round(coalesce(D15, (select a from "
    "m)), 6) as D15, cast(D15 is null as bigint) as D15_missing from tx", "tx"))
def k12(spark, folder):
    out = impute(tx(spark, folder).select(KEY, "split", "D15"), ["D15"], indicator=True)
    return tidy(out.drop("split"))


@query("k12_impute_median", sql(
    "+ m as (select median(D15) as a, median(dist1) as b from tx where split = 'train') select TransactionID, "
    "coalesce(cast(D15 as double), (select a from m)) as D15, coalesce(dist1, (select b from m)) as dist1, cast(D15 is null "
    "as bigint) as D15_missing, cast(dist1 is null as bigint) as dist1_missing from tx", "tx"))
def k12_median(spark, folder):
    out = impute(tx(spark, folder).select(KEY, "split", "D15", "dist1"), ["D15", "dist1"], "median", indicator=True)
    return tidy(out.drop("split"))


@query("k13_frequency_bounds", sql(
    "+ ok as (select R_emaildomain, count(*) as n from tx where split = 'train' and R_emaildomain is not null group by "
    "R_emaildomain having count(*) > 100), ok2 as (select C3 from tx where split = 'train' group by C3 having count(*) > "
    "100 and count(*) <= 665) select TransactionID, case when R_emaildomain in (select R_emaildomain from ok) then "
    "R_emaildomain else 'unknown' end as R_emaildomain, case when C3 in (select C3 from ok2) then cast(C3 as varchar) else "
    "'unknown' end as C3 from tx", "tx"))
def k13(spark, folder):
    rows = tx(spark, folder).select(KEY, "split", "R_emaildomain", "C3")
    low = category_limit(rows, ["R_emaildomain"], 100, both=False)
    return category_limit(low, ["C3"], 100, 665, both=False).drop("split")


def _woe_sql(c: str) -> str:
    return f"w_{c} as (select {c}, ln((sum(isFraud) + 0.5) / (sum(1 - isFraud) + 0.5)) - (select ln((sum(isFraud) + 0.5) / " \
           f"(sum(1 - isFraud) + 0.5)) from tx where split = 'train') as w from tx where split = 'train' and {c} is not " \
           f"null group by {c})"


@query("k14_weight_of_evidence", sql(
    f"+ {_woe_sql('card4')}, {_woe_sql('card2')} select TransactionID, round(coalesce(w_card4.w, 0), 6) as card4_woe, "
    "round(coalesce(w_card2.w, 0), 6) as card2_woe from tx left join w_card4 on tx.card4 = w_card4.card4 left join w_card2 "
    "on tx.card2 = w_card2.card2", "tx"))
def k14(spark, folder):
    rows = tx(spark, folder).select(KEY, "split", "isFraud", "card4", "card2")
    return tidy(evidence_encode(rows, ["card4", "card2"], fit_on=F.col("split") == "train").select(
        KEY, "card4_woe", "card2_woe"))


_INTER = ["card4", "card6", "addr1", "ProductCD"]


@query("k15_interactions", sql("select TransactionID, " + ", ".join(
    f"{text_sql(*c)} as {'__'.join(c)}" for n in (2, 3, 4) for c in combinations(_INTER, n)) + " from tx", "tx"))
def k15(spark, folder):
    out = tx(spark, folder).select(KEY, *_INTER)
    for size in (2, 3, 4):
        out = interactions(out, _INTER, size)
    return out.drop(*_INTER)


@query("k16_one_hot_counts", sql(
    "+ c as (select TransactionID, count(*) over (partition by card6) as n from tx), x as (select distinct n from c) "
    "select TransactionID, (select count(*) from x where cast(cast(x.n as varchar) || '.0' as varchar) < cast(c.n as "
    "varchar) || '.0') as hot from c", "tx"))
def k16(spark, folder):
    counts = count_encode(tx(spark, folder).select(KEY, "card6"), ["card6"], "_n")
    hot = one_hot(counts, ["card6_n"])
    return hot.select(KEY, (F.array_position(vector_to_array("card6_n_onehot"), 1.0) - 1).cast("bigint").alias("hot"))


_TESTED = ["C1", "C2", "C3", "D1", "D8", "D11", "D15", "TransactionAmt", "dist1"]


@query("k17_target_spearman", sql(
    f"+ long as ({long_sql('tx', [*_TESTED, 'isFraud'], 'TransactionID')}) select col_i as \"column\", n, round(rho, 6) as "
    f"rho from ({spearman_sql('long', chr(97) + 'nd b.pos = ' + str(len(_TESTED)))})", "tx"))
def k17(spark, folder):
    rows = tx(spark, folder).select(KEY, "isFraud", *_TESTED)
    pairs = spearman_pairs(rows, _TESTED, target="isFraud")
    return tidy(pairs.select(F.col("col_i").alias("column"), "n", "rho"))


@query("k17_kolmogorov_smirnov", sql(
    f"+ long as ({long_sql('tx', _TESTED, 'TransactionID')}), g as (select col, x, sum(isFraud) as p, sum(1 - isFraud) as n "
    "from long join tx on id = TransactionID group by col, x) select col as \"column\", round(max(abs(cp / tp - cn / tn)), "
    "6) as ks from (select col, sum(p) over (partition by col order by x) as cp, sum(n) over (partition by col order by x) "
    "as cn, cast(sum(p) over (partition by col) as double) as tp, cast(sum(n) over (partition by col) as double) as tn "
    "from g) group by col", "tx"))
def k17_ks(spark, folder):
    return tidy(kolmogorov_smirnov(tx(spark, folder), _TESTED, "isFraud"))


_PERIOD = "cast(floor((TransactionDT - 86400) / 432000) as bigint)"


def _fold_sql() -> str:
    parts, i = [], 0
    for splits in TIME_SCHEMES.values():
        for train, valid in splits:
            for role, months in (("train", train), ("valid", valid)):
                parts.append(f"select TransactionID, {i} as fold, '{role}' as role from t where period in "
                             f"({', '.join(map(str, months))})")
            i += 1
    return " union all ".join(parts)


@query("k18_time_folds", sql(f"+ t as (select TransactionID, {_PERIOD} as period from tx) " + _fold_sql().replace(
    " as fold", "::bigint as fold"), "tx"))
def k18(spark, folder):
    """All named schemes, with spans of five days in place of months."""
    rows = tx(spark, folder).select(KEY, F.floor((F.col("TransactionDT") - DAY) / (5 * DAY)).alias("period"))
    return tidy(time_folds(rows, "period", [s for splits in TIME_SCHEMES.values() for s in splits]))


def with_rare_client(spark, folder):
    """Clients named by four columns: some occur in one split only."""
    rows = tx(spark, folder)
    return rows.withColumn("client", joined_text(rows, ["card1", "card2", "card5"]))


_RARE = f"+ t as (select *, {text_sql('card1', 'card2', 'card5')} as client from tx) "


@query("k19_seen_clients", sql(
    _RARE + "select TransactionID, client, 'seen' as part from t where split = 'test' and client in (select client from t "
    "where split = 'train') union all select TransactionID, client, 'new' from t where split = 'test' and client not in "
    "(select client from t where split = 'train')", "tx"))
def k19(spark, folder):
    rows = with_rare_client(spark, folder)
    return seen_rows(rows, "client").select(KEY, "client", F.lit("seen").alias("part")).unionByName(
        seen_rows(rows, "client", False).select(KEY, "client", F.lit("new").alias("part")))


@query("k19_seen_share", sql(
    _RARE + "select day, count(*) as clients, round(avg(s), 6) as seen_share from (select distinct cast(floor(TransactionDT "
    "/ 86400) as bigint) as day, client, case when client in (select client from t where split = 'train') then 1.0 else "
    "0.0 end as s from t where split = 'test') group by day", "tx"))
def k19_share(spark, folder):
    rows = with_rare_client(spark, folder).withColumn("day", day_number())
    return tidy(seen_share(rows, "client", "day"))


@query("k20_mean_blend", sql("select TransactionID, round(avg(prediction), 6) as prediction from oof group by "
                             "TransactionID", "oof"))
def k20_mean(spark, folder):
    return tidy(blend.mean_blend(oof(spark, folder)))


@query("k20_geometric_blend", sql("select TransactionID, round(exp(avg(ln(prediction))), 6) as prediction from oof group by "
                                  "TransactionID", "oof"))
def k20_geometric(spark, folder):
    return tidy(blend.geometric_blend(oof(spark, folder)))


_WEIGHTS = {"m1": 0.4, "m2": 0.4, "m3": 0.2}


@query("k20_weighted_blend", sql(
    "select TransactionID, round(sum(prediction * case model when 'm1' then 0.4 when 'm2' then 0.4 else 0.2 end), 6) as "
    "prediction from oof group by TransactionID", "oof"))
def k20_weighted(spark, folder):
    return tidy(blend.weighted_blend(oof(spark, folder), _WEIGHTS))


@query("k20_rank_blend", sql(
    "select TransactionID, round(avg(r), 6) as prediction from (select TransactionID, (rank() over (partition by model order "
    "by prediction) + (count(*) over (partition by model, prediction) - 1) / 2.0) / count(*) over (partition by model) as r "
    "from oof) group by TransactionID", "oof"))
def k20_rank(spark, folder):
    return tidy(blend.rank_blend(oof(spark, folder)))


def wide_scores(spark, folder):
    """One row per transaction: client, split, label and the three model scores."""
    wide = blend.wide_predictions(oof(spark, folder), MODELS, [KEY])
    return with_rare_client(spark, folder).select(KEY, "split", "client", "isFraud", "card1").join(wide, KEY)


_WIDE = _RARE + ", w as (select t.*, a.prediction as m1, b.prediction as m2, c.prediction as m3 from t join oof a on " \
                "a.TransactionID = t.TransactionID and a.model = 'm1' join oof b on b.TransactionID = t.TransactionID and " \
                "b.model = 'm2' join oof c on c.TransactionID = t.TransactionID and c.model = 'm3') "


@query("k21_rank_fusion", sql(
    _WIDE + ", s as (select TransactionID, m1, m2, client in (select client from t where split = 'train') as seen from w "
    "where split = 'test'), o as (select *, row_number() over (order by m1, TransactionID) - 1 as r from s), u as (select "
    "*, row_number() over (order by m1, TransactionID) as a, row_number() over (order by m2, TransactionID) as b from o "
    "where not seen) select TransactionID, r as fused_rank from o where seen union all select x.TransactionID, y.r from u x "
    "join u y on x.b = y.a", "oof", "tx"))
def k21(spark, folder):
    rows = mark_seen(wide_scores(spark, folder), "client").where("split = 'test'")
    return blend.rank_fused(rows, "seen", "m1", "m2")


@query("k22_client_mean", sql(_WIDE + "select TransactionID, round(avg(m1) over (partition by card1), 6) as prediction from "
                              "w", "oof", "tx"))
def k22_mean(spark, folder):
    rows = wide_scores(spark, folder).select(KEY, F.col("card1").alias("client"), F.col("m1").alias("prediction"))
    return tidy(blend.smooth_by_client(rows, "client").select(KEY, "prediction"))


@query("k22_client_quantile", sql(
    _WIDE + "select TransactionID, round(q, 6) as prediction from w join (select card1, quantile_cont(m1, 0.9) as q from w "
    "group by card1) using (card1)", "oof", "tx"))
def k22_quantile(spark, folder):
    rows = wide_scores(spark, folder).select(KEY, F.col("card1").alias("client"), F.col("m1").alias("prediction"))
    return tidy(blend.smooth_by_client(rows, "client", "quantile").select(KEY, "prediction"))


_LABELS = ", l as (select client, min(isFraud) as lo, max(isFraud) as hi from w where split = 'train' group by client) "


@query("k23_override_known", sql(
    _WIDE + _LABELS + "select TransactionID, round(case when split = 'test' and lo = hi then cast(hi as double) else m1 end, "
    "6) as prediction from w left join l using (client)", "oof", "tx"))
def k23(spark, folder):
    rows = wide_scores(spark, folder).withColumnRenamed("m1", "prediction")
    return tidy(blend.override_known(rows, "client").select(KEY, "prediction"))


@query("k24_raise_known", sql(
    _WIDE + _LABELS + "select TransactionID, round(case when split = 'test' and hi = 1 then m1 * 1.2 else m1 end, "
    "6) as prediction from w left join l using (client)", "oof", "tx"))
def k24(spark, folder):
    rows = wide_scores(spark, folder).withColumnRenamed("m1", "prediction")
    return tidy(blend.raise_known(rows, "client", 1.2).select(KEY, "prediction"))


@query("k25_pseudo_labels", sql(
    _WIDE + "select TransactionID, cast(isFraud as double) as isFraud, false as pseudo from w where split = 'train' union all "
    "select TransactionID, case when m1 >= 0.8 then 1 else 0 end, true from w where split = 'test' and (m1 <= 0.2 or m1 >= "
    "0.8)", "oof", "tx"))
def k25(spark, folder):
    rows = wide_scores(spark, folder).withColumnRenamed("m1", "prediction")
    return blend.confident_rows(rows, 0.2, 0.8).select(KEY, "isFraud", "pseudo")


_STEP1 = f"s1 as (select model, auc from ({auc_sql('oof', 'model')}) order by auc desc, model desc limit 1)"
_STEP2 = "p2 as (select b.model, b.label, (a.prediction + b.prediction) / 2 as prediction from oof a join oof b using " \
         "(TransactionID) where a.model = (select model from s1))"


@query("k27_hill_climb", sql(
    f"+ {_STEP1}, {_STEP2}, s2 as (select model, auc from ({auc_sql('p2', 'model')}) order by auc desc, model desc limit 1) "
    "select 0::bigint as step, model, round(auc, 6) as auc from s1 union all select 1::bigint, model, round(auc, 6) from s2 "
    "where auc > (select auc from s1)", "oof"))
def k27(spark, folder):
    picked, scores = blend.hill_climb(oof(spark, folder), MODELS, steps=2)
    made = spark.createDataFrame(list(enumerate(zip(picked, scores))), "step bigint, best struct<model string, auc double>")
    return tidy(made.select("step", "best.model", "best.auc"))


_CLIMB = 10


def climb_sql(part: str) -> str:
    """CTEs and rows of a climb over the rows of one part, all its steps."""
    w = f"w_{part}"
    out = [f"{w} as (select model, TransactionID, label, prediction from oof join part using (TransactionID) where part = '{part}'), "
           f"total_{part}_0 as (select TransactionID, cast(0 as double) as total from {w} where model = 'm1')"]
    for k in range(1, _CLIMB + 1):
        before = "where isfinite(auc)" if k == 1 else f"where auc > (select auc from step_{part}_{k - 1})"
        out.append(
            f"tried_{part}_{k} as (select model, label, (total + prediction) / {k} as prediction from {w} join total_{part}_{k - 1} using (TransactionID)), "
            f"step_{part}_{k} as (select model, auc from (select * from ({auc_sql(f'tried_{part}_{k}', 'model')}) order by auc desc, model desc limit 1) "
            f"{before}), "
            f"total_{part}_{k} as (select TransactionID, total + prediction as total from {w} join total_{part}_{k - 1} using (TransactionID) "
            f"where model = (select model from step_{part}_{k}))")
    return ", ".join(out)


@query("k27_climb_by_part", sql(
    _RARE + ", part as (select TransactionID, case when client in (select client from t where split = 'train') then 'seen' else 'new' end as part "
    "from t where split = 'test'), " + ", ".join(climb_sql(p) for p in ("seen", "new")) + " "
    + " union all ".join(f"select '{p}' as part, {k - 1}::bigint as step, model, round(auc, 6) as auc from step_{p}_{k}"
                         for p in ("seen", "new") for k in range(1, _CLIMB + 1)), "oof", "tx"))
def k27_parts(spark, folder):
    """Rows of clients that training has seen and rows of new ones get weights of their own; both climbs run to their end."""
    rows = with_rare_client(spark, folder)
    parts = settle(seen_rows(rows, "client").select(KEY, F.lit("seen").alias("part")).unionByName(
        seen_rows(rows, "client", False).select(KEY, F.lit("new").alias("part"))), "parts")
    scored = oof(spark, folder).join(parts, KEY)
    out = []
    for part in ("seen", "new"):
        picked, scores = blend.hill_climb(scored, MODELS, steps=_CLIMB, where=F.col("part") == part)
        out += [(part, k, m, s) for k, (m, s) in enumerate(zip(picked, scores))]
    return tidy(spark.createDataFrame(out, "part string, step bigint, model string, auc double"))


@query("k28_other_client_keys", sql(
    f"select TransactionID, {text_sql('TransactionAmt', 'day', 'addr1')} as by_amount, {text_sql('DeviceInfo', 'addr1', 'TransactionAmt')} "
    "as by_device from (select *, cast(floor(TransactionDT / 86400) as bigint) as day from joined) t", "joined"))
def k28(spark, folder):
    rows = joined(spark, folder).withColumn("day", day_number())
    return rows.select(KEY, client_id(rows, CLIENT_KEYS["amount_day_address"]).alias("by_amount"),
                       client_id(rows, CLIENT_KEYS["device_address_amount"]).alias("by_device"))


@query("k18_months", sql(
    "select (year(date '2017-11-15' + cast(floor(TransactionDT / 86400) as integer)) - 2017) * 12 + month(date '2017-11-15' "
    "+ cast(floor(TransactionDT / 86400) as integer)) as month, count(*) as n, round(avg(isFraud), 6) as mean_label from tx "
    "group by 1", "tx"))
def months(spark, folder):
    rows = tx(spark, folder).withColumn("month", month_index("TransactionDT", "2017-11-15 00:00:00"))
    return tidy(rows.groupBy("month").agg(F.count(F.lit(1)).alias("n"), F.avg("isFraud").alias("mean_label")))
