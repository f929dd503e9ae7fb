"""Checked queries: encoders, imputation, selection and scalar features."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from ..functions.dates import date_features, month_groups, special_day, special_hour
from ..functions.emails import PROVIDERS, email_features, proton_flags
from ..functions.ratios import amount_ratios, decimal_part, pairwise_ratios, ratio
from ..functions.rows import PAIRS, null_count, pair_features
from ..functions.text import BROWSER_RULES, DEVICE_RULES, LATEST_BROWSERS, device_features
from ..functions import text
from ..operators.correlation import pruned_ratios
from ..operators.encoders import (
    category_limit, encode_categories, frequency_encode, label_encode, target_encode, vocabulary_encode,
)
from ..operators.groupstats import card_counts, categorical_counts, fingerprint, split_counts
from ..operators.impute import fill_constant, impute
from ..operators.training import assemble, booster, important_columns
from ..schema import ADDRS, CARDS, KEY
from .fixtures import IDENTITY, ident, joined, sql, tx
from .groups import long_sql, spearman_sql
from .registry import query
from .tools import tidy

_COUNTED = [*CARDS, *ADDRS]


@query("g1_count_full", sql("select TransactionID, " + ", ".join(
    f"count(*) over (partition by {c}) as {c}_count_full" for c in _COUNTED) + " from tx", "tx"))
def g1(spark, folder):
    out = card_counts(tx(spark, folder).select(KEY, *_COUNTED))
    return out.drop(*_COUNTED)


_PER_SPLIT = ["id_01", "id_31", "id_33", "id_35"]


@query("g2_count_per_split", sql("select TransactionID, " + ", ".join(
    f"count(*) over (partition by split, {c}) as {c}_count_dist" for c in _PER_SPLIT) + " from joined", "joined"))
def g2(spark, folder):
    return split_counts(joined(spark, folder).select(KEY, "split", *_PER_SPLIT)).drop("split", *_PER_SPLIT)


_OVERALL = ["ProductCD", "P_emaildomain", "R_emaildomain", "DeviceType", "DeviceInfo", "id_20", "id_30"]


@query("g3_count_categoricals", sql("select TransactionID, " + ", ".join(
    f"count(*) over (partition by {c}) as {c}_count_full" for c in _OVERALL) + " from joined", "joined"))
def g3(spark, folder):
    return categorical_counts(joined(spark, folder).select(KEY, *_OVERALL)).drop(*_OVERALL)


@query("g3_count_categoricals_compat", sql("select TransactionID, count(*) over (partition by id_35) as id_35_count_full "
                                           "from joined", "joined"))
def g3_compat(spark, folder):
    return categorical_counts(joined(spark, folder).select(KEY, "id_35"), compat=True).drop("id_35")


_LIMIT = 500


@query("g4_category_limit", sql(
    "+ ok as (select card5 from tx where card5 is not null group by card5 having count(*) filter (split = 'train') > "
    f"{_LIMIT} and count(*) filter (split = 'test') > 0), ok2 as (select P_emaildomain from tx where P_emaildomain is "
    f"not null group by P_emaildomain having count(*) filter (split = 'train') > {_LIMIT} and count(*) filter (split = "
    "'test') > 0) select TransactionID, case when card5 in (select * from ok) then cast(card5 as varchar) else 'unknown' "
    "end as card5, case when P_emaildomain in (select * from ok2) then P_emaildomain else 'unknown' end as "
    "P_emaildomain from tx", "tx"))
def g4(spark, folder):
    return category_limit(tx(spark, folder).select(KEY, "split", "card5", "P_emaildomain"), ["card5", "P_emaildomain"],
                          _LIMIT).drop("split")


_CODED = [("ProductCD", "s"), ("card4", "s"), ("P_emaildomain", "s"), ("R_emaildomain", "s"), ("card3", "n"),
          ("card5", "n"), ("addr1", "n")]


def _value(c: str, kind: str) -> str:
    return c if kind == "s" else f"cast(cast({c} as double) as varchar)"


_DICTIONARY = "+ vals as ({}), kept as (select col, kind, v from vals where v is not null group by all having count(*) " \
              "filter (split = 'train') > 0 and count(*) filter (split = 'test') > 0), codes as (select kind, v, " \
              "row_number() over (order by kind, v) as code from (select distinct kind, v from kept)) ".format(
                  " union all ".join(f"select '{c}' as col, '{k}' as kind, {_value(c, k)} as v, split from tx"
                                     for c, k in _CODED))


@query("g5_shared_dictionary", sql(
    _DICTIONARY + "select TransactionID, " + ", ".join(f"coalesce({c}_k.code, -999) as {c}" for c, _ in _CODED) +
    " from tx " + " ".join(
        f"left join (select v, code from kept join codes using (kind, v) where col = '{c}') {c}_k on {c}_k.v = "
        f"{_value(c, k)}" for c, k in _CODED), "tx"))
def g5(spark, folder):
    names = [c for c, _ in _CODED]
    return encode_categories(tx(spark, folder).select(KEY, "split", *names), names).drop("split")


@query("g6_vocabulary", sql(
    "+ vocab as (select R_emaildomain as w, arg_max(TransactionID, TransactionID) as code from tx where R_emaildomain is "
    "not null group by R_emaildomain) select TransactionID, vocab.code as code from tx left join vocab on w = "
    "P_emaildomain", "tx"))
def g6(spark, folder):
    rows = tx(spark, folder)
    entries = rows.where("R_emaildomain is not null").select(
        F.col("R_emaildomain").alias("key"), F.col(KEY).alias("code"), F.col(KEY).alias("pos"))
    return vocabulary_encode(rows.select(KEY, "P_emaildomain"), entries, "P_emaildomain", "code").drop("P_emaildomain")


@query("g7_label_encode", sql("select TransactionID, dense_rank() over (order by coalesce(card4, '-999')) - 1 as card4, "
                              "dense_rank() over (order by ProductCD) - 1 as ProductCD from tx", "tx"))
def g7(spark, folder):
    return label_encode(tx(spark, folder).select(KEY, "card4", "ProductCD"), ["card4", "ProductCD"])


_BASE = ["C1", "C2", "C3", "D1", "D8", "D11", "D15"]
_TRX = [f"{c}_trx" for c in _BASE]
_DIV = [f"{a}__div__{b}" for a, b in combinations(_BASE, 2)]
_RATIOS = ", ".join([f"{c} / nullif(TransactionAmt, 0) as {c}_trx" for c in _BASE] + [
    f"cast({a} as double) / nullif({b}, 0) as {a}__div__{b}" for a, b in combinations(_BASE, 2)])


def _dropped(step: str, long: str) -> str:
    return f"{step} as (select distinct col_j as col from ({spearman_sql(long)}) where abs(rho) > 0.99)"


# The limit of 0.99 drops nothing between these columns, so that the check uses a lower one in all passes.
_THRESHOLD = 0.5


@query("g8_pruned_ratios", sql(
    f"+ wide as (select *, {_RATIOS} from tx where split = 'train'), l1 as ({long_sql('wide', _TRX, 'TransactionID')}), "
    f"{_dropped('d1', 'l1')}, l2 as ({long_sql('wide', _DIV, 'TransactionID')}), {_dropped('d2', 'l2')}, l3 as (select * "
    f"from ({long_sql('wide', [*_BASE, *_TRX, *_DIV], 'TransactionID')}) where col not in (select col from d1 union all "
    f"select col from d2)), {_dropped('d3', 'l3')} select 'by_amount' as pass, col as \"column\" from d1 union all select "
    "'by_pair', col from d2 union all select 'together', col from d3".replace("0.99", str(_THRESHOLD)), "tx").replace(
        "0.99", str(_THRESHOLD)))
def g8(spark, folder):
    rows = tx(spark, folder).select(KEY, "split", "TransactionAmt", *_BASE)
    out, dropped = pruned_ratios(rows, F.col("split") == "train", base=_BASE, divided=_BASE, threshold=_THRESHOLD)
    left = set(out.columns)
    made = [(p, c) for p, names in dropped.items() for c in names if c not in left]
    return spark.createDataFrame(made, "pass string, `column` string")


_TARGETS = ["card4", "ProductCD", "card2"]


@query("g9_target_encode", sql(
    "+ " + ", ".join(f"m_{c} as (select {c}, avg(isFraud) as m from tx where split = 'train' and {c} is not null "
                     f"group by {c})" for c in _TARGETS) + ", j as (select TransactionID, " + ", ".join(
        f"m_{c}.m as {c}" for c in _TARGETS) + " from tx " + " ".join(
        f"left join m_{c} on tx.{c} = m_{c}.{c}" for c in _TARGETS) + ") select TransactionID, " + ", ".join(
        f"round(coalesce({c}, avg({c}) over ()), 6) as {c}" for c in _TARGETS) + " from j", "tx"))
def g9(spark, folder):
    rows = tx(spark, folder).select(KEY, "split", "isFraud", *_TARGETS)
    out = target_encode(rows, _TARGETS, fit_on=F.col("split") == "train")
    return tidy(out.select(KEY, *_TARGETS))


_FREQ = ["card4", "card2", "ProductCD", "card6"]


def _freq_sql(columns, encoded) -> str:
    first, second = columns[0], columns[1]
    parts = []
    for c in columns:
        if c in encoded:
            other = second if c == first else first
            parts.append(f"(select coalesce(max(n), 0) from (select {c} as v, count({other}) as n from tx where split = "
                         f"'train' and {c} is not null group by {c}) g where g.v = t.{c}) as {c}")
        else:
            parts.append(c)
    return f"select TransactionID, {', '.join(parts)} from tx t"


@query("g10_frequency_encode", sql(_freq_sql(_FREQ, _FREQ), "tx"))
def g10(spark, folder):
    rows = tx(spark, folder).select(KEY, "split", *_FREQ)
    return frequency_encode(rows, _FREQ, F.col("split") == "train").drop("split")


@query("g10_frequency_encode_compat", sql(_freq_sql(_FREQ, _FREQ[:-1]), "tx"))
def g10_compat(spark, folder):
    rows = tx(spark, folder).select(KEY, "split", *_FREQ)
    return frequency_encode(rows, _FREQ, F.col("split") == "train", compat=True).drop("split")


@query("g11_constant_fill", sql(
    "select TransactionID, coalesce(D15, -999) as D15, round(case when D15 is null then -999 when C1 = 0 then case when "
    "D15 = 0 then -999 else -1 end else cast(D15 as double) / C1 end, 6) as r from tx", "tx"))
def g11(spark, folder):
    rows = tx(spark, folder).select(KEY, "D15", ratio("D15", "C1", "inf").alias("r"))
    return tidy(fill_constant(rows, -999.0, -1.0, ["D15", "r"]))


@query("g12_mean_imputation", sql(
    "+ m as (select avg(D15) as a, avg(dist1) as b from tx where split = 'train') select TransactionID, "
    "round(coalesce(D15, (select a from m)), 6) as D15, round(coalesce(dist1, (select b from m)), 6) as dist1 from tx",
    "tx"))
def g12(spark, folder):
    return tidy(impute(tx(spark, folder).select(KEY, "split", "D15", "dist1"), ["D15", "dist1"]).drop("split"))


_NULLABLE = ["card2", "card4", "card5", "addr1", "addr2", "dist1", "P_emaildomain", *IDENTITY]


@query("g13_null_count", sql("select TransactionID, cast(" + " + ".join(
    f"case when {c} is null then 1 else 0 end" for c in _NULLABLE) + " as bigint) as nulls1 from joined", "joined"))
def g13(spark, folder):
    rows = joined(spark, folder)
    return tidy(rows.select(KEY, null_count(rows, _NULLABLE).alias("nulls1")))


@query("g14_importance_selection")
def g14(spark, folder):
    names = ["C1", "C2", "C3", "D1", "TransactionAmt", "card1"]
    train = assemble(tx(spark, folder), names, ["isFraud"])
    chosen = important_columns(train, names, 0.05, booster("gbdt", maxIter=3, maxDepth=3))
    return tx(spark, folder).select(KEY, *chosen)


def _fingerprint_sql(ids) -> str:
    some = f"coalesce({', '.join(f'cast({c} as varchar)' for c in ids)}) is not null"
    return sql(f"select count(*) as n, min(TransactionID) as first_row from joined where {some} group by {', '.join(ids)}", "joined")


def _fingerprint_groups(spark, folder, ids):
    rows = joined(spark, folder).select(KEY, fingerprint(ids).alias("user_id")).where("user_id is not null")
    return rows.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.min(KEY).alias("first_row")).drop("user_id")


@query("g15_fingerprint_groups", _fingerprint_sql(IDENTITY))
def g15(spark, folder):
    return _fingerprint_groups(spark, folder, IDENTITY)


# Without the account column many rows share a fingerprint.
_WITHOUT_ACCOUNT = [c for c in IDENTITY if c != "id_01"]


@query("g15_shared_fingerprint_groups", _fingerprint_sql(_WITHOUT_ACCOUNT))
def g15_shared(spark, folder):
    return _fingerprint_groups(spark, folder, _WITHOUT_ACCOUNT)


# -- scalar features -----------------------------------------------------------------

def last_match_sql(c: str, rules) -> str:
    tests = [f"when {'contains' if k == 'contains' else 'starts_with'}({c}, '{n}') then '{v}'"
             for k, n, v in reversed(rules)]
    return f"case {' '.join(tests)} end"


def scalar(name: str, sql_columns: str, make, source=ident, view: str = "ident"):
    """Register a map-only feature query over a whole view."""
    @query(name, sql(f"select TransactionID, {sql_columns} from {view}", view))
    def run(spark, folder):
        rows = source(spark, folder)
        return tidy(rows.select(KEY, *[e.alias(n) for n, e in make(rows).items()]))


_LATEST = ", ".join(f"'{b}'" for b in LATEST_BROWSERS)
H = {
    "latest_browser": f"cast(coalesce(id_31 in ({_LATEST}), false) as bigint)",
    "DeviceInfo": "lower(DeviceInfo)",
    "id_30": "lower(id_30)",
    "id_31": "lower(id_31)",
    "device_version": "nullif(split_part(lower(DeviceInfo), '/', 2), '')",
    "os_id_30": "split_part(lower(id_30), ' ', 1)",
    "version_id_30": r"regexp_replace(lower(id_30), '[^0-9_.\s]+', '', 'g')",
    "browser_id_31": last_match_sql("lower(id_31)", BROWSER_RULES),
    "version_id_31": r"'a_' || regexp_replace(lower(id_31), '[^0-9.\s]+', '', 'g')",
    "screen_width": "try_cast(split_part(id_33, 'x', 1) as double)",
    "screen_height": "try_cast(split_part(id_33, 'x', 2) as double)",
    "screen_ratio": "round(try_cast(split_part(id_33, 'x', 1) as double) / (try_cast(split_part(id_33, 'x', 2) as "
                    "double) + 1), 6)",
    "device_name": last_match_sql("lower(DeviceInfo)", DEVICE_RULES),
}


def h(*names: str) -> str:
    return ", ".join(f"{H[n]} as {n}" for n in names)


scalar("h1_latest_browser", h("latest_browser"), lambda d: {"latest_browser": text.latest_browser("id_31")})
scalar("h2_lower_case", h("DeviceInfo", "id_30", "id_31"),
       lambda d: {c: F.lower(c) for c in ("DeviceInfo", "id_30", "id_31")})
scalar("h3_device_version", h("device_version"),
       lambda d: {"device_version": text.part_of(F.lower("DeviceInfo"), "/", 1)})
scalar("h4_os_name", h("os_id_30"), lambda d: {"os_id_30": text.part_of(F.lower("id_30"), " ", 0)})
scalar("h5_os_version", h("version_id_30"), lambda d: {"version_id_30": text.digits_of(F.lower("id_30"), r"0-9_.\s")})
scalar("h6_browser_family", h("browser_id_31"),
       lambda d: {"browser_id_31": text.last_match(F.lower("id_31"), BROWSER_RULES)})
scalar("h7_browser_version", h("version_id_31"),
       lambda d: {"version_id_31": F.concat(F.lit("a_"), text.digits_of(F.lower("id_31"), r"0-9.\s"))})
scalar("h8_screen_size", h("screen_width", "screen_height", "screen_ratio"),
       lambda d: {"screen_width": text.screen_size("id_33", 0), "screen_height": text.screen_size("id_33", 1),
                  "screen_ratio": ratio(text.screen_size("id_33", 0), text.screen_size("id_33", 1) + 1)})
scalar("h9_device_name", h("device_name"), lambda d: {"device_name": text.last_match(F.lower("DeviceInfo"), DEVICE_RULES)})


@query("h10_device_block", sql(f"select TransactionID, id_33, DeviceType, {h(*H)} from ident", "ident"))
def h10(spark, folder):
    return tidy(device_features(ident(spark, folder)).drop("id_01", "id_02", "id_20", "id_35"))


def _provider_sql(c: str) -> str:
    by = {}
    for domain, provider in PROVIDERS.items():
        by.setdefault(provider, []).append(f"'{domain}'")
    return f"case {' '.join(f'when {c} in ({chr(44).join(v)}) then {chr(39)}{p}{chr(39)}' for p, v in by.items())} end"


EMAIL_SQL = {}
for _c in ("P_emaildomain", "R_emaildomain"):
    _last = f"split_part(coalesce({_c}, 'nan'), '.', -1)"
    EMAIL_SQL[f"{_c}_bin"] = _provider_sql(_c)
    EMAIL_SQL[f"{_c}_suffix"] = f"case when {_last} in ('gmail', 'net', 'edu') then 'us' else {_last} end"


@query("h11_proton_flags", sql("select TransactionID, coalesce(P_emaildomain = 'protonmail.com', false) as P_isproton, "
                               "coalesce(R_emaildomain = 'protonmail.com', false) as R_isproton from tx", "tx"))
def h11(spark, folder):
    return proton_flags(tx(spark, folder)).select(KEY, "P_isproton", "R_isproton")


@query("h12_email_provider", sql(f"select TransactionID, {EMAIL_SQL['P_emaildomain_bin']} as P_emaildomain_bin, "
                                 f"{EMAIL_SQL['R_emaildomain_bin']} as R_emaildomain_bin from tx", "tx"))
def h12(spark, folder):
    return email_features(tx(spark, folder)).select(KEY, "P_emaildomain_bin", "R_emaildomain_bin")


@query("h13_email_suffix", sql(f"select TransactionID, {EMAIL_SQL['P_emaildomain_suffix']} as P_emaildomain_suffix, "
                               f"{EMAIL_SQL['R_emaildomain_suffix']} as R_emaildomain_suffix from tx", "tx"))
def h13(spark, folder):
    return email_features(tx(spark, folder)).select(KEY, "P_emaildomain_suffix", "R_emaildomain_suffix")


def _pair_part(c: str) -> str:
    source = {**EMAIL_SQL, "device_name": H["device_name"]}.get(c, c)
    return f"coalesce(cast({source} as varchar), 'nan')"


PAIR_SQL = ", ".join(f"{_pair_part(a)} || '_' || {_pair_part(b)} as {a}__{b}" for a, b in PAIRS)


@query("h14_pairs", sql(f"select TransactionID, {PAIR_SQL} from joined", "joined"))
def h14(spark, folder):
    rows = email_features(device_features(joined(spark, folder)))
    return pair_features(rows).select(KEY, *[f"{a}__{b}" for a, b in PAIRS])


_DOW = "cast(floor((TransactionDT / 86400.0 - 1) % 7) as bigint)"
_HOD = "cast(floor(TransactionDT / 3600.0) as bigint) % 24"
scalar("h16_day_of_week", f"{_DOW} as Transaction_day_of_week",
       lambda d: {"Transaction_day_of_week": date_features_of("Transaction_day_of_week")}, tx, "tx")
scalar("h17_hour_of_day", f"{_HOD} as Transaction_hour_of_day",
       lambda d: {"Transaction_hour_of_day": date_features_of("Transaction_hour_of_day")}, tx, "tx")
scalar("h18_special_times", f"cast({_HOD} between 4 and 9 as bigint) as special_hour_day, cast({_DOW} between 3 and 6 as "
                            "bigint) as special_day_week",
       lambda d: {"special_hour_day": special_hour(), "special_day_week": special_day()}, tx, "tx")


def date_features_of(name: str):
    from ..functions.dates import day_of_week, hour_of_day
    return {"Transaction_day_of_week": day_of_week, "Transaction_hour_of_day": hour_of_day}[name]()


_START = "2017-11-15 00:00:00"
_MONTH = "(year(date '2017-11-15' + cast(floor(TransactionDT / 86400) as integer)) - 2017) * 12 + " \
         "month(date '2017-11-15' + cast(floor(TransactionDT / 86400) as integer))"


@query("h19_month_groups", sql(f"+ m as (select TransactionID, {_MONTH} as month from tx) select TransactionID, case when "
                               "month < (select max(month) from m) then month else 17 end as DT_M from m", "tx"))
def h19(spark, folder):
    return tidy(month_groups(tx(spark, folder).select(KEY, "TransactionDT"), start=_START).drop("TransactionDT"))


scalar("h20_amount_decimals", "cast(trunc((TransactionAmt - trunc(TransactionAmt)) * 1000) as bigint) as d, "
                              "cast(round(TransactionAmt * 1000) as bigint) % 1000 as exact",
       lambda d: {"d": decimal_part(), "exact": decimal_part(exact=True)}, tx, "tx")
scalar("h21_amount_ratios", ", ".join(f"round({c} / nullif(TransactionAmt, 0), 6) as {c}_trx" for c in _BASE),
       lambda d: amount_ratios(d), tx, "tx")
scalar("h22_pairwise_ratios", ", ".join(f"round(cast({a} as double) / nullif({b}, 0), 6) as {a}__div__{b}"
                                        for a, b in combinations(_BASE, 2)), lambda d: pairwise_ratios(d), tx, "tx")
scalar("h23_rounding", "abs(TransactionAmt - 50) as a, round(TransactionAmt) as r, floor(TransactionAmt) as f, "
                       "cast(trunc(TransactionAmt) as bigint) as t".replace("abs(TransactionAmt - 50)",
                                                                          "round(abs(TransactionAmt - 50), 6)"),
       lambda d: {"a": F.abs(F.col("TransactionAmt") - 50), "r": F.round("TransactionAmt"),
                  "f": F.floor("TransactionAmt").cast("double"), "t": F.col("TransactionAmt").cast("bigint")}, tx, "tx")


@query("h_date_block", sql(f"select TransactionID, {_DOW} as Transaction_day_of_week, {_HOD} as Transaction_hour_of_day, "
                           "cast(trunc((TransactionAmt - trunc(TransactionAmt)) * 1000) as bigint) as "
                           f"TransactionAmt_decimal, cast({_HOD} between 4 and 9 as bigint) as special_hour_day, "
                           f"cast({_DOW} between 3 and 6 as bigint) as special_day_week from tx", "tx"))
def date_block(spark, folder):
    rows = tx(spark, folder).select(KEY, "TransactionDT", "TransactionAmt")
    return tidy(date_features(rows).drop("TransactionDT", "TransactionAmt"))
