"""Checked queries: the feature chain as a whole."""

from __future__ import annotations

from ..plans.features import encoded_features, feature_table, prepared_rows
from ..schema import ADDRS, CARDS
from .features import EMAIL_SQL, H, PAIR_SQL, PAIRS, _DOW, _HOD
from .fixtures import _IDENT, _TX, joined, sql
from .groups import RATIO_SQL, USER_SQL
from .registry import query
from .tools import tidy

_COUNTS = [*CARDS, *ADDRS]
_USER = ["user_trx_cnt", "user_TransactionAmt_mean", "user_TransactionAmt_std"]
_LOWERED = ["DeviceInfo", "id_30", "id_31"]
_MADE = [c for c in H if c not in _LOWERED]
_RAW = [c for c in [*_TX, *_IDENT] if c not in ("TransactionID", "split", "isFraud")]
_RAW = list(dict.fromkeys(_RAW))
_NUMBERS = ["card1", "card2", "card3", "card5", "addr1", "addr2", "id_20"]
_CODED = [*CARDS, *ADDRS, "ProductCD", "P_emaildomain", "R_emaildomain", "id_20", "id_30", "id_31", "id_33", "id_35",
          "DeviceType", "DeviceInfo", "device_version", "os_id_30", "version_id_30", "browser_id_31", "version_id_31",
          "device_name", *EMAIL_SQL, *[f"{a}__{b}" for a, b in PAIRS]]
_PER_SPLIT = ["id_01", "id_31", "id_33", "id_35"]


def _text(c: str) -> str:
    return f"cast(cast({c} as double) as varchar)" if c in _NUMBERS else c


def _chain_sql() -> str:
    device = ", ".join(f"{H[c]} as {c}" for c in _MADE)
    lowered = ", ".join(f"lower({c}) as {c}" for c in _LOWERED)
    nulls = " + ".join(f"case when {c} is null then 1 else 0 end" for c in [*_RAW, *_USER, *_MADE])
    counts = ", ".join(f"count(*) over (partition by {c}) as {c}_count_full" for c in _COUNTS)
    emails = ", ".join(f"{e} as {n}" for n, e in EMAIL_SQL.items())
    dates = f"{_DOW} as Transaction_day_of_week, {_HOD} as Transaction_hour_of_day, cast(trunc((TransactionAmt - " \
            "trunc(TransactionAmt)) * 1000) as bigint) as TransactionAmt_decimal, cast(" \
            f"{_HOD} between 4 and 9 as bigint) as special_hour_day, cast({_DOW} between 3 and 6 as bigint) as " \
            "special_day_week"
    flags = ", ".join(f"cast(coalesce({p}_emaildomain = 'protonmail.com', false) as bigint) as {p}_isproton" for p in "PR")
    values = " union all ".join(
        f"select '{c}' as col, '{'n' if c in _NUMBERS else 's'}' as kind, {_text(c)} as v, split from made"
        for c in _CODED)
    rest = [c for c in [*_RAW, *_MADE, *_USER] if c not in _CODED]
    ratio_names = [p.rsplit(" as ", 1)[1] for p in RATIO_SQL.split(", round(")]
    kept = [*rest, *[f"{c}_count_full" for c in _COUNTS], *ratio_names, "nulls1", "P_isproton", "R_isproton",
            "Transaction_day_of_week", "Transaction_hour_of_day", "TransactionAmt_decimal", "special_hour_day",
            "special_day_week"]
    joins = " ".join(f"left join (select v, code from held join codes using (kind, v) where col = '{c}') k{i} on k{i}.v = "
                     f"{_text(f'made.{c}') if c not in _NUMBERS else f'cast(cast(made.{c} as double) as varchar)'}"
                     for i, c in enumerate(_CODED))
    return f"""+ grouped as (select joined.*, {USER_SQL}, {counts}, {RATIO_SQL} from joined),
      device as (select *, {device} from grouped),
      made as (select * replace ({lowered}), cast({nulls} as bigint) as nulls1, {flags}, {emails}, {dates}, {PAIR_SQL}
               from device),
      vals as ({values}),
      held as (select col, kind, v from vals where v is not null group by all
               having count(*) filter (split = 'train') > 0 and count(*) filter (split = 'test') > 0),
      codes as (select kind, v, row_number() over (order by kind, v) as code from (select distinct kind, v from held
                where not (kind = 's' and v = 'unknown'))),
      coded as (select made.TransactionID, made.split, made.isFraud, {', '.join(f'made.{c}' for c in kept)},
                {', '.join(f'coalesce(k{i}.code, -999) as {c}' for i, c in enumerate(_CODED))} from made {joins})
      select *, {', '.join(f'count(*) over (partition by split, {c}) as {c}_count_dist' for c in _PER_SPLIT)} from coded"""


@query("e1_coded_features", sql(_chain_sql(), "joined"))
def coded_features(spark, folder):
    """The chain up to the codes and their counts, every column checked."""
    return tidy(encoded_features(prepared_rows(joined(spark, folder))))


@query("e1_feature_table")
def whole_chain(spark, folder):
    """The whole chain from joined rows to filled model input, with pruned ratios."""
    return tidy(feature_table(joined(spark, folder)), 4)
