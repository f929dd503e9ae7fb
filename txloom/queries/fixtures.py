"""Views in the shape of the input tables, derived from the test tables.

Every view covers all rows of the table it comes from.  The expressions are
valid in Spark SQL and in DuckDB alike; only the two that differ between the
engines are written twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

_DOMAINS = ["gmail.com", "yahoo.com.mx", "protonmail.com", "hotmail.co.uk", "comcast.net", "scranton.edu", "gmail",
            "unlisted.example.org"]


def _choice(expr: str, values) -> str:
    return f"case {expr} " + " ".join(f"when {i} then '{v}'" for i, v in enumerate(values)) + " end"


_EVENTS = {
    "spark": ("cast(get_json_object(props, '$.k') as bigint)",
              "unix_seconds(cast(ts as timestamp)) - 1704067200 + 86400"),
    "duck": ("cast(json_extract_string(props, '$.k') as bigint)",
             "cast(floor(epoch(ts)) as bigint) - 1704067200 + 86400"),
}

_TX = {
    "TransactionID": "event_id",
    "TransactionDT": "dt",
    "split": "case when dt < 86400 * 23 then 'train' else 'test' end",
    "isFraud": "case when event_type = 'error' then 1 else 0 end",
    "TransactionAmt": "value",
    "ProductCD": "event_type",
    "card1": "user_id",
    "card2": "nullif(k % 12, 0) + 100",
    "card3": "150 + k % 3",
    "card4": _choice("k % 5", ["visa", "mastercard", "discover", "american express"]),
    "card5": "nullif(event_id % 17, 3) + 200",
    "card6": "case event_id % 3 when 0 then 'credit' when 1 then 'debit' else 'charge card' end",
    "addr1": "nullif(user_id % 20, 7) + 300",
    "addr2": "case when k % 10 = 9 then null else 87 end",
    "dist1": "cast(case when k % 4 = 0 then null else k * 1.5 end as double)",
    "P_emaildomain": _choice("k % 9", _DOMAINS),
    "R_emaildomain": _choice("event_id % 9", _DOMAINS),
    "C1": "k % 7",
    "C2": "k % 5",
    "C3": "event_id % 11",
    "D1": "event_id % 40",
    "D8": "cast(nullif(k % 8, 0) * 0.25 as double)",
    "D11": "nullif(k % 13, 5)",
    "D15": "case when k % 6 = 0 then null else k end",
}

_IDENT = {
    "TransactionID": "c_custkey * 6",
    "id_01": "c_acctbal",
    "id_02": "case when c_nationkey % 7 = 0 then null else cast(c_nationkey * 10.0 as double) end",
    "id_20": "cast(c_nationkey as bigint)",
    "id_30": _choice("c_custkey % 5", ["Windows 10", "iOS 11.2.1", "Mac OS X 10_13_6", "Android 7.0"]),
    "id_31": _choice("c_custkey % 8", ["chrome 63.0 for android", "Chrome 64.0", "mobile safari 11.0", "edge 17.0",
                                       "ie 11.0 for desktop", "samsung browser 7.0",
                                       "google search application 49.0"]),
    "id_33": _choice("c_custkey % 4", ["1920x1080", "1366x768", "bad"]),
    "id_35": _choice("c_custkey % 3", ["T", "F"]),
    "DeviceType": "c_mktsegment",
    "DeviceInfo": _choice("c_custkey % 9", ["Windows", "SM-G950U Build/R16NW", "LG-D320", "Moto G Play Build/NPIS26",
                                            "rv:57.0", "Trident/7.0", "iOS Device", "Pixel 2 Build/OPM1/x"]),
}
IDENTITY = [c for c in _IDENT if c.startswith("id_")]
_LONG = {"card2", "card3", "card5", "addr1", "addr2", "C1", "C2", "C3", "D1", "D11", "D15", "isFraud"}

MODELS = ["m1", "m2", "m3"]
# Three made-up models; the scores depend on the label a little and tie often.
_MODEL_SCORES = {
    "m1": "(event_id % 97 + 30 * isFraud + 1) / cast(130 as double)",
    "m2": "(k + 10 * isFraud + 5) / cast(120 as double)",
    "m3": "(event_id * 7 % 101 + 5 * isFraud + 2) / cast(110 as double)",
}


def _cast(name: str, expr: str) -> str:
    return f"cast({expr} as bigint)" if name in _LONG else expr


def _columns(exprs: dict) -> str:
    return ", ".join(f"{_cast(n, e)} as {n}" for n, e in exprs.items())


def _events_sql(engine: str) -> str:
    k, dt = _EVENTS[engine]
    return f"select *, {k} as k, {dt} as dt from events"


TX_SQL = f"select {_columns(_TX)} from ({_events_sql('duck')}) e"
IDENT_SQL = f"select {_columns(_IDENT)} from customer"
JOINED_SQL = "select tx.*, {} from tx left join ident using (TransactionID)".format(
    ", ".join(f"ident.{c}" for c in _IDENT if c != "TransactionID"))
OOF_SQL = " union all ".join(
    f"select '{m}' as model, event_id % 3 as fold, TransactionID, isFraud as label, {e} as prediction "
    f"from (select tx.*, TransactionID as event_id, cast(json_extract_string(ev.props, '$.k') as bigint) as k "
    f"from tx join events ev on ev.event_id = tx.TransactionID) t" for m, e in _MODEL_SCORES.items())
VMAT_SQL = "select vec_id, label, {}, 2 * V1 + 1 as V65, power(V2, 3) as V66, case when label = 9 then null else V3 " \
           "end as V67 from (select vec_id, label, {} from embeddings) e".format(
               ", ".join(f"V{i}" for i in range(1, 65)),
               ", ".join(f"cast(embedding[{i}] as double) as V{i}" for i in range(1, 65)))
VIEWS = {"tx": TX_SQL, "ident": IDENT_SQL, "joined": JOINED_SQL, "oof": OOF_SQL, "vmat": VMAT_SQL}
_NEEDS = {"joined": ["tx", "ident"], "oof": ["tx"]}


def sql(body: str, *views: str) -> str:
    """DuckDB query over the named views; ``body`` may open with further common table expressions after a '+'."""
    names: list[str] = []
    for v in views:
        for need in [*_NEEDS.get(v, []), v]:
            if need not in names:
                names.append(need)
    ctes = [f"{n} as ({VIEWS[n]})" for n in names]
    body = body.strip()
    if body.startswith("+"):
        return "with recursive " + ", ".join(ctes) + ", " + body[1:] if ctes else "with recursive " + body[1:]
    return "with " + ", ".join(ctes) + " " + body


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def tx(spark: SparkSession, folder: str) -> DataFrame:
    k, dt = _EVENTS["spark"]
    events = table(spark, folder, "events").selectExpr("*", f"{k} as k", f"{dt} as dt")
    return events.selectExpr(*[f"{_cast(n, e)} as {n}" for n, e in _TX.items()])


def ident(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "customer").selectExpr(*[f"{_cast(n, e)} as {n}" for n, e in _IDENT.items()])


def joined(spark: SparkSession, folder: str) -> DataFrame:
    """``tx`` with its ``ident`` row, if it has one; the join moves the columns of the tables, the views are made of its rows."""
    k, dt = _EVENTS["spark"]
    events = table(spark, folder, "events").selectExpr("*", f"{k} as k", f"{dt} as dt")
    customers = table(spark, folder, "customer").selectExpr("*", f"{_IDENT['TransactionID']} as _of")
    both = events.join(customers, F.col(_TX["TransactionID"]) == F.col("_of"), "left")
    found = {n: F.when(F.col("_of").isNotNull(), F.expr(_cast(n, e))) for n, e in _IDENT.items() if n != "TransactionID"}
    return both.select(*[F.expr(_cast(n, e)).alias(n) for n, e in _TX.items()], *[e.alias(n) for n, e in found.items()])


def oof(spark: SparkSession, folder: str) -> DataFrame:
    """(model, fold, TransactionID, label, prediction) of three made-up models."""
    k, _ = _EVENTS["spark"]
    rows = table(spark, folder, "events").selectExpr(
        "event_id", f"{k} as k", f"{_cast('isFraud', _TX['isFraud'])} as isFraud")
    scores = F.inline(F.array(*[F.struct(F.lit(m).alias("model"), F.expr(e).alias("prediction"))
                                for m, e in _MODEL_SCORES.items()]))
    return rows.select("*", scores).selectExpr("model", "event_id % 3 as fold", "event_id as TransactionID",
                                               "isFraud as label", "prediction")


def vmat(spark: SparkSession, folder: str) -> DataFrame:
    base = table(spark, folder, "embeddings").selectExpr(
        "vec_id", "label", *[f"cast(embedding[{i - 1}] as double) as V{i}" for i in range(1, 65)])
    return base.selectExpr("*", "2 * V1 + 1 as V65", "power(V2, 3) as V66",
                           "case when label = 9 then null else V3 end as V67")
