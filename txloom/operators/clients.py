"""Client identification and per-client history features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.dates import DAY, day_number
from ..functions.rows import joined_text
from ..schema import AMOUNT, KEY, LABEL, SPLIT, TIME
from ..session import settle
from .lookup import attach, members
from .groupstats import AGGREGATES
from .ordered import previous_value, running_totals

# Columns that together name a client.
CLIENT_KEYS = {
    "strict": ["TransactionAmt", "ProductCD", "card1", "card2", "card3", "card4", "card5", "card6", "addr1", "addr2",
               "reference_day", "P_emaildomain"],
    "cards_and_addresses": ["card1", "card6", "addr1", "addr2", "reference_day"],
    "card1": ["card1", "reference_day"],
    "amount_day_address": ["TransactionAmt", "day", "addr1"],
    "device_address_amount": ["DeviceInfo", "addr1", "TransactionAmt"],
}


def _of_known(df: DataFrame, client: str, made) -> DataFrame:
    """``made`` columns set to null on rows without client: they share no history."""
    return df.withColumns({c: F.when(F.col(client).isNotNull(), F.col(c)) for c in made})


def reference_day(delta: str = "D1", time: str = TIME) -> Column:
    """Day on which the counter ``delta`` (days since first use) was zero: constant per card."""
    return day_number(time) - F.floor(delta).cast("int")


def client_id(df: DataFrame, columns) -> Column:
    return joined_text(df, columns)


def previous_label(df: DataFrame, client: str, label: str = LABEL, time: str = TIME, key: str = KEY,
                   chunks: int | None = None) -> DataFrame:
    """``previous_isfraud``: label of the client's row before, by time; null without client."""
    out = previous_value(df, [client], [time, key], label, "previous_isfraud", chunks)
    return _of_known(out, client, ["previous_isfraud"])


def client_quality(df: DataFrame, client: str, label: str = LABEL, **kw) -> DataFrame:
    """(previous_isfraud, mean_label, n): how well a client id predicts the next label."""
    seen = previous_label(df.select(KEY, TIME, client, label), client, label, **kw)
    return seen.where("previous_isfraud is not null").groupBy("previous_isfraud").agg(
        F.avg(label).alias("mean_label"), F.count(F.lit(1)).alias("n"))


def client_stats(df: DataFrame, client: str, values, stats=("count", "mean", "var")) -> DataFrame:
    """``<v>_<stat>_<client>`` for numeric columns; rows without client get nulls."""
    table = df.where(F.col(client).isNotNull()).groupBy(client).agg(
        *[AGGREGATES[s](F.col(v).cast("double") if s != "count" else F.col(v)).alias(f"{v}_{s}_{client}")
          for v in values for s in stats])
    return attach(df, settle(table, "clients"), {client: client})


def sequence_features(df: DataFrame, client: str, time: str = TIME, key: str = KEY,
                      chunks: int | None = None) -> DataFrame:
    """Place of a row in its client's history.

    ``seq_position`` (from 1), ``seq_length``, ``seq_share`` = position / length,
    ``since_first`` and ``to_last`` in seconds.  Null without client.
    """
    placed = running_totals(df, [client], [time, key], {"_before": F.lit(1).cast("bigint")}, chunks)
    spans = df.groupBy(client).agg(F.count(F.lit(1)).alias("seq_length"), F.min(time).alias("_first"),
                                   F.max(time).alias("_last"))
    joined = attach(placed, settle(spans, "spans"), {client: client}, null_safe=True)
    position = F.col("_before") + 1
    out = joined.select(
        *df.columns, position.alias("seq_position"), "seq_length", (position / F.col("seq_length")).alias("seq_share"),
        (F.col(time) - F.col("_first")).alias("since_first"), (F.col("_last") - F.col(time)).alias("to_last"))
    return _of_known(out, client, ["seq_position", "seq_length", "seq_share", "since_first", "to_last"])


# Look-back windows in days.
LOOK_BACK = {"day": 1, "week": 7, "month": 30}


def trailing_activity(df: DataFrame, client: str, windows=LOOK_BACK, amount: str = AMOUNT, time: str = TIME,
                      chunks: int | None = None, scale: int = 9) -> DataFrame:
    """``prev_<w>_count`` and ``prev_<w>_amount``: the client's rows in the w before the second of this row.

    The content of a window is the running total at its end minus that at its
    start.  Both are found in one ordered pass over the client's moments and
    the starts of all windows, so a client with very many rows is spread over
    tasks like all others.  Amounts are added as decimals, because a difference
    of totals then leaves no binary residue: each is rounded to ``scale`` places
    and may have 28 - ``scale`` digits before them.  Rows without client get nulls.
    """
    money = F.col(amount).cast(f"decimal(28,{scale})")
    moments = df.groupBy(client, time).agg(F.count(F.lit(1)).alias("_n"), F.sum(money).alias("_s"))
    # A window start sorts before the moment at the same second: that moment is inside the window.
    marks = [F.struct(F.col(time).cast("bigint").alias("_at"), F.lit(len(windows)).alias("_kind"), F.col("_n"),
                      F.col("_s"))]
    for i, days in enumerate(windows.values()):
        marks.append(F.struct((F.col(time) - days * DAY).cast("bigint").alias("_at"), F.lit(i).alias("_kind"),
                              F.lit(0).cast("bigint").alias("_n"),
                              F.lit(0).cast(moments.schema["_s"].dataType).alias("_s")))
    line = moments.select(client, time, F.inline(F.array(*marks)))
    totals = running_totals(line, [client], ["_at", "_kind", time], {"_tn": F.col("_n"), "_ts": F.col("_s")}, chunks)
    at = {i: F.col("_kind") == i for i in range(len(windows) + 1)}
    end_n, end_s = (F.max(F.when(at[len(windows)], F.col(c))) for c in ("_tn", "_ts"))
    out = []
    for i, w in enumerate(windows):
        out.append((end_n - F.max(F.when(at[i], F.col("_tn")))).alias(f"prev_{w}_count"))
        out.append((end_s - F.max(F.when(at[i], F.col("_ts")))).cast("double").alias(f"prev_{w}_amount"))
    found = totals.groupBy(client, time).agg(*out)
    made = [f"prev_{w}_{kind}" for w in windows for kind in ("count", "amount")]
    return _of_known(attach(df, found, {client: client, time: time}, null_safe=True), client, made)


def past_target_mean(df: DataFrame, column: str, label: str = LABEL, time: str = TIME, key: str = KEY,
                     name: str | None = None, chunks: int | None = None) -> DataFrame:
    """Mean label of the earlier rows with the same value; null when there is none, or no value."""
    sums = {"_hits": F.coalesce(F.col(label), F.lit(0)).cast("bigint"),
            "_seen": F.col(label).isNotNull().cast("bigint")}
    made = name or f"{column}_past_mean"
    totals = running_totals(df, [column], [time, key], sums, chunks)
    return _of_known(totals.select(*df.columns, F.try_divide("_hits", "_seen").alias(made)), column, [made])


def mark_seen(df: DataFrame, client: str, name: str = "seen") -> DataFrame:
    """True on rows whose client occurs in the training rows."""
    known = df.where((F.col(SPLIT) == "train") & F.col(client).isNotNull()).select(client).distinct()
    marked = attach(df, settle(known.withColumn("_known", F.lit(True)), "known"), {client: client})
    return marked.withColumn(name, F.coalesce("_known", F.lit(False))).drop("_known")


def seen_rows(df: DataFrame, client: str, seen: bool = True) -> DataFrame:
    """Test rows of clients that the training rows hold (or do not hold)."""
    return members(df.where(F.col(SPLIT) == "test"), client, df.where(F.col(SPLIT) == "train"), negate=not seen)


def seen_share(df: DataFrame, client: str, period: str) -> DataFrame:
    """(period, clients, seen_share): share of a test period's clients that the training rows hold."""
    marked = mark_seen(df.select(SPLIT, client, period), client)
    clients = marked.where((F.col(SPLIT) == "test") & F.col(client).isNotNull()).groupBy(period, client).agg(
        F.max("seen").alias("seen"))
    return clients.groupBy(period).agg(F.count(F.lit(1)).alias("clients"),
                                       F.avg(F.col("seen").cast("double")).alias("seen_share"))
