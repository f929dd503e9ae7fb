"""Calendar features of an offset in seconds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..schema import AMOUNT, TIME, col
from .ratios import decimal_part

DAY = 86400
START = "2017-11-30 00:00:00"


def day_of_week(t: str | Column = TIME) -> Column:
    return F.floor(F.pmod(col(t).cast("double") / F.lit(float(DAY)) - 1, F.lit(7.0))).cast("int")


def hour_of_day(t: str | Column = TIME) -> Column:
    return F.pmod(F.floor(col(t) / 3600), F.lit(24)).cast("int")


def day_number(t: str | Column = TIME) -> Column:
    return F.floor(col(t) / DAY).cast("int")


def event_time(t: str | Column = TIME, start: str = START) -> Column:
    """Timestamp of an offset from ``start`` (UTC)."""
    origin = F.unix_timestamp(F.to_timestamp(F.concat(F.lit(start), F.lit(" UTC")), "yyyy-MM-dd HH:mm:ss z"))
    return F.timestamp_seconds(col(t) + origin)


def calendar_date(t: str | Column = TIME, start: str = START) -> Column:
    """Date of an offset; counts whole days, so the session time zone plays no part."""
    return F.date_add(F.lit(start[:10]).cast("date"), day_number(t))


def month_index(t: str | Column = TIME, start: str = START, base_year: int = 2017) -> Column:
    """(year - base_year) * 12 + month."""
    d = calendar_date(t, start)
    return (F.year(d) - base_year) * 12 + F.month(d)


def is_december(t: str | Column = TIME, start: str = START) -> Column:
    return (F.month(calendar_date(t, start)) == 12).cast("int")


def special_hour(t: str | Column = TIME) -> Column:
    return hour_of_day(t).between(4, 9).cast("int")


def special_day(t: str | Column = TIME) -> Column:
    return day_of_week(t).between(3, 6).cast("int")


def date_features(df: DataFrame) -> DataFrame:
    return df.withColumns({
        "Transaction_day_of_week": day_of_week(),
        "Transaction_hour_of_day": hour_of_day(),
        "TransactionAmt_decimal": decimal_part(AMOUNT),
        "special_hour_day": special_hour(),
        "special_day_week": special_day(),
    })


def last_month(df: DataFrame, month: Column) -> int | None:
    return df.agg(F.max(month).alias("m")).first()["m"]


def before_last_month(df: DataFrame, month: Column) -> DataFrame:
    """Rows of every month but the newest: one aggregate, then a filter on a constant."""
    return df.where(month < F.lit(last_month(df, month)))


def month_groups(df: DataFrame, name: str = "DT_M", start: str = START, base_year: int = 2017,
                 last_value: int = 17) -> DataFrame:
    """Month index with every row of the newest month set to ``last_value``."""
    m = month_index(TIME, start, base_year)
    return df.withColumn(name, F.when(m < F.lit(last_month(df, m)), m).otherwise(last_value))
