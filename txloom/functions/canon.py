"""Text form of a value, used as a join key and in pair features."""

from __future__ import annotations

from pyspark.sql import Column, functions as F
from pyspark.sql.types import BooleanType, DataType, DoubleType, FloatType, StringType

from ..schema import is_floating, is_integral


def number_text(c: Column) -> Column:
    """Decimal text of a double: ``1.0``, ``10000000.0``, ``12345678.5``; null and NaN give null.

    Spark itself writes 1.0E7 from ten million on and below one thousandth.
    """
    c = c.cast("double")
    size = F.abs(c)
    whole = F.concat(c.cast("decimal(17,0)").cast("string"), F.lit(".0"))
    plain = F.rtrim(c.cast("decimal(38,20)").cast("string"), F.lit("0"))
    return (
        F.when(c.isNull() | F.isnan(c), F.lit(None).cast("string"))
        .when((size < 1e16) & (c == F.floor(c)), whole)
        .when((size >= 1e-3) & (size < 1e7), c.cast("string"))
        .when((size >= 1e-4) & (size < 1e16), plain)
        .otherwise(F.lower(c.cast("string")))
    )


def canonical(c: Column, data_type: DataType) -> Column:
    """One text per value; equal numbers of different types share it (1 = 1.0 = true)."""
    if isinstance(data_type, BooleanType):
        return number_text(c.cast("int"))
    if is_integral(data_type):
        return F.concat(c.cast("string"), F.lit(".0"))
    if is_floating(data_type):
        return number_text(c)
    return c.cast("string")


def family(data_type: DataType) -> str:
    """'n' for numbers and booleans, 's' for text: '1' and 1 are different categories."""
    return "s" if isinstance(data_type, StringType) else "n"


def shown(c: Column, data_type: DataType) -> Column:
    """Text as a pair feature shows it: integers plain, doubles with a point, null as 'nan'."""
    if isinstance(data_type, (FloatType, DoubleType)):
        text = number_text(c)
    else:
        text = c.cast("string")
    return F.coalesce(text, F.lit("nan"))
