"""Small helpers of the registered queries: rounding and casts that make both engines comparable."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import FloatType

from ..schema import is_floating, is_integral


def tidy(df: DataFrame, digits: int = 6) -> DataFrame:
    """Floating columns rounded, whole columns as bigint."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if is_floating(f.dataType):
            c = F.round(c.cast("double") if isinstance(f.dataType, FloatType) else c, digits)
        elif is_integral(f.dataType):
            c = c.cast("bigint")
        out.append(c.alias(f.name))
    return df.select(*out)
