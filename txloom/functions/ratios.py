"""Ratio features with a declared rule for a zero denominator."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, functions as F

from ..schema import AMOUNT, C_COLS, D_COLS, V_COLS, col


def ratio(num: str | Column, den: str | Column, on_zero: str = "null") -> Column:
    """num / den as double.

    ``on_zero='null'``: a zero denominator gives null.  ``on_zero='inf'``: it
    gives signed infinity, and 0/0 gives null.
    """
    n, d = col(num).cast("double"), col(den).cast("double")
    if on_zero == "null":
        return F.try_divide(n, d)
    if on_zero != "inf":
        raise ValueError("on_zero must be 'null' or 'inf'")
    infinite = F.when(n > 0, float("inf")).when(n < 0, float("-inf"))
    return F.when(d == 0, infinite).otherwise(F.try_divide(n, d))


def amount_ratios(df: DataFrame, columns=None, amount: str = AMOUNT, on_zero: str = "null") -> dict[str, Column]:
    """``<c>_trx`` = c / amount for every listed column the table has."""
    names = [c for c in (columns or [*C_COLS, *D_COLS, *V_COLS]) if c in df.columns]
    return {f"{c}_trx": ratio(c, amount, on_zero) for c in names}


def pairwise_ratios(df: DataFrame, columns=None, on_zero: str = "null") -> dict[str, Column]:
    """``<a>__div__<b>`` for every pair of listed columns, the earlier one on top."""
    names = [c for c in (columns or [*C_COLS, *D_COLS]) if c in df.columns]
    return {f"{a}__div__{b}": ratio(a, b, on_zero) for a, b in combinations(names, 2)}


def decimal_part(amount: str | Column = AMOUNT, exact: bool = False) -> Column:
    """Thousandths of the amount, truncated; ``exact`` rounds binary noise away first."""
    a = col(amount).cast("double")
    if exact:
        return F.round(a * 1000).cast("bigint") % 1000
    return ((a - a.cast("bigint")) * 1000).cast("int")
