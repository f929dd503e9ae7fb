"""Features of one row over a group of its columns."""

from __future__ import annotations

from itertools import combinations
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..schema import is_floating
from .canon import shown


def missing(df: DataFrame, name: str) -> Column:
    """True where the value is null or NaN."""
    c = F.col(name)
    return c.isNull() | F.isnan(c) if is_floating(df.schema[name].dataType) else c.isNull()


def null_count(df: DataFrame, columns=None) -> Column:
    return reduce(lambda a, b: a + b, [missing(df, c).cast("int") for c in columns or df.columns])


def missing_pattern(df: DataFrame, columns) -> Column:
    """One character per column, 1 where the value is missing."""
    return F.concat(*[F.when(missing(df, c), "1").otherwise("0") for c in columns])


def row_extreme(columns, largest: bool = True) -> Column:
    pick = F.greatest if largest else F.least
    return pick(*[F.col(c).cast("double") for c in columns])


def row_extreme_column(columns, largest: bool = True) -> Column:
    """Name of the first column that holds the row's extreme, null when all are null."""
    best = row_extreme(columns, largest)
    return F.coalesce(*[F.when(F.col(c).cast("double") == best, c) for c in columns])


# The pairs of columns joined into one category.
PAIRS = [
    ("id_02", "id_20"), ("id_02", "D8"), ("D11", "device_name"), ("device_name", "P_emaildomain"),
    ("P_emaildomain", "C2"), ("card2", "dist1"), ("card1", "card5"), ("card2", "id_20"), ("card3", "card5"),
    ("P_emaildomain_bin", "R_emaildomain_bin"), ("P_emaildomain_suffix", "R_emaildomain_suffix"),
    ("card5", "P_emaildomain"), ("addr1", "card1"), ("addr2", "card1"), ("addr1", "card4"),
]


def joined_text(df: DataFrame, columns) -> Column:
    """Values of several columns as one text, joined by '_', null shown as 'nan'."""
    return F.concat_ws("_", *[shown(F.col(c), df.schema[c].dataType) for c in columns])


def pair_features(df: DataFrame, pairs=PAIRS) -> DataFrame:
    return df.withColumns({f"{a}__{b}": joined_text(df, (a, b)) for a, b in pairs})


def interactions(df: DataFrame, columns, size: int) -> DataFrame:
    """All ``size``-way combinations of the listed categorical columns."""
    return df.withColumns({"__".join(c): joined_text(df, c) for c in combinations(columns, size)})
