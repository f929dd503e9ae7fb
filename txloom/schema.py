"""Declared input schemas and column roles.

The kind of a column (key, label, time, categorical, numeric) is declared,
not guessed from its physical type: which features apply to a column never
depends on what a CSV reader inferred.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import (
    ByteType, DoubleType, FloatType, IntegerType, LongType, NumericType, ShortType,
    StringType, StructField, StructType,
)

KEY = "TransactionID"
TIME = "TransactionDT"
AMOUNT = "TransactionAmt"
LABEL = "isFraud"
SPLIT = "split"
UNKNOWN = "unknown"
#: Number that each row gets for itself.
ROW = "_row"

CARDS = [f"card{i}" for i in range(1, 7)]
ADDRS = ["addr1", "addr2"]
EMAILS = ["P_emaildomain", "R_emaildomain"]
C_COLS = [f"C{i}" for i in range(1, 15)]
D_COLS = [f"D{i}" for i in range(1, 16)]
M_COLS = [f"M{i}" for i in range(1, 10)]
V_COLS = [f"V{i}" for i in range(1, 340)]
ID_COLS = [f"id_{i:02d}" for i in range(1, 39)]
ID_CATEGORICAL = ID_COLS[11:]


def _field(name: str) -> StructField:
    if name in (KEY, TIME):
        return StructField(name, LongType())
    if name == LABEL:
        return StructField(name, IntegerType())
    text = {"ProductCD", "card4", "card6", "DeviceType", "DeviceInfo", *EMAILS, *M_COLS}
    text |= {"id_12", "id_15", "id_16", "id_23", "id_27", "id_28", "id_29", "id_30", "id_31", "id_33",
             "id_34", "id_35", "id_36", "id_37", "id_38"}
    return StructField(name, StringType() if name in text else DoubleType())


def transaction_schema(labelled: bool = True) -> StructType:
    names = [KEY, *([LABEL] if labelled else []), TIME, AMOUNT, "ProductCD", *CARDS, *ADDRS, "dist1", "dist2",
             *EMAILS, *C_COLS, *D_COLS, *M_COLS, *V_COLS]
    return StructType([_field(n) for n in names])


def identity_schema() -> StructType:
    return StructType([_field(n) for n in [KEY, *ID_COLS, "DeviceType", "DeviceInfo"]])


SUBMISSION_SCHEMA = StructType([StructField(KEY, LongType()), StructField(LABEL, DoubleType())])


@dataclass(frozen=True)
class Roles:
    """Which columns of a table are categorical and which are numeric."""

    categorical: tuple[str, ...] = ()
    numeric: tuple[str, ...] = ()
    key: str = KEY
    label: str = LABEL
    passthrough: tuple[str, ...] = field(default=(SPLIT, TIME))

    def with_categorical(self, *names: str) -> "Roles":
        """Declare more columns categorical; numbers keep their value."""
        added = [n for n in names if n not in self.categorical]
        return Roles((*self.categorical, *added), tuple(n for n in self.numeric if n not in names),
                     self.key, self.label, self.passthrough)


DEFAULT_CATEGORICAL = (*CARDS, *ADDRS, *ID_CATEGORICAL)


def declare_categorical(df: DataFrame, roles: Roles | None = None, names=DEFAULT_CATEGORICAL) -> Roles:
    """Role map of ``df`` with ``names`` (those present) declared categorical."""
    roles = roles or infer_roles(df)
    return roles.with_categorical(*[n for n in names if n in df.columns])


def infer_roles(df: DataFrame, skip=(KEY, LABEL, SPLIT, TIME)) -> Roles:
    """Starting role map: strings are categorical, numbers numeric."""
    fields = [f for f in df.schema.fields if f.name not in skip]
    return Roles(
        tuple(f.name for f in fields if isinstance(f.dataType, StringType)),
        tuple(f.name for f in fields if isinstance(f.dataType, NumericType)),
    )


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType)]


def is_integral(data_type) -> bool:
    return isinstance(data_type, (ByteType, ShortType, IntegerType, LongType))


def is_floating(data_type) -> bool:
    return isinstance(data_type, (FloatType, DoubleType))


def drop_label(df: DataFrame, *extra: str) -> tuple[DataFrame, DataFrame]:
    """Split a table into (features, keyed labels)."""
    return df.drop(LABEL, *extra), df.select(KEY, LABEL)


def codes_to_int(df: DataFrame, names) -> DataFrame:
    """Cast category codes held as text to int; text that is no number gives null."""
    return df.withColumns({n: F.col(n).try_cast("int") for n in names})


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c
