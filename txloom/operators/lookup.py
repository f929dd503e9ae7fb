"""Joins: keyed tables, lookup tables, membership, values found for numbered rows."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StructField, StructType

from ..schema import KEY, ROW

#: Rows whose numbers differ in these low bits only travel together.
SLICE_BITS = 13
_SLICE, _DATA, _PART = "_slice", "_data", "_part"


def attach(df: DataFrame, lookup: DataFrame, on: dict[str, Column | str], null_safe: bool = False,
           how: str = "left") -> DataFrame:
    """Join the columns of ``lookup`` to ``df``; ``on`` maps its key columns to expressions of ``df``.

    No hint is given.  A settled lookup has a known file size and is broadcast
    by Catalyst when small; otherwise both sides are shuffled and adaptive
    execution splits the partitions of a hot key.
    """
    renamed = lookup.select(*[F.col(k).alias(f"_k_{k}") for k in on], *[c for c in lookup.columns if c not in on])
    tests = []
    for k, e in on.items():
        left, right = (F.col(e) if isinstance(e, str) else e), F.col(f"_k_{k}")
        tests.append(left.eqNullSafe(right) if null_safe else left == right)
    return df.join(renamed, reduce(lambda a, b: a & b, tests), how).drop(*[f"_k_{k}" for k in on])


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Task side: the rows of a slice as one compressed Arrow stream, texts as places in a dictionary."""
    for batch in batches:
        if not batch.num_rows:
            continue
        slices = batch.column(ROW).to_numpy() >> SLICE_BITS
        cuts = np.flatnonzero(np.r_[True, slices[1:] != slices[:-1], True])
        made = []
        for start, end in zip(cuts[:-1], cuts[1:]):
            part = batch.slice(start, end - start)
            part = pa.RecordBatch.from_arrays([pc.dictionary_encode(a) if pa.types.is_string(a.type) else a for a in part.columns], part.schema.names)
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, part.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_batch(part)
            made.append(sink.getvalue().to_pybytes())
        yield pa.RecordBatch.from_arrays([pa.array(slices[cuts[:-1]]), pa.array(made, pa.binary())], [_SLICE, _DATA])


def _merged(columns: list[str], wanted: list[list[str]]):
    """Task side: the rows of a slice with what was found for them."""
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        parts = []
        for raw in left.column(_DATA):
            part = pa.ipc.open_stream(raw.as_buffer()).read_all()
            parts.append(pa.table([a.cast(a.type.value_type) if pa.types.is_dictionary(a.type) else a for a in part.columns], part.schema.names))
        rows = pa.concat_tables(parts)
        made, names = [rows.column(c) for c in columns], list(columns)
        for i, mine in enumerate(wanted):
            found = right.filter(pc.equal(right.column(_PART), i)).combine_chunks()
            at = pc.index_in(rows.column(ROW), found.column(ROW))
            made += [found.column(n).take(at) for n in mine]
            names += mine
        return pa.table(made, names)

    return run


def attach_found(df: DataFrame, found: list[DataFrame]) -> DataFrame:
    """``df`` with the columns of tables that name a row by its number ``ROW``, at most once each; null where a table has no row.

    The rows of ``df`` are not shuffled one by one: those with neighbouring
    numbers travel as one compressed block of columns, of which a shuffle holds a
    fraction of the bytes.  ``ROW`` must be unique, and neighbours should come
    in order, as they do in a table that was written with
    ``monotonically_increasing_id``.
    """
    wanted = [[c for c in f.columns if c != ROW] for f in found]
    cells = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [f.withColumn(_PART, F.lit(i)) for i, f in enumerate(found)])
    blocks = df.mapInArrow(_packed, f"{_SLICE} bigint, {_DATA} binary")
    kinds = StructType([*df.schema.fields, *[StructField(c, f.schema[c].dataType) for f, mine in zip(found, wanted) for c in mine]])
    right = cells.withColumn(_SLICE, F.shiftright(ROW, SLICE_BITS))
    return blocks.groupBy(_SLICE).cogroup(right.groupBy(_SLICE)).applyInArrow(_merged(df.columns, wanted), kinds)


def join_identity(transactions: DataFrame, identity: DataFrame, key: str = KEY) -> DataFrame:
    """Every transaction with its identity row, if it has one."""
    return transactions.join(identity, key, "left")


def append_block(df: DataFrame, block: DataFrame, key: str = KEY, fill: float = -1.0) -> DataFrame:
    """Column-wise append of an external feature block; missing and infinite values become ``fill``."""
    from .impute import fill_constant
    added = [c for c in block.columns if c != key]
    return fill_constant(df.join(block, key, "left"), fill, fill, added)


def select_keys(df: DataFrame, keys: DataFrame, key: str = KEY) -> DataFrame:
    """Rows whose key another table holds."""
    return df.join(keys.select(key), key, "left_semi")


def members(df: DataFrame, column: str, allowed: DataFrame, allowed_column: str | None = None,
            negate: bool = False) -> DataFrame:
    """Rows whose value is in (or not in) a table of allowed values; a null value is in no table.

    Repeated allowed values are combined first, so that a hot one does not meet itself.
    """
    right = allowed.select(F.col(allowed_column or column).alias("_allowed")).distinct()
    return df.join(right, F.col(column) == F.col("_allowed"), "left_anti" if negate else "left_semi")
