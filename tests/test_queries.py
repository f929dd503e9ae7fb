"""Every registered query against its SQL on the smallest test data."""

import math

import duckdb
import pytest

from txloom.queries import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()
TYPES = {"bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    return con


def key(row):
    return tuple((v is not None, str(type(v)), v if v is not None else 0) for v in row)


def close(a, b):
    """Equal, up to one unit in the last place both sides were rounded to."""
    if isinstance(a, float) and isinstance(b, float):
        return math.isclose(a, b, rel_tol=1e-9, abs_tol=2e-6)
    return a == b


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_sql(spark, duck, name):
    df = QUERIES[name](spark, FOLDER)
    result = duck.execute(ORACLES[name])
    columns = [c[0] for c in result.description]
    assert sorted(df.columns) == sorted(columns)
    kinds = {c[0]: str(c[1]) for c in result.description}
    assert {f.name: TYPES.get(f.dataType.simpleString()) for f in df.schema.fields} == kinds
    order = sorted(columns)
    ours = sorted((tuple(r[c] for c in order) for r in df.collect()), key=key)
    theirs = sorted((tuple(r[columns.index(c)] for c in order) for r in result.fetchall()), key=key)
    assert len(ours) == len(theirs)
    assert all(close(x, y) for a, b in zip(ours, theirs) for x, y in zip(a, b))


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_rows_without_sql(spark, name):
    df = QUERIES[name](spark, FOLDER)
    rows = df.collect()
    assert rows
    assert len(df.columns) == len(set(df.columns))
    for field in ("prediction", "valid_auc", "train_auc", "auc"):
        if field in df.columns:
            assert all(0.0 <= r[field] <= 1.0 for r in rows)
