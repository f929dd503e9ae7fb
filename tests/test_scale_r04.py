"""Disk: what is shuffled and written must not grow with the width of the rows times the number of steps."""

import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from txloom import session
from txloom.operators import correlation, encoders, groupstats
from txloom.plans.features import encoded_features, prepared_rows
from txloom.queries.fixtures import joined
from txloom.schema import ROW


@pytest.fixture
def no_broadcast(spark, monkeypatch):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    monkeypatch.setattr(groupstats, "FEW", 3)
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_numbered_rows_pass_large_tables_in_blocks(spark, no_broadcast):
    rows = spark.range(20_000).selectExpr(
        "if(id = 9, null, id div 2) as TransactionID", "if(id % 3 = 0, 'train', if(id % 50 = 1, null, 'test')) as split", "if(id % 7 = 0, null, id % 900) as a",
        "if(id % 5 = 0, null, concat('t', id % 1100)) as b", "cast(id % 2 as string) as few", "cast(id % 13 as double) / 4 as c", "timestamp_seconds(id) as at",
        "if(id % 4 = 0, null, id % 60) as id_01", "id % 17 as TransactionDT", "id % 23 / 2 as TransactionAmt", "cast(null as string) as nothing", "id % 2 = 0 as flag")
    written = session.settle(rows.withColumn(ROW, F.monotonically_increasing_id()), "numbered")
    made = [lambda d: groupstats.count_encode(d, ["a", "b", "few", "id_01"]), lambda d: groupstats.count_encode(d, ["a", "b"], within=["split"]),
            lambda d: groupstats.group_ratios(d, [("c", "a"), ("c", "b"), ("TransactionAmt", "few")]),
            lambda d: encoders.encode_categories(d, ["a", "b", "few", "nothing"]), lambda d: groupstats.user_stats(d, ["id_01"])]
    for make in made:
        blocks, plain = make(written), make(written.drop(ROW))
        plan = blocks._jdf.queryExecution().executedPlan().toString()
        assert "LeftOuter" not in plan and "FlatMapCoGroupsInArrow" in plan
        assert [f.dataType for f in blocks.drop(ROW).schema] == [f.dataType for f in plain.schema]
        assert blocks.drop(ROW).columns == plain.columns
        assert sorted(map(str, blocks.drop(ROW).collect())) == sorted(map(str, plain.collect()))


def test_steps_delete_what_they_wrote(spark, no_broadcast):
    given = set(session._GIVEN)
    rows = prepared_rows(joined(spark, "/root/testdata/sf0.001"))
    left = set(session._GIVEN) - given
    assert len(left) == 1 and os.path.basename(left.pop()).startswith("rows-")
    folder = session.shared_dir(spark)
    assert not [f for f in os.listdir(folder) if f.startswith(("numbered-", "groupstats-")) and f"{folder}/{f}" not in given]
    assert encoded_features(rows).count() == 1000


@pytest.mark.parametrize("size,apart", [(1_000_000, None), (2_000, {"a": 0, "b": 0})])
def test_ranks_are_moved_in_blocks(spark, monkeypatch, size, apart):
    monkeypatch.setattr(correlation, "CHUNK_CELLS", size)
    draw = np.random.default_rng(1)
    pdf = pd.DataFrame({"a": np.round(draw.normal(size=12_000), 2), "b": draw.normal(size=12_000), "c": draw.integers(-1, 2, 12_000) * 1.0})
    pdf["d"] = np.where(draw.random(12_000) < 0.3, np.nan, pdf["a"] ** 3 + draw.normal(size=12_000))
    pdf["e"] = np.where(draw.random(12_000) < 0.3, np.nan, pdf["b"] - pdf["a"])
    written, plain = {}, correlation.settle

    def settle(df, name, **options):
        written[name] = plain(df, name, **options)
        if name == "ranks":
            assert written[name].where("slice >= 0").agg(F.sum("n")).first()[0] == int(pdf.notna().to_numpy().sum())
        return written[name]

    monkeypatch.setattr(correlation, "settle", settle)
    got = {(r["col_i"], r["col_j"]): r["rho"] for r in correlation.spearman_pairs(spark.createDataFrame(pdf), list("abcde"), apart=apart).collect()}
    want = pdf.corr(method="spearman")
    assert set(got) == {(x, y) for i, x in enumerate("abcde") for y in "abcde"[i + 1:]} - ({("a", "b")} if apart else set())
    assert all(abs(rho - want.loc[pair]) < 1e-9 for pair, rho in got.items())
    blocks = written["ranks"].count()
    assert blocks < (100 if size > 12_000 else 1_000)
    assert not [p for p in session._GIVEN if "/finite-" in p]
