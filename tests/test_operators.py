"""Operators against brute force on small tables, with several chunks and a hot group."""

import random
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.sql import Window, functions as F

from txloom.functions import text
from txloom.functions.canon import number_text
from txloom.functions.ratios import ratio
from txloom.operators import blend, clients, correlation, encoders, folds, groupstats, narrow as narrowing, ordered, sampling
from txloom.operators.folds import group_kfold, kfold, lightest_first, stratified_kfold
from txloom.operators.impute import fill_constant
from txloom.operators.metrics import auc, errors
from txloom.operators.narrow import constant_columns, narrow, narrowing_profile
from txloom.operators.ordered import average_rank, group_quantile, previous_value, row_index, running_totals


@pytest.fixture(scope="module")
def rows(spark):
    """400 rows; group 'a' holds more than a third, and some values are null."""
    rng = random.Random(7)
    data = [(i, rng.choice("aaabcdefg") if i % 17 else None, rng.randrange(40), None if i % 11 == 0 else rng.randrange(9),
             round(rng.random() * 100, 2), int(rng.random() < 0.2)) for i in range(400)]
    return spark.createDataFrame(data, "TransactionID bigint, g string, TransactionDT bigint, v bigint, "
                                       "TransactionAmt double, isFraud int")


def frame(df):
    return df.toPandas().sort_values("TransactionID").reset_index(drop=True)


@pytest.mark.parametrize("chunks", [1, 5, 13])
def test_running_totals_over_chunks(rows, chunks):
    order = ["TransactionDT", "TransactionID"]
    out = running_totals(rows, ["g"], order, {"total": F.coalesce("v", F.lit(0))}, chunks)
    pdf = rows.toPandas().sort_values(order)
    expected = pdf.assign(v=pdf["v"].fillna(0)).groupby("g", dropna=False)["v"].cumsum() - pdf["v"].fillna(0)
    want = dict(zip(pdf["TransactionID"], expected))
    got = {r["TransactionID"]: r["total"] for r in out.collect()}
    assert got == {k: int(v) for k, v in want.items()}


@pytest.mark.parametrize("chunks", [1, 9])
def test_row_index_of_one_group(rows, chunks):
    got = sorted(r["row_index"] for r in row_index(rows, [], ["TransactionDT", "TransactionID"], chunks=chunks).collect())
    assert got == list(range(400))


@pytest.mark.parametrize("chunks", [1, 6, 20])
def test_previous_value_keeps_null(rows, chunks):
    order = ["TransactionDT", "TransactionID"]
    out = previous_value(rows, ["g"], order, "v", "prev", chunks)
    pdf = rows.toPandas().sort_values(order)
    want = dict(zip(pdf["TransactionID"], pdf.groupby("g", dropna=False)["v"].shift(1)))
    for r in out.collect():
        w = want[r["TransactionID"]]
        assert r["prev"] == (None if pd.isna(w) else int(w))


def test_average_rank_and_quantile(rows):
    ranks = {(r["g"], r["v"]): r["avg_rank"] for r in average_rank(rows, ["g"], "v", chunks=7).collect()}
    pdf = rows.toPandas()
    want = pdf.groupby("g", dropna=False)["v"].rank()
    for g, v, w in zip(pdf["g"], pdf["v"], want):
        if not pd.isna(v):
            assert ranks[(None if pd.isna(g) else g, int(v))] == w
    got = {r["g"]: r["quantile"] for r in group_quantile(rows, ["g"], "TransactionAmt", 0.9, chunks=5).collect()}
    for g, w in pdf.groupby("g", dropna=False)["TransactionAmt"].quantile(0.9).items():
        assert got[None if pd.isna(g) else g] == pytest.approx(w)


def test_auc_equals_evaluator(spark):
    rng = random.Random(1)
    df = spark.createDataFrame([(round(rng.random(), 1), float(rng.random() < 0.3)) for _ in range(500)],
                               "prediction double, label double")
    want = BinaryClassificationEvaluator(rawPredictionCol="prediction", numBins=0).evaluate(df)
    assert auc(df).first()["auc"] == pytest.approx(want)
    one_class = df.where("label = 1")
    assert auc(one_class).first()["auc"] is None


def test_weighted_errors(spark):
    df = spark.createDataFrame([(1.0, 1, 3.0), (0.0, 1, 1.0)], "prediction double, label int, w double")
    r = errors(df, weight="w").first()
    assert (r["mse"], r["mae"], r["accuracy"]) == (0.25, 0.25, 0.75)


def greedy(sizes, k):
    loads, folds = [0] * k, []
    for s in sizes:
        f = loads.index(min(loads))
        loads[f] += s
        folds.append(f)
    return folds


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.integers(1, 30), st.integers(1, 12), min_size=1, max_size=8), st.integers(2, 6))
def test_lightest_first_is_greedy(histogram, k):
    order = [s for s in sorted(histogram, reverse=True) for _ in range(histogram[s])]
    dealt = []
    for size, start, end, folds in lightest_first(list(histogram.items()), k):
        dealt += [folds[(r - start) % len(folds)] for r in range(start, end)]
    assert dealt == greedy(order, k)


def test_group_folds_keep_groups_whole(rows):
    folds = group_kfold(rows, 3, "g").join(rows, "TransactionID").toPandas()
    assert len(folds) == 400
    assert (folds.groupby("g", dropna=False)["fold"].nunique() == 1).all()


@pytest.mark.parametrize("shuffle", [False, True])
def test_kfold_is_balanced(rows, shuffle):
    sizes = kfold(rows, 7, shuffle=shuffle).groupBy("fold").count().toPandas()["count"]
    assert len(sizes) == 7 and sizes.sum() == 400 and sizes.max() - sizes.min() <= 1


def test_stratified_kfold_per_class(rows):
    both = stratified_kfold(rows, 4, shuffle=True, seed=2).join(rows, "TransactionID").toPandas()
    sizes = both.groupby(["isFraud", "fold"]).size()
    for c in (0, 1):
        assert sizes[c].max() - sizes[c].min() <= 1


@pytest.mark.parametrize("fraction", [0.0, 0.2, 1.0])
def test_downsample_is_exact_and_repeatable(rows, fraction):
    first, again = (set(map(tuple, sampling.downsample_negatives(rows, fraction, seed=4).select(
        "TransactionID", "isFraud").collect())) for _ in range(2))
    assert first == again
    negatives = rows.where("isFraud = 0").count()
    assert sum(1 for _, y in first if y == 0) == round(fraction * negatives)
    assert sum(1 for _, y in first if y == 1) == 400 - negatives


@pytest.fixture(scope="module")
def holes(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame(rng.integers(0, 6, (90, 7)).astype(float), columns=list("abcdefg"))
    pdf["h"] = pdf["a"] * 2 + 1
    for i, c in enumerate("cdefg"):
        pdf.loc[rng.random(90) < 0.15 * (i + 1), c] = np.nan
    pdf.loc[::2, "e"] = np.inf
    pdf.insert(0, "TransactionID", range(90))
    return pdf, spark.createDataFrame(pdf)


@pytest.mark.parametrize("block,chunks", [(3, 1), (1, 4), (8, 40)])
def test_spearman_on_holes(holes, monkeypatch, block, chunks):
    """Blocks of few columns; one chunk for all, chunks within a column, and values that go on over several chunks."""
    monkeypatch.setattr(correlation, "BLOCK_COLUMNS", block)
    monkeypatch.setattr(correlation, "HELD_RANKS", 50)
    pdf, df = holes
    names = list("abcdefgh")
    want = pdf[names].replace([np.inf, -np.inf], np.nan).corr(method="spearman")
    got = correlation.spearman_pairs(df, names, chunks=chunks).collect()
    assert len(got) == 28
    assert {(r["col_i"], r["col_j"]): r["n"] for r in got} == {
        (a, b): int((pdf[a].map(np.isfinite) & pdf[b].map(np.isfinite)).sum()) for i, a in enumerate(names) for b in names[i + 1:]}
    for r in got:
        assert r["rho"] == pytest.approx(want.loc[r["col_i"], r["col_j"]])


def test_spearman_with_target_and_own_ranks(holes):
    pdf, df = holes
    want = pdf.replace([np.inf, -np.inf], np.nan)[list("abcdefg")].corr(method="spearman")
    got = {r["col_i"]: r["rho"] for r in correlation.spearman_pairs(df, list("abcdef"), target="g").collect()}
    assert set(got) == set("abcdef")
    for c, rho in got.items():
        assert rho == pytest.approx(want.loc[c, "g"])
    simple = correlation.spearman_pairs(df, ["a", "b", "h"], method="column_ranks").collect()
    for r in simple:
        assert r["rho"] == pytest.approx(pdf[[r["col_i"], r["col_j"]]].corr(method="spearman").iloc[0, 1])


def test_spearman_own_ranks_on_holes_in_blocks(holes, monkeypatch):
    """Ranks over the own rows of a column, then the correlation of these ranks on the common rows."""
    monkeypatch.setattr(correlation, "BLOCK_COLUMNS", 3)
    pdf, df = holes
    names = list("abcdefgh")
    ranks = pdf[names].replace([np.inf, -np.inf], np.nan).rank()
    want = ranks.corr()
    got = correlation.spearman_pairs(df, names, method="column_ranks", chunks=5).collect()
    assert len(got) == 28
    for r in got:
        assert r["rho"] == pytest.approx(want.loc[r["col_i"], r["col_j"]])


def test_spearman_of_columns_apart(holes, spark):
    """Pairs inside a set are left out; constant columns have no correlation, missing ones no pair."""
    pdf, df = holes
    wide = df.withColumns({"k": F.lit(1.5), "m": F.lit(None).cast("double")})
    got = {(r["col_i"], r["col_j"]): r["rho"] for r in correlation.spearman_pairs(
        wide, ["a", "b", "c", "h", "k", "m"], apart={"a": 0, "h": 0, "b": 1, "c": 1}).collect()}
    assert set(got) == {("a", "b"), ("a", "c"), ("b", "h"), ("c", "h"), ("a", "k"), ("b", "k"), ("c", "k"), ("h", "k")}
    assert all((v is None) == ("k" in pair) for pair, v in got.items())
    assert correlation.spearman_pairs(wide, ["m"], target="a").collect() == []
    assert correlation.spearman_pairs(wide.limit(0), ["a", "b"]).collect() == []


def test_spearman_leaves_no_row_per_pair_in_tasks(holes):
    """Tasks hand over a row per block: the plan has no join and no aggregate over pairs."""
    plan = correlation.spearman_pairs(holes[1], list("abcdefgh"))._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "HashAggregate" not in plan


def test_later_column_goes_even_if_partner_went(holes):
    pdf, df = holes
    chain = df.withColumns({"i": F.col("h") + 1, "j": -F.col("i") if "i" in df.columns else -F.col("h")})
    assert correlation.correlated_columns(chain, ["a", "h", "i", "j", "b"]) == ["h", "i", "j"]


@pytest.mark.parametrize("chunks", [1, 11])
def test_trailing_activity_brute_force(rows, chunks):
    scaled = rows.where("g is not null").withColumn("TransactionDT", F.col("TransactionDT") * 20000)
    got = clients.trailing_activity(scaled, "g", {"day": 1, "week": 7}, chunks=chunks).toPandas()
    assert len(got) == scaled.count()
    for r in got.itertuples():
        same = got[(got["g"] == r.g) & (got["TransactionDT"] < r.TransactionDT)]
        for name, days in (("day", 1), ("week", 7)):
            inside = same[same["TransactionDT"] >= r.TransactionDT - days * 86400]
            assert getattr(r, f"prev_{name}_count") == len(inside)
            assert getattr(r, f"prev_{name}_amount") == pytest.approx(inside["TransactionAmt"].sum())


def test_sequence_and_past_mean(rows):
    out = clients.sequence_features(rows, "g", chunks=6).toPandas()
    assert out.loc[out["g"].isna(), "seq_position"].isna().all()
    for _, part in out.groupby("g"):
        assert sorted(part["seq_position"]) == list(range(1, len(part) + 1))
        assert (part["seq_length"] == len(part)).all()
    past = clients.past_target_mean(rows, "g", chunks=6).toPandas().sort_values(["TransactionDT", "TransactionID"])
    assert past.loc[past["g"].isna(), "g_past_mean"].isna().all()
    for _, part in past.groupby("g"):
        assert np.isnan(part["g_past_mean"].iloc[0])
        assert part["g_past_mean"].iloc[-1] == pytest.approx(part["isFraud"].iloc[:-1].mean())


def test_wide_rows_keep_their_columns(rows):
    narrow = rows.select("TransactionID", "TransactionDT", "g", "isFraud")
    for f in (lambda d: clients.sequence_features(d, "g", chunks=5), lambda d: clients.previous_label(d, "g", chunks=5),
              lambda d: clients.past_target_mean(d, "g", chunks=5)):
        wide, slim = f(rows), f(narrow)
        assert wide.columns[:len(rows.columns)] == ["TransactionID", *[c for c in rows.columns if c != "TransactionID"]]
        shared = sorted(slim.columns)
        assert sorted(map(tuple, wide.select(shared).collect()), key=str) == sorted(
            map(tuple, slim.select(shared).collect()), key=str)


def test_null_key_gets_no_group_value(spark):
    df = spark.createDataFrame([(1, None, 2.0, "train"), (2, "x", 4.0, "train"), (3, "x", 8.0, "test")],
                               "TransactionID bigint, k string, v double, split string")
    out = {r["TransactionID"]: r for r in groupstats.group_broadcast(df, "k", ["v"]).collect()}
    assert out[1]["v_mean_k"] is None
    assert out[2]["v_mean_k"] == 4.0 and out[2]["v_std_k"] is None
    counts = {r["TransactionID"]: r["k_count_full"] for r in groupstats.count_encode(df, ["k"]).collect()}
    assert counts == {1: 1, 2: 2, 3: 2}


def test_fingerprint_tells_null_places_apart(spark):
    df = spark.createDataFrame([("1", None), (None, "1"), (None, None)], "a string, b string")
    prints = [r[0] for r in df.select(groupstats.fingerprint(["a", "b"])).collect()]
    assert prints[2] is None and prints[0] != prints[1]


def test_ratio_rules(spark):
    df = spark.createDataFrame([(1.0, 0.0), (-1.0, 0.0), (0.0, 0.0), (3.0, 2.0)], "a double, b double")
    assert [r[0] for r in df.select(ratio("a", "b")).collect()] == [None, None, None, 1.5]
    assert [r[0] for r in df.select(ratio("a", "b", "inf")).collect()] == [float("inf"), float("-inf"), None, 1.5]
    filled = fill_constant(df.select(ratio("a", "b", "inf").alias("r")), -999.0, -1.0)
    assert [r[0] for r in filled.collect()] == [-1.0, -1.0, -999.0, 1.5]


@pytest.mark.parametrize("value,shown", [(1.0, "1.0"), (1e7, "10000000.0"), (12345678.5, "12345678.5"), (0.5, "0.5"),
                                         (0.00025, "0.00025"), (-3.25, "-3.25"), (float("nan"), None)])
def test_number_text(spark, value, shown):
    assert spark.createDataFrame([(value,)], "x double").select(number_text(F.col("x"))).first()[0] == shown


def test_last_rule_wins(spark):
    df = spark.createDataFrame([("samsung sm-g build",), ("windows ios",), ("zzz",), (None,)], "d string")
    assert [r[0] for r in df.select(text.last_match("d", text.DEVICE_RULES)).collect()] == ["samsung", "ios", None, None]


def test_vocabulary_last_entry_and_unknown(spark):
    entries = spark.createDataFrame([("a", 1, 0), ("b", 2, 1), ("a", 9, 2)], "key string, code int, pos int")
    df = spark.createDataFrame([("a",), ("b",), ("c",), ("unknown",), (None,)], "w string")
    got = {r["w"]: r["code"] for r in encoders.vocabulary_encode(df, entries, "w", "code").collect()}
    assert got == {"a": 9, "b": 2, "c": None, "unknown": 10000, None: None}


def test_shared_dictionary_shares_and_separates(spark):
    df = spark.createDataFrame([(1, "1", 1, 1.0, "train"), (2, "1", 1, 1.0, "test"), (3, "q", 2, 7.0, "train")],
                               "TransactionID bigint, s string, i int, d double, split string")
    out = {r["TransactionID"]: r for r in encoders.encode_categories(df, ["s", "i", "d"]).collect()}
    assert out[1]["i"] == out[1]["d"] != out[1]["s"]
    assert (out[3]["s"], out[3]["i"], out[3]["d"]) == (-999, -999, -999)
    assert {out[1]["i"], out[1]["s"]} == {1, 2}


def test_narrowing_loses_nothing(spark):
    df = spark.createDataFrame([(1, 1.0, 0.1, None), (300, 2.0, 1e9 + 0.5, 1.5)], "a bigint, b double, c double, d double")
    types = {r["column"]: r["to_type"] for r in narrowing_profile(df).collect()}
    assert types == {"a": "smallint", "b": "tinyint", "c": "double", "d": "float"}
    assert sorted(map(tuple, narrow(df).select("a", "b").collect())) == [(1, 1), (300, 2)]
    odd = spark.createDataFrame([(1.0,), (1.0005,)], "x double")
    assert narrowing_profile(odd).first()["to_type"] == "float"


def brute_type(values, whole, max_loss=0.001, avg_loss=0.001, na_loss=0, unique_loss=0):
    """The narrowest type, tried value by value."""
    import numpy as np
    filled, nulls = [v for v in values if v is not None], values.count(None)
    for kind, bits in [*([("tinyint", 8), ("smallint", 16), ("int", 32)] if nulls <= na_loss else []), ("float", 0)]:
        if bits:
            tried = [None if abs(v) >= 2.0 ** 62 else int(Decimal(v).quantize(0, ROUND_HALF_UP)) for v in filled]
            tried = [None if t is None or not -2 ** (bits - 1) <= t < 2 ** (bits - 1) else t for t in tried]
        else:
            with np.errstate(over="ignore"):
                tried = [float(np.float32(v)) for v in filled]
        gaps = [abs(t - v) for t, v in zip(tried, filled) if t is not None]
        fine = not gaps or (max(gaps) <= max_loss and sum(gaps) / len(gaps) <= avg_loss)
        lost = len({*values}) - len({*tried, *([None] if nulls else [])})
        if fine and tried.count(None) <= na_loss and abs(lost) <= unique_loss:
            return kind
    return "bigint" if whole else "double"


@pytest.mark.parametrize("limits", [{}, {"na_loss": 2}, {"unique_loss": 1}, {"max_loss": 0.6, "avg_loss": 0.3, "unique_loss": 2}])
def test_narrowing_against_every_value(spark, limits):
    rng = random.Random(7)
    wide = [100, 127, 128, -129, 40_000, 2 ** 24 + 1, 2 ** 31, 2 ** 53 + 1, None]
    real = [1.0, 1.0004, 1.0005, 0.1, 2.5, 3.0, -0.0, 0.0, 300.0, 16777217.0, 1e9 + 0.5, 1e300, None]
    columns = {f"w{k}": [rng.choice(wide[:rng.randrange(1, 10)] + wide[-1:] * (k % 2)) for _ in range(12)] for k in range(10)}
    columns |= {f"r{k}": [rng.choice(rng.sample(real, 3)) for _ in range(12)] for k in range(20)}
    columns |= {"none": [None] * 12, "rwhole": [1.0, 2.0] * 6}
    df = spark.createDataFrame(list(zip(*columns.values())), ", ".join(
        f"{c} {'double' if c.startswith('r') else 'bigint'}" for c in columns))
    want = {c: brute_type(v, not c.startswith("r"), **limits) for c, v in columns.items()}
    rows = narrowing_profile(df, **limits).collect()
    assert {r["column"]: r["to_type"] for r in rows} == want
    assert {r["column"]: (r["nulls"], r["distincts"]) for r in rows} == {c: (v.count(None), len(set(v))) for c, v in columns.items()}
    assert {c: k for c, k in narrowing.narrowed_types(df, **limits).items()} == {
        c: k for c, k in want.items() if k != ("double" if c.startswith("r") else "bigint")}
    assert len(set(want.values())) >= 5


def test_narrowing_without_rows_or_numbers(spark):
    df = spark.createDataFrame([], "a bigint, b double, s string")
    assert narrowing_profile(df).collect() == [] and narrow(df).schema == df.schema
    assert narrowing.narrowing_report(df).collect() == [] and narrowing_profile(df.select("s")).collect() == []


def test_whole_types_need_one_aggregate(spark):
    """Exact types are settled without a shuffle of rows, and counting distinct values multiplies no row by types."""
    df = spark.range(1000).selectExpr("id as a", "id * 0.5d as b", "cast(id as double) as c")
    assert narrowing.narrowed_types(df) == {"a": "smallint", "b": "float", "c": "smallint"}
    plan = narrowing_profile(df)._jdf.queryExecution().optimizedPlan().toString()
    assert "Expand" not in plan and "count(distinct" not in plan


def test_narrowing_of_a_wide_table(spark):
    """Generated code does not grow with the product of columns and types."""
    df = spark.range(50).select(*[(F.col("id") * (i % 7) * (1.0 if i % 2 else 0.1)).alias(f"V{i}") for i in range(339)])
    types = narrowing.narrowed_types(df)
    assert len(types) > 150 and types["V1"] == "tinyint" and types["V13"] == "smallint"


def test_text_categories(spark):
    rows = [(1, "b", None, 1.0), (2, "a", "x", 2.0), (3, "B", None, 3.0), (4, "b", "", 4.0)]
    df = spark.createDataFrame(rows, "k bigint, s string, t string, v double")
    made, words = narrowing.reduce_table(df, text_codes=True)
    assert dict(made.dtypes) == {"k": "tinyint", "s": "tinyint", "t": "tinyint", "v": "tinyint"}
    assert sorted(map(tuple, made.collect())) == [(1, 2, None, 1), (2, 1, 1, 2), (3, 0, None, 3), (4, 2, 0, 4)]
    assert sorted(map(tuple, words.collect())) == [("s", "B", 0), ("s", "a", 1), ("s", "b", 2), ("t", "", 0), ("t", "x", 1)]
    many = spark.range(200).selectExpr("cast(id as string) as s", "cast(null as string) as t")
    made, words = narrowing.text_categories(many)
    assert dict(made.dtypes) == {"s": "smallint", "t": "tinyint"} and words.count() == 200
    plain, words = narrowing.reduce_table(df)
    assert dict(plain.dtypes)["s"] == "string" and words.count() == 0


def test_constant_columns_ignore_null(spark):
    df = spark.createDataFrame([(1, None, "x"), (1, None, None)], "a int, b int, c string")
    assert constant_columns(df) == ["a", "c"]


def test_rank_fusion_keeps_ranks(spark):
    rng = random.Random(5)
    df = spark.createDataFrame([(i, rng.random() < 0.6, rng.random(), rng.random()) for i in range(60)],
                               "TransactionID bigint, seen boolean, p double, q double")
    out = blend.rank_fused(df, "seen", "p", "q", chunks=4).join(df, "TransactionID").toPandas()
    assert sorted(out["fused_rank"]) == list(range(60))
    unseen = out[~out["seen"]]
    assert list(unseen.sort_values("fused_rank")["TransactionID"]) == list(unseen.sort_values("q")["TransactionID"])


def test_users_without_identity_get_null(spark):
    df = spark.createDataFrame([(1, 10, 5.0, "a", None), (2, 11, 7.0, "a", None), (3, 12, 9.0, None, None)],
                               "TransactionID bigint, TransactionDT bigint, TransactionAmt double, id_01 string, id_02 string")
    out = {r["TransactionID"]: r for r in groupstats.user_stats(df, ["id_01", "id_02"]).collect()}
    assert out[1]["user_trx_cnt"] == 2 and out[2]["user_TransactionAmt_mean"] == 6.0
    assert out[3]["user_trx_cnt"] is None and len(out) == 3


@pytest.mark.parametrize("threshold", ["10m", "1", "-1"])
def test_lookups_are_the_same_at_any_size(spark, threshold):
    """Null and repeated row keys stay one row each, whatever Catalyst broadcasts."""
    df = spark.createDataFrame([(1, "a", "x"), (1, "a", None), (None, "b", "x"), (2, None, "y")],
                               "TransactionID bigint, g string, v string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    try:
        out = sorted(map(tuple, groupstats.count_encode(df, ["g", "v"]).collect()), key=str)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert out == sorted([(1, "a", "x", 2, 2), (1, "a", None, 2, 1), (None, "b", "x", 1, 2), (2, None, "y", 1, 1)], key=str)


@pytest.mark.parametrize("wide", [False, True])
def test_client_history_is_the_same_at_any_width(spark, wide):
    """Repeated keys stay one row each, and rows without client have no history."""
    df = spark.createDataFrame([(k, t, c, 1.0, t % 2) for k in (1, 2, 3) for t, c in ((k, "a"), (k + 10, None))],
                               "TransactionID bigint, TransactionDT bigint, g string, TransactionAmt double, isFraud int")
    df = df.withColumn("TransactionID", F.lit(7).cast("bigint"))
    df = df.withColumn("more", F.lit("m")) if wide else df
    previous = clients.previous_label(df, "g").collect()
    assert len(previous) == 6 and all(r.previous_isfraud is None for r in previous if r.g is None)
    assert sorted(r.previous_isfraud for r in previous if r.previous_isfraud is not None) == [0, 1]
    sequence = clients.sequence_features(df, "g").collect()
    assert sorted(r.seq_position for r in sequence if r.g) == [1, 2, 3]
    assert all(r.seq_position is None and r.seq_length is None for r in sequence if r.g is None)
    past = clients.past_target_mean(df, "g").collect()
    assert len(past) == 6 and all(r.g_past_mean is None for r in past if r.g is None)
    trailing = clients.trailing_activity(df, "g").collect()
    assert len(trailing) == 6 and all(r.prev_day_count is None for r in trailing if r.g is None)


def test_blends_neither_cap_nor_drop(spark):
    rows = spark.createDataFrame([(1, "x", 0.9), (1, "y", 0.5)], "TransactionID bigint, model string, prediction double")
    assert blend.weighted_blend(rows, {"x": 1, "y": 0}).first().prediction == 0.9
    with pytest.raises(Exception, match="no weight for model y"):
        blend.weighted_blend(rows, {"x": 1}).collect()
    known = spark.createDataFrame([(1, "a", "train", 1, 0.9), (2, "a", "test", None, 0.9), (3, "a", "test", None, 0.95)],
                                  "TransactionID bigint, client string, split string, isFraud int, prediction double")
    raised = {r.TransactionID: r.prediction for r in blend.raise_known(known, "client", 1.2).collect()}
    assert raised[2] == pytest.approx(1.08) and raised[3] == pytest.approx(1.14)


def test_spearman_counts_rows_of_repeated_and_missing_keys(spark):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"a": rng.normal(size=100), "isFraud": rng.integers(0, 2, 100)})
    pdf["b"] = pdf["a"] + pdf["isFraud"] * 3 + rng.normal(size=100)
    pdf["TransactionID"] = [None if i % 10 == 0 else float(i // 2) for i in range(100)]
    df = spark.createDataFrame(pdf).withColumn("TransactionID", F.expr("cast(nullif(TransactionID, double('nan')) as bigint)"))
    row = correlation.spearman_pairs(df, ["a", "b"], chunks=3).first()
    assert row["n"] == 100
    assert row["rho"] == pytest.approx(pdf[["a", "b"]].corr(method="spearman").iloc[0, 1])
    assert correlation.related_columns(df, ["a", "b"], "isFraud", rho=0.5) == ["b"]
    assert correlation.related_columns(df, ["a", "b"], "isFraud", ks=0.5) == ["b"]
    assert correlation.related_columns(df, ["a", "b"], "isFraud", rho=0.0, ks=0.0) == ["a", "b"]


def test_null_counts_one_row_per_column(spark):
    df = spark.createDataFrame([(1, None), (None, None), (3, "x")], "a int, b string")
    assert {tuple(r) for r in narrowing.null_counts(df, ["a", "b"]).collect()} == {("a", 1), ("b", 2)}
    assert {tuple(r) for r in narrowing.null_counts(df.limit(0), ["a"]).collect()} == {("a", 0)}


def test_whole_fold_trains_on_all_rows(spark):
    df = spark.createDataFrame([(i, i % 7) for i in range(14)], "TransactionID bigint, period int")
    got = folds.time_folds(df, "period", folds.TIME_SCHEMES["expanding"], whole=True)
    last = got.where("fold = 3").collect()
    assert sorted(r["TransactionID"] for r in last) == list(range(14))
    assert {r["role"] for r in last} == {"train"}
    assert sum(folds.EXPANDING_WEIGHTS.values()) == pytest.approx(1) and sorted(folds.EXPANDING_WEIGHTS) == [0, 1, 2, 3]


def test_running_totals_exchange_rows_once(rows):
    """The windows inside chunks use the one exchange that deals out the chunks."""
    dealt = ordered.chunked(rows, ["g"], ["TransactionDT", "TransactionID"], 6)
    inside = Window.partitionBy(ordered.CHUNK, "g").orderBy("TransactionDT", "TransactionID")
    plan = dealt.withColumn("n", F.row_number().over(inside))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Window" in plan
    assert dealt.groupBy(F.spark_partition_id()).agg(F.count_distinct(ordered.CHUNK).alias("n")).where("n > 1").isEmpty()


@pytest.mark.parametrize("chunks", [2, 9])
def test_chunks_follow_the_order(spark, chunks):
    """Nulls first, odd values and repeated keys; every chunk lies before the next one."""
    data = [(None if i % 9 == 0 else f'k"{i % 4}\n', None if i % 7 == 0 else [float("nan"), float("inf"), -0.0, i / 3][i % 4],
             i % 5) for i in range(300)]
    df = spark.createDataFrame(data, "g string, x double, i int")
    got = ordered.chunked(df, ["g"], ["x", "i"], chunks).groupBy(ordered.CHUNK).agg(
        F.min(F.struct("g", "x", "i")).alias("low"), F.max(F.struct("g", "x", "i")).alias("high"), F.count("*").alias("n"))
    pairs = got.alias("a").join(got.alias("b"), F.col(f"a.{ordered.CHUNK}") < F.col(f"b.{ordered.CHUNK}"))
    assert pairs.where("a.high >= b.low").isEmpty() and got.agg(F.sum("n")).first()[0] == 300 and got.count() > 1


def test_running_totals_of_an_empty_table(rows):
    assert running_totals(rows.where("false"), ["g"], ["TransactionDT"], {"n": F.lit(1)}).collect() == []
    assert previous_value(rows.where("false"), ["g"], ["TransactionDT"], "v", "p").collect() == []
