"""Steps whose work must not grow faster than their rows."""

import re

import pytest
from pyspark.ml.classification import LogisticRegression, NaiveBayes
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from txloom.llm import columns, passages
from txloom.operators import blend, groupstats, training
from txloom.operators.folds import kfold
from txloom.operators.training import assemble, cross_validate, stacked_vectors
from txloom.schema import KEY


def exchanges(df) -> int:
    return len(re.findall(r"Exchange hashpartitioning", df._jdf.queryExecution().executedPlan().toString()))


def test_predictions_are_grouped_once(spark):
    rows = [("a", 0, 1, 1, 0.25), ("b", 0, 1, 1, 0.75), ("a", 0, 2, 0, 0.5), ("a", 0, 2, 0, 1.0), ("b", 0, 2, 0, None),
            ("other", 1, 3, 1, 0.9), ("a", 0, None, 1, 0.1)]
    oof = spark.createDataFrame(rows, f"model string, fold int, {KEY} long, label int, prediction double")
    made = stacked_vectors(oof, ["b", "a"])
    assert exchanges(made) == 1
    found = {r[KEY]: (r["fold"], r["label"], r["features"].toArray().tolist()) for r in made.collect()}
    assert found == {1: (0, 1.0, [0.75, 0.25]), 2: (0, 0.0, [0.5, 0.75]), 3: (1, 1.0, [0.5, 0.5])}


def test_tuning_puts_predictions_side_by_side_once(spark, monkeypatch):
    rows = [(m, f, "valid" if k % 2 == f else "train", k, k % 3 % 2, (k * s % 11) / 11) for m, s in (("a", 3), ("b", 5))
            for f in (0, 1) for k in range(24)]
    oof = spark.createDataFrame(rows, f"model string, fold int, role string, {KEY} long, label int, prediction double")
    single = {c: blend.stacking_score(oof, ["a", "b"], c) for c in (0.1, 1.0)}
    calls, wide = [], blend.wide_predictions
    monkeypatch.setattr(blend, "wide_predictions", lambda *a: calls.append(1) or wide(*a))
    assert blend.tune_stacking(oof, ["a", "b"], (0.1, 1.0)) == single
    assert len(calls) == 1


def test_small_tables_are_looked_up_without_joins(spark, monkeypatch):
    rows = spark.createDataFrame([("a", 1, "x", None), ("b", None, None, 2.5), (None, 1, "x", 0.0), ("a", 3, None, 2.5), ("a", 3, None, 2.5)],
                                 "split string, a int, b string, c double")
    none = rows.where("split = 'z'")

    def made() -> list:
        stats = [groupstats.settle(groupstats.group_stats(rows, ["a", "b"], ["c"], ("mean", "std"), w), "stats", "column") for w in ((), ("split",))]
        wanted = {"a": {"m": "c_mean"}, "b": {"n": "c_mean", "o": "c_std"}}
        return [groupstats.count_encode(rows, ["a", "b", "c"]), groupstats.count_encode(rows, ["a", "b", "c"], within=["split"]),
                groupstats.count_encode(rows, ["a", "b"], counted=none), groupstats.count_encode(none, ["a", "b"]),
                groupstats.attach_long(rows, stats[0], wanted, null_safe=False), groupstats.attach_long(rows, stats[1], wanted, ["split"], null_safe=False)]

    def found(frames: list) -> list:
        return [(df.schema, sorted(map(str, df.collect()))) for df in frames]

    looked = made()
    assert not any("Join" in df._jdf.queryExecution().executedPlan().toString() for df in looked)
    monkeypatch.setattr(groupstats, "FEW", 3)
    some = made()
    monkeypatch.setattr(groupstats, "FEW", -1)
    joined = made()
    assert found(looked) == found(joined) == found(some)


def test_passage_classes_hold_no_more_than_is_read(spark, monkeypatch):
    words = " ".join(f"w{i}" for i in range(90))
    docs = spark.createDataFrame([(1, words), (2, f"other {words}"), (None, words), (3, f"{words} {words}")], "doc_id long, text string")
    written, plain = {}, passages.settle

    def settle(df, name, **options):
        written[name] = plain(df, name, **options)
        return written[name]

    monkeypatch.setattr(passages, "settle", settle)
    found = {(r["doc_id"], s["start"], s["end"]) for r in passages.repeated_passages(docs).collect() for s in r["spans"]}
    whole, size = len(words), len(words) + 1
    assert found == {(2, 6, 6 + whole), (None, 0, whole), (3, 0, whole), (3, size, size + whole)}
    classes = written["classes"]
    assert classes.schema["first"].dataType.names == ["no_id", "doc_id", "place", "at"]
    assert classes.where("n = 1").count() > 0 and classes.where("n = 1 and whole is not null").count() == 0


def test_a_frequent_gram_is_split_over_tasks(spark, monkeypatch):
    rare = [(k, "".join(chr(97 + (k * 7 + i * i) % 26) for i in range(30))) for k in range(300)]
    docs = spark.createDataFrame(rare + [(1000 + k, f"{k:05d}" + "ab" * 400) for k in range(100)] + [(None, rare[0][1])],
                                 "doc_id long, text string").repartition(8)
    plain, seen = columns._pieces, []
    monkeypatch.setattr(columns, "_pieces", lambda d, chosen, n: seen.append(chosen) or plain(d, chosen, n))
    options = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4k",
               "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "4k",
               "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k, None) for k in options}
    try:
        for k, v in options.items():
            spark.conf.set(k, v)
        columns.repeated_spans(docs, 20, 6)
        rows = seen[0].collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
    assert max(r["n"] for r in rows) > 20_000 and all(r["n"] > 1 for r in rows)
    assert "skew=true" in seen[0]._jdf.queryExecution().executedPlan().toString()


def _predictions(spark):
    """Two models, three folds, many equal predictions, keys of several rows or missing."""
    rows = [(m, f, "valid" if k % 3 == f else "train", None if k == 50 else k // 2 if k < 20 else k, k % 7 % 2, (k * s % 5) / 5)
            for m, s in (("a", 3), ("b", 4)) for f in range(3) for k in range(60)]
    return spark.createDataFrame(rows, f"model string, fold int, role string, {KEY} long, label int, prediction double")


def test_stackers_fit_what_differs_and_read_their_own_fold(spark, monkeypatch):
    oof, seen = _predictions(spark), []
    wide = oof.groupBy("fold", "role", KEY, "label").pivot("model", ["a", "b"]).agg(F.max("prediction"))
    plain = VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(wide)
    want, distinct = {}, []
    for f in range(3):
        train = plain.where(f"fold = {f} and role = 'train'").cache()
        distinct.append(train.select("label", "a", "b").distinct().count())
        assert distinct[-1] < train.count()
        model = LogisticRegression(regParam=1 / (0.5 * train.count()), elasticNetParam=0.0, standardization=False, tol=1e-8).fit(train)
        scored = model.transform(plain.where(f"fold = {f}"))
        want.update({(f, r["role"], r[KEY], r["label"]): r["p"] for r in scored.select(
            "role", KEY, "label", vector_to_array("probability")[1].alias("p")).collect()})
    fit = LogisticRegression._fit
    monkeypatch.setattr(LogisticRegression, "_fit", lambda self, rows: seen.append(rows.count()) or fit(self, rows))
    done, tested = blend.stack_models(oof, ["a", "b"], 0.5, oof.where("role = 'valid'").drop("role", "label"))
    assert sorted(seen) == sorted(distinct)
    got = {(r["fold"], r["role"], r[KEY], r["label"]): r["prediction"] for r in done.collect()}
    assert got.keys() == want.keys() and max(abs(got[k] - want[k]) for k in want) < 1e-4
    for made in (done.where("role = 'valid'"), tested):
        plan = made._jdf.queryExecution().executedPlan().toString()
        assert len(re.findall(r"PartitionFilters: \[[^\]]*fold", plan)) == 3
    monkeypatch.undo()
    holed = oof.withColumn("prediction", F.when((F.col("model") == "b") & (F.col(KEY) == 30), None).otherwise(F.col("prediction")))
    with pytest.raises(Exception, match="no prediction of model b"):
        blend.stack_folds(holed, ["a", "b"]).collect()


def test_cross_validation_writes_a_row_once(spark, monkeypatch):
    rows = spark.range(90).selectExpr(f"if(id = 7, null, id div 2) as {KEY}", "cast(id % 2 as int) as isFraud", "id % 3 as a", "id % 5 as b")
    written, plain = {}, training.settle

    def settle(df, name, **options):
        written[name] = plain(df, name, **options)
        return written[name]

    monkeypatch.setattr(training, "settle", settle)
    train, models = assemble(rows, ["a", "b"], [KEY, "isFraud"]), {n: NaiveBayes(labelCol="isFraud", smoothing=s) for n, s in (("x", 1.0), ("y", 2.0))}
    oof, _, tested = cross_validate(models, train, kfold(rows, 3), train.drop("isFraud"))
    assert oof.count() == tested.count() == 90 * 3 * 2
    assert written["oof"].count() == written["tested"].count() == 90
