"""Sources, pruned cross-validation, search and the feature chain."""

from multiprocessing.pool import ThreadPool

import numpy as np
import pytest
from pyspark.ml import PipelineModel, Pipeline
from pyspark.ml.classification import DecisionTreeClassifier, NaiveBayes
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from txloom.operators.folds import TIME_SCHEMES, kfold, time_folds
from txloom.operators.stages import ImportanceSelector, ModelFeature, PrunedRatios, SharedDictionary
from txloom.operators.training import (
    PrunedCV, assemble, booster, cross_validate, eliminate_models, important_columns, more_rounds, predict, predict_all, second_stage,
    stacked_vectors,
)
from txloom.plans.features import FeatureOptions, feature_columns, feature_table, group_features
from txloom.plans.scoring import make_folds, score_test
from txloom.plans.search import SPACES, Range, Study, sample_params, tree_params
from txloom.queries.fixtures import joined
from txloom.schema import KEY, identity_schema, transaction_schema
from txloom.session import scratch_path, shared_dir
from txloom.sources import sinks
from txloom.sources.sinks import append_trials, claim_trial, read_trials
from txloom.sources.tables import import_data, reuse_or_build

FOLDER = "/root/testdata/sf0.001"


def scores(values):
    return lambda fold: values[fold]


def test_pruned_cv_by_hand():
    cv = PrunedCV(4, 0.1)
    assert cv.run(scores([1.0, 1.0, 1.0, 1.0])) == 1.0
    # After two folds 1.2 > 1.0 * 1.1: stopped, scaled to the best run's mean.
    assert cv.run(scores([1.1, 1.3])) == pytest.approx(1.2)
    assert cv.pruned
    assert cv.run(scores([1.05, 1.05, 1.05, 1.05])) == pytest.approx(1.05)
    assert not cv.pruned and cv.best == [1.0] * 4
    assert cv.run(scores([0.9, 0.9, 0.9, 0.9])) == pytest.approx(0.9)
    assert cv.best == [0.9] * 4


def test_pruned_cv_maximises_negated():
    cv = PrunedCV(3, 0.1, minimize=False)
    assert cv.run(scores([0.8, 0.8, 0.8])) == pytest.approx(-0.8)
    # -0.8 < -0.7 * 1.1 holds: stopped after two folds.
    assert cv.run(scores([0.7, 0.7])) == pytest.approx(-0.7)
    assert cv.pruned


@pytest.mark.parametrize("args,error", [((2.0,), TypeError), ((1,), ValueError), ((3, 1), TypeError), ((3, -0.1), ValueError)])
def test_pruned_cv_checks_arguments(args, error):
    with pytest.raises(error):
        PrunedCV(*args)


def test_pruned_cv_rejects_whole_scores():
    with pytest.raises(TypeError):
        PrunedCV(2).run(scores([1, 2]))


def test_shared_dir_is_the_named_one(spark):
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")


def test_search_resumes(spark):
    path = scratch_path(spark, "study")
    space = {"x": Range(0.0, 1.0), "n": Range(1, 9, "int"), "r": Range(0.001, 1.0, "loguniform")}
    Study(spark, path, "s", space).optimize(lambda p: p["x"], trials=2)
    study = Study(spark, path, "s", space)
    study.optimize(lambda p: p["x"], trials=2)
    history = sorted(study.history.collect(), key=lambda r: r["trial"])
    assert [r["trial"] for r in history] == [0, 1, 2, 3]
    assert [r["params"]["x"] for r in history] == [sample_params(space, t)["x"] for t in range(4)]
    best = study.best_params()
    assert best["x"] == min(r["params"]["x"] for r in history) and isinstance(best["n"], int)


def test_runs_share_a_history(spark):
    path, space = scratch_path(spark, "study"), {"x": Range(0.0, 1.0)}
    one, two = (Study(spark, path, "a/b c", space) for _ in range(2))

    def meanwhile(params):
        if len(two.open_trials()) == 1:  # while a trial of the first run is open, the second does two
            two.optimize(lambda p: p["x"], trials=2)
        return params["x"]

    one.optimize(meanwhile, trials=1)
    one.optimize(lambda p: p["x"], trials=3, parallelism=3)
    found = {r["trial"]: r["params"]["x"] for r in one.history.collect()}
    assert one.history.count() == 6 and found == {t: sample_params(space, t)["x"] for t in range(6)}
    assert Study(spark, path, "other", space).history.count() == 0


def test_claims_of_many_threads_differ(spark):
    path = scratch_path(spark, "study")
    with ThreadPool(6) as pool:
        assert sorted(pool.map(lambda _: claim_trial(spark, path, "s"), range(12), chunksize=1)) == list(range(12))
    files, place = sinks._claims(spark, path, "s")
    assert not sinks._created(files, spark._jvm.org.apache.hadoop.fs.Path(place, "3"))


def test_lost_trials_are_done_once(spark):
    path, space = scratch_path(spark, "study"), {"x": Range(0.0, 1.0)}
    study = Study(spark, path, "s", space)
    assert [claim_trial(spark, path, "s") for _ in range(2)] == [0, 1]  # a run that claimed two and died
    study.optimize(lambda p: p["x"], trials=1)
    assert study.open_trials() == [0, 1]
    study.optimize(lambda p: p["x"], trials=3, finish_open=True)
    assert study.open_trials() == [] and sorted(r["trial"] for r in study.history.collect()) == [0, 1, 2, 3]
    append_trials(spark, path, [("s", 0, {"x": 0.5}, 0.5)])
    assert read_trials(spark, path, "s").count() == 4
    with pytest.raises(ValueError):
        append_trials(spark, path, [("", 0, {}, 0.0)])


def test_spaces_make_boosters(spark):
    assert set(SPACES) == {"gbdt", "dart", "goss", "xgb", "cat"}
    for kind, space in SPACES.items():
        for trial in range(50):
            drawn = sample_params(space, trial)
            assert all(space[n].low <= v <= space[n].high for n, v in drawn.items())
            booster(kind, **tree_params(drawn))
    assert tree_params({"num_leaves": 1500, "max_depth": 1000, "learning_rate": 2.0}) == {"maxDepth": 11, "stepSize": 1.0}


def test_model_elimination_edges(spark):
    rows = [("good", k % 2, k, float(k % 4 < 2), float(k % 4 < 2)) for k in range(40)]
    rows += [("same", k % 2, k, float(k % 4 < 2), 0.3) for k in range(40)]
    rows += [("rare", 0, 0, 1.0, 0.9), ("rare", 0, 0, 1.0, 0.7), ("rare", 0, None, 1.0, 0.9)]
    oof = spark.createDataFrame(rows, f"model string, fold int, {KEY} long, label double, prediction double")
    vectors = {r[KEY]: r["features"].toArray().tolist() for r in stacked_vectors(oof, ["good", "rare", "same"]).collect()}
    assert len(vectors) == 40 and vectors[2] == [0.0, 0.5, 0.3]
    assert vectors[0] == pytest.approx([1.0, 0.8, 0.3])
    left, report = eliminate_models(oof, 1, step=1, estimator=DecisionTreeClassifier(maxDepth=1, labelCol="label"))
    assert left == ["good"]
    assert {r["model"]: r["round"] for r in report.collect()} == {"good": None, "same": 0, "rare": 1}
    assert eliminate_models(oof, 3)[0] == ["good", "rare", "same"]


def test_reuse_builds_once(spark):
    path, calls = scratch_path(spark, "table"), []

    def build():
        calls.append(1)
        return spark.range(3)

    assert reuse_or_build(spark, path, build).count() == 3
    assert reuse_or_build(spark, path, build).count() == 3
    assert len(calls) == 1


def test_import_from_csv(spark):
    path = scratch_path(spark, "input")

    def put(name, schema, values):
        row = tuple(values.get(f.name) for f in schema.fields)
        spark.createDataFrame([row], schema).write.option("header", True).csv(f"{path}/{name}.csv")

    for i, s in enumerate(("train", "test")):
        put(f"{s}_transaction", transaction_schema(s == "train"),
            {KEY: i, "TransactionDT": 86400, "TransactionAmt": 5.5, "isFraud": 0, "card1": 7.0})
        put(f"{s}_identity", identity_schema(), {KEY: 0, "id_31": "edge 17.0"})
    from txloom.schema import SUBMISSION_SCHEMA
    put("sample_submission", SUBMISSION_SCHEMA, {KEY: 1, "isFraud": 0.5})
    rows, template = import_data(spark, path)
    got = {r["split"]: r for r in rows.collect()}
    assert got["train"]["id_31"] == "edge 17.0" and got["test"]["id_31"] is None
    assert got["test"]["isFraud"] is None and template.count() == 1


def test_feature_chain_end_to_end(spark):
    rows = joined(spark, FOLDER)
    table = feature_table(rows, FeatureOptions(threshold=0.9))
    names = feature_columns(table)
    kept = table.cache()
    assert kept.count() == rows.count()
    bad = kept.select(*[F.count_if(F.col(c).isNull() | F.isnan(F.col(c).cast("double"))).alias(c) for c in names]).first()
    assert not [c for c in names if bad[c]]
    assert {f.dataType.typeName() for f in kept.schema.fields if f.name not in ("split",)} <= {
        "long", "integer", "double", "float"}
    done = score_test(kept, names[:12], {"gbdt": booster("gbdt", maxIter=2, maxDepth=2)}, k=2)
    assert done.predictions.count() == rows.where("split = 'test'").count()
    assert 0 <= done.auc <= 1


def test_separable_labels_are_learned(spark):
    rows = spark.range(600).selectExpr("id as TransactionID", "cast(id % 2 as int) as isFraud", "cast(id % 2 + id % 7 / 100 "
                                       "as double) as a", "cast(id % 5 as double) as b", "if(id % 3 = 0, 'test', 'train') as split")
    done = score_test(rows, ["a", "b"], {"gbdt": booster("gbdt", maxIter=2, maxDepth=2)}, k=2)
    assert done.auc > 0.99
    from txloom.operators.training import assemble
    assert important_columns(assemble(rows, ["a", "b"], ["isFraud"]), ["a", "b"]) == ["a"]
    with pytest.raises(ValueError):
        make_folds(rows, 2, "other")


def test_fitted_stages_survive_saving(spark):
    rows = joined(spark, FOLDER).select(KEY, "split", "TransactionAmt", "card4", "ProductCD", "C1", "C2", "D15")
    stages = Pipeline(stages=[SharedDictionary(inputCols=["card4", "ProductCD"]),
                              PrunedRatios(inputCols=["C1", "C2", "D15"], threshold=0.6)])
    fitted = stages.fit(rows)
    path = scratch_path(spark, "saved")
    fitted.write().save(path)
    again = PipelineModel.load(path).transform(rows)
    want = fitted.transform(rows)
    assert again.columns == want.columns
    assert sorted(map(tuple, again.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)


def test_stacked_scores_of_test_rows(spark):
    rows = spark.range(240).select(
        F.col("id").alias("TransactionID"), F.when(F.col("id") % 4 == 3, "test").otherwise("train").alias("split"),
        F.when(F.col("id") % 4 != 3, (F.col("id") % 5 < 2).cast("int")).alias("isFraud"),
        (F.col("id") % 5).alias("a"), (F.col("id") % 3).alias("b"))
    models = {"gbdt": booster("gbdt", maxIter=2, maxDepth=2), "forest": booster("forest", numTrees=3, maxDepth=3)}
    for stacking in ("lr", "mean"):
        done = score_test(rows, ["a", "b"], models, k=2, stacking=stacking)
        got = {r["TransactionID"]: r["prediction"] for r in done.predictions.collect()}
        assert sorted(got) == list(range(3, 240, 4))
        assert min(p for i, p in got.items() if i % 5 < 2) > max(p for i, p in got.items() if i % 5 >= 2)
        assert done.auc == 1.0
    with pytest.raises(ValueError):
        score_test(rows, ["a", "b"], models, k=2, stacking="median")


def test_unknown_metric_fails_before_any_fit(spark):
    with pytest.raises(ValueError):
        PrunedCV(2).cross_val_score(None, spark.range(3), metric="f1")


def test_chain_keeps_rows_of_repeated_and_missing_keys(spark):
    """Group features of 28 rows, five keys repeated and three missing: as many rows, each with the values of its own."""
    base = joined(spark, FOLDER).limit(20)
    repeated = base.limit(5).withColumn("TransactionAmt", F.col("TransactionAmt") + 1)
    missing = base.limit(3).withColumn(KEY, F.lit(None).cast("bigint"))
    rows = base.unionByName(repeated).unionByName(missing)
    rows = spark.createDataFrame(rows.collect(), rows.schema)
    out = group_features(rows)
    assert out.count() == 28
    plain = out.groupBy("card1").agg(F.count("*").alias("n"))
    assert out.join(plain, out["card1"].eqNullSafe(plain["card1"])).where("card1_count_full != n").isEmpty()
    want = sorted((r[KEY] or -1, r["TransactionAmt"]) for r in rows.collect())
    assert sorted((r[KEY] or -1, r["TransactionAmt"]) for r in out.collect()) == want


def _plain_rows(spark, n=240):
    rows = [(None if i % 40 == 7 else i // 2 if i % 9 == 0 else i, i % 7, float(i % 5), float((i * i) % 3), int((i % 5) + (i % 3) > 3)) for i in range(n)]
    return spark.createDataFrame(rows, "TransactionID bigint, period int, a double, b double, isFraud int")


def test_role_aware_folds_train_what_they_name(spark):
    """Every fold's model sees exactly its training rows; a fold without validation has no score; rows outside a fold take no part."""
    rows = spark.createDataFrame([(i, i % 8, float(i % 5), float((i * i) % 3), int((i % 5) + (i % 3) > 3)) for i in range(400)],
                                 "TransactionID bigint, period int, a double, b double, isFraud int")
    folds = time_folds(rows, "period", TIME_SCHEMES["expanding"], whole=True)
    seen = []

    class Watched(NaiveBayes):
        def _fit(self, dataset):
            seen.append(sorted(r[KEY] for r in dataset.select(KEY).collect()))
            return super()._fit(dataset)

    oof, scores, tested = cross_validate({"m": Watched(labelCol="isFraud")}, assemble(rows, ["a", "b"], [KEY, "isFraud"]), folds,
                                         assemble(rows, ["a", "b"], [KEY]))
    spans = [(0, 1, 2, 3), (0, 1, 2, 3, 4), (0, 1, 2, 3, 4, 5), range(8)]
    assert sorted(seen) == sorted(sorted(i for i in range(400) if i % 8 in span) for span in spans)
    got = {(r["fold"], r["role"]): r["n"] for r in oof.groupBy("fold", "role").agg(F.count("*").alias("n")).collect()}
    assert got == {(0, "train"): 200, (0, "valid"): 50, (1, "train"): 250, (1, "valid"): 50, (2, "train"): 300, (2, "valid"): 50, (3, "train"): 400}
    assert {r["fold"]: r["valid_auc"] is None for r in scores.collect()} == {0: False, 1: False, 2: False, 3: True}
    assert tested.count() == 1600


def test_cross_validation_keeps_rows_of_repeated_and_missing_keys(spark):
    rows = _plain_rows(spark)
    train = assemble(rows, ["a", "b"], [KEY, "isFraud"])
    oof, _, _ = cross_validate({"m": NaiveBayes(labelCol="isFraud")}, train, kfold(rows, 3))
    assert oof.count() == 3 * 240 and oof.where("role = 'valid'").count() == 240
    both = oof.where("role = 'valid'").groupBy(KEY).agg(F.count_distinct("fold").alias("n"))
    assert both.agg(F.max("n")).first()[0] == 1
    more = second_stage(train, oof)
    assert more.count() == 240 and more.first()["features"].size == 3


def test_models_score_in_one_pass(spark):
    """The number of scans does not depend on the number of models."""
    rows = assemble(_plain_rows(spark), ["a", "b"], [KEY, "isFraud"])
    path = scratch_path(spark, "rows")
    rows.write.parquet(path)
    rows = spark.read.parquet(path)
    models = [NaiveBayes(labelCol="isFraud", smoothing=float(k + 1)).fit(rows) for k in range(6)]
    scored = predict_all(models, rows, [KEY])
    assert scored._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    one = sorted((r[KEY] or -1, r["prediction"]) for r in predict(models[4], rows).collect())
    same = sorted((r[KEY] or -1, r["predictions"][4]) for r in scored.collect())
    assert np.allclose(one, same, rtol=0, atol=1e-12)


def test_more_rounds_in_later_folds():
    change = more_rounds(1.1, 3)
    assert [change(booster("gbdt", maxIter=20), f).getMaxIter() for f in (0, 2, 3, 4)] == [20, 20, 22, 22]
    assert change(booster("forest", numTrees=10), 3).getNumTrees() == 11
    assert change(NaiveBayes(), 3).getSmoothing() == 1.0


def test_selector_is_fitted_anew_in_every_fit(spark, tmp_path):
    """Two fits of one pipeline choose by their own rows; saved before and after the fit it stays the same."""
    first = spark.createDataFrame([(i, float(i % 2), float(i % 3 == 0), i % 2) for i in range(120)], "id int, a double, b double, isFraud int")
    second = first.withColumn("isFraud", F.col("b").cast("int"))
    stages = [VectorAssembler(inputCols=["a", "b"], outputCol="features"), ImportanceSelector(DecisionTreeClassifier(maxDepth=1), 0.5),
              ModelFeature(booster("forest", numTrees=3), "again", "probability", featuresCol="chosen")]
    Pipeline(stages=stages).write().save(f"{tmp_path}/before")
    loaded = Pipeline.load(f"{tmp_path}/before")
    for rows, place in ((first, 0), (second, 1)):
        fitted = loaded.fit(rows)
        assert fitted.stages[1].getOrDefault("chosen") == [place]
        fitted.write().save(f"{tmp_path}/{place}")
        one, two = (m.transform(rows).orderBy("id").collect() for m in (fitted, PipelineModel.load(f"{tmp_path}/{place}")))
        assert one == two and all(abs(r["again"] - r["isFraud"]) < 0.5 for r in one)
        assert set(one[0].asDict()) == {"id", "a", "b", "isFraud", "features", "chosen", "again"}
    with pytest.raises(ValueError):
        ImportanceSelector(DecisionTreeClassifier(maxDepth=1), 1.5, labelCol="isFraud").fit(stages[0].transform(first))


def test_params_of_the_stage_inside_are_reached():
    tree = DecisionTreeClassifier(maxDepth=1)
    stage = ImportanceSelector(tree)
    assert stage.copy({tree.maxDepth: 4}).inner.getMaxDepth() == 4 and stage.inner.getMaxDepth() == 1
    assert stage.copy({stage.threshold: 0.3}).getThreshold() == 0.3
