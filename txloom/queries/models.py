"""Checked queries: folds, training, stacking and search.

Fits of iterative models have no SQL counterpart; their queries return
predictions or scores for all rows and are checked for rows only.
"""

from __future__ import annotations

from multiprocessing.pool import ThreadPool

import numpy as np
from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier, NaiveBayes
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import functions as F

from ..functions.emails import last_part
from ..operators import blend
from ..operators.folds import EXPANDING_WEIGHTS, TIME_SCHEMES, group_kfold, kfold, stratified_kfold
from ..operators.groupstats import card_counts
from ..operators.impute import fill_constant
from ..operators.metrics import auc, auc_value
from ..operators.stages import (
    CategoryLimit, DropConstant, FillMissing, FrequencyEncoder, ImportanceSelector, ModelFeature, SelectColumns, TargetEncoder,
)
from ..operators.training import (
    PrunedCV, assemble, booster, class_feature, cross_validate, eliminate, eliminate_models, predict, reduced, second_stage,
    second_stage_test,
    seed_average, selection_stages, with_stage_params,
)
from ..plans.scoring import score_expanding, score_test
from ..plans.search import SPACES, Range, Study, tree_params
from ..schema import KEY
from ..session import parallelism, scratch_path, settle
from .fixtures import MODELS, oof, sql, tx, vmat
from .groups import auc_sql
from .registry import query
from .tools import tidy


def block_sql(rank: str, n: str, k: int) -> str:
    """Fold of the 0-based ``rank`` among ``n`` rows cut into k blocks, the first n mod k one longer."""
    edge = f"({n} % {k}) * ({n} // {k} + 1)"
    return f"cast(case when {rank} < {edge} then {rank} // ({n} // {k} + 1) else {n} % {k} + ({rank} - {edge}) // ({n} // " \
           f"{k}) end as bigint)"


@query("i1_kfold", sql(f"select TransactionID, {block_sql('r', 'n', 7)} as fold from (select TransactionID, row_number() over "
                       "(order by TransactionID) - 1 as r, count(*) over () as n from tx)", "tx"))
def i1(spark, folder):
    return tidy(kfold(tx(spark, folder), 7))


@query("i1_kfold_shuffled", sql(
    f"select TransactionID, {block_sql('r', 'n', 6)} as fold from (select TransactionID, row_number() over (order by "
    "(TransactionID % 10007 * 7919 + 5 * 104729) % 10007, TransactionID) - 1 as r, count(*) over () as n from tx)", "tx"))
def i1_shuffled(spark, folder):
    return tidy(kfold(tx(spark, folder), 6, shuffle=True, seed=5, portable=True))


@query("i2_stratified_kfold", sql(
    f"select TransactionID, {block_sql('r', 'n', 5)} as fold from (select TransactionID, row_number() over (partition by "
    "isFraud order by (TransactionID % 10007 * 7919 + 5 * 104729) % 10007, TransactionID) - 1 as r, count(*) over (partition "
    "by isFraud) as n from tx)", "tx"))
def i2(spark, folder):
    return tidy(stratified_kfold(tx(spark, folder), 5, shuffle=True, seed=5, portable=True))


@query("i3_group_kfold", sql(
    "+ g as (select card1, count(*) as n, row_number() over (order by count(*) desc, card1) as rn from tx group by card1), "
    "walk(rn, loads, card1, fold) as (select 0::bigint, [0, 0, 0, 0]::bigint[], null::bigint, null::bigint union all select "
    "g.rn, [case when i = list_position(loads, list_min(loads)) then loads[i] + g.n else loads[i] end for i in [1, 2, 3, "
    "4]], g.card1, list_position(loads, list_min(loads)) - 1 from walk join g on g.rn = walk.rn + 1) select TransactionID, "
    "cast(fold as bigint) as fold from tx join walk using (card1)", "tx"))
def i3(spark, folder):
    return tidy(group_kfold(tx(spark, folder), 4, "card1"))


_NAMES = ["TransactionAmt", "C1", "C2", "C3", "D1", "D15", "card1", "card1_count_full", "card2_count_full"]


def model_rows(spark, folder):
    """Filled numeric features of all rows, with split and label."""
    rows = card_counts(tx(spark, folder).select(KEY, "split", "isFraud", *_NAMES[:7], "card2"))
    return settle(fill_constant(rows, columns=_NAMES), "inputs")


def small(kind: str = "gbdt", **params):
    return booster(kind, **{"maxDepth": 3, **({"numTrees": 5} if kind == "forest" else {"maxIter": 3}), **params})


def train_part(spark, folder):
    return assemble(model_rows(spark, folder).where("split = 'train'"), _NAMES, [KEY, "isFraud"])


@query("i4_cross_validation")
def i4(spark, folder):
    """Scores per fold of two models, and the mean of the stacked test predictions."""
    done = score_test(model_rows(spark, folder), _NAMES, {"gbdt": small(), "forest": small("forest")}, k=5)
    mean = done.predictions.agg(F.avg("prediction").alias("m"), F.count(F.lit(1)).alias("n")).first()
    return tidy(done.scores.withColumns({"mean_prediction": F.lit(mean["m"]), "test_rows": F.lit(mean["n"])}))


# A model with a closed form lets SQL follow a whole cross-validation: fits, scores and test predictions.
_FLAGS = {"f1": "C1 > 3", "f2": "card6 = 'credit'", "f3": "D1 > 20", "f4": "C3 > 5", "f5": "C2 > 1"}
_SPAN = "cast(floor((TransactionDT - 86400) / 259200) as bigint)"


def flag_rows(spark, folder):
    """Five flags per row, its split, label and span of three days."""
    return tx(spark, folder).selectExpr(KEY, "split", "isFraud", f"{_SPAN} as period", *[
        f"cast({e} as double) as {n}" for n, e in _FLAGS.items()])


def bayes():
    return NaiveBayes(modelType="bernoulli", smoothing=1.0, featuresCol="features", labelCol="isFraud")


def _bayes_sql(folds: str) -> str:
    """CTEs ``fit`` (a row per fold) and ``scored`` (every row and fold), for (TransactionID, fold, role) rows ``folds``."""
    flags = ", ".join(f"cast({e} as double) as {n}" for n, e in _FLAGS.items())
    sums = ", ".join(f"sum({n} * isFraud) as s1_{n}, sum({n} * (1 - isFraud)) as s0_{n}" for n in _FLAGS)
    side = {y: f"ln((n{y} + 1) / (n + 2)) + " + " + ".join(
        f"case when {n} = 1 then ln((s{y}_{n} + 1) / (n{y} + 2)) else ln(1 - (s{y}_{n} + 1) / (n{y} + 2)) end" for n in _FLAGS) for y in (0, 1)}
    return f"""+ b as (select TransactionID, split, isFraud, {_SPAN} as period, {flags} from tx),
      m as ({folds}),
      fit as (select fold, cast(count(*) as double) as n, cast(sum(isFraud) as double) as n1,
                     cast(sum(1 - isFraud) as double) as n0, {sums} from b join m using (TransactionID) where role = 'train' group by fold),
      scored as (select TransactionID, split, fold, role, isFraud as label, 1 / (1 + exp(({side[0]}) - ({side[1]}))) as prediction
                 from b cross join fit left join m using (TransactionID, fold)),
      s as (select 'bayes' as model, * from scored where role is not null),
      a as ({auc_sql('s', 'model, fold, role')}),
      """


_SCORES = """sc as (select model, fold, max(auc) filter (role = 'train') as train_auc, max(auc) filter (role = 'valid') as valid_auc
                    from a group by all)
      select model, cast(fold as bigint) as fold, round(train_auc, 6) as train_auc, round(valid_auc, 6) as valid_auc from sc"""
_STRATIFIED = f"""select TransactionID, g.fold, case when own = g.fold then 'valid' else 'train' end as role
  from (select TransactionID, {block_sql('r', 'n', 5)} as own from (
    select TransactionID, row_number() over (partition by isFraud order by TransactionID) - 1 as r,
           count(*) over (partition by isFraud) as n from b where split = 'train')), (select unnest(range(5)) as fold) g"""
_EXPANDING = " union all ".join(
    [f"select TransactionID, {i} as fold, case when period in ({', '.join(map(str, t))}) then 'train' else 'valid' end as role from b "
     f"where split = 'train' and period in ({', '.join(map(str, [*t, *v]))})" for i, (t, v) in enumerate(TIME_SCHEMES["expanding"])]
    + [f"select TransactionID, {len(TIME_SCHEMES['expanding'])} as fold, 'train' as role from b where split = 'train'"])


@query("i4_closed_form_scores", sql(_bayes_sql(_STRATIFIED) + _SCORES, "tx"))
def i4_closed_form(spark, folder):
    """Scores per fold of a model whose fit SQL can repeat, over stratified folds."""
    rows = flag_rows(spark, folder).where("split = 'train'")
    folds = stratified_kfold(rows, 5)
    _, scores, _ = cross_validate({"bayes": bayes()}, assemble(rows, list(_FLAGS), [KEY, "isFraud"]), folds)
    return tidy(scores)


@query("i4_closed_form_predictions", sql(
    _bayes_sql(_STRATIFIED) + "t as (select TransactionID, avg(prediction) as p from scored where split = 'test' group by TransactionID) "
    "select TransactionID, round(p, 6) as prediction from t", "tx"))
def i4_closed_form_predictions(spark, folder):
    """Test predictions of the same models, averaged over the folds."""
    done = score_test(flag_rows(spark, folder), list(_FLAGS), {"bayes": bayes()}, k=5, shuffle=False)
    return tidy(done.predictions)


@query("k18_expanding_scores", sql(_bayes_sql(_EXPANDING) + _SCORES, "tx"))
def k18_scores(spark, folder):
    """Growing spans of time, each validated on the span that follows; the last fold trains on all rows and validates none."""
    return tidy(score_expanding(flag_rows(spark, folder), list(_FLAGS), {"bayes": bayes()}, "period").scores)


@query("k18_expanding_predictions", sql(
    _bayes_sql(_EXPANDING) + "t as (select TransactionID, sum(prediction * case fold " + " ".join(
        f"when {f} then {w}" for f, w in EXPANDING_WEIGHTS.items()) + " end) as p from scored where split = 'test' group by TransactionID) "
    "select TransactionID, round(p, 6) as prediction from t", "tx"))
def k18_predictions(spark, folder):
    """Test predictions weighted by fold."""
    return tidy(score_expanding(flag_rows(spark, folder), list(_FLAGS), {"bayes": bayes()}, "period").predictions)


@query("i5_mean_blend", sql("select TransactionID, round(avg(prediction), 6) as prediction from oof group by TransactionID",
                            "oof"))
def i5(spark, folder):
    return tidy(blend.mean_blend(oof(spark, folder)))


@query("i5_mean_blend_compat", sql(
    "select TransactionID, round(sum(p), 6) as prediction from (select TransactionID, f.fold, avg(prediction * (3 + f.fold) "
    "/ 6) as p from oof, (values (0), (1), (2)) f(fold) group by all) group by TransactionID", "oof"))
def i5_compat(spark, folder):
    """Every fold's models predict every row; the folds are added up."""
    at = oof(spark, folder).drop("fold").select("*", F.explode(F.array(*[F.lit(i) for i in range(3)])).alias("fold"))
    rows = at.withColumn("prediction", F.col("prediction") * (3 + F.col("fold")) / 6)
    return tidy(blend.mean_blend(rows, compat=True))


def stack_rows(spark, folder):
    """Every fold's view of the model scores: its own rows are valid, all others train."""
    rows = oof(spark, folder).withColumnRenamed("fold", "own")
    at = rows.select("*", F.explode(F.array(*[F.lit(i) for i in range(3)])).alias("fold"))
    return at.withColumn("role", F.when(F.col("own") == F.col("fold"), "valid").otherwise("train")).drop("own")


@query("i6_stacker")
def i6(spark, folder):
    return tidy(blend.stack_folds(stack_rows(spark, folder), MODELS).where("role = 'valid'"))


@query("i7_stacker_tuning")
def i7(spark, folder):
    scores = blend.tune_stacking(stack_rows(spark, folder), MODELS, (0.001, 0.01, 0.1, 1.0))
    return spark.createDataFrame(list(scores.items()), "c double, auc double")


_PRUNE_SQL = f"""+ s as (select model, fold, -auc as s from ({auc_sql('oof', 'model, fold')})),
  m as (select model, max(s) filter (fold = 0) as s0, max(s) filter (fold = 1) as s1, max(s) filter (fold = 2) as s2
        from s group by model),
  r1 as (select 'm1' as model, (s0 + s1 + s2) / 3 as score, false as pruned, s0, s1, s2 from m where model = 'm1'),
  c2 as (select m.s0, m.s1, m.s2, (b.s0 + b.s1) / 2 < (m.s0 + m.s1) / 2 * 1.01 as pruned, b.s0 as b0, b.s1 as b1,
         b.s2 as b2 from m, r1 b where m.model = 'm2'),
  r2 as (select 'm2' as model, case when pruned then (s0 + s1) / (b0 + b1) * (b0 + b1 + b2) / 3 else (s0 + s1 + s2) / 3
         end as score, pruned, case when not pruned and s0 + s1 + s2 < b0 + b1 + b2 then s0 else b0 end as s0,
         case when not pruned and s0 + s1 + s2 < b0 + b1 + b2 then s1 else b1 end as s1,
         case when not pruned and s0 + s1 + s2 < b0 + b1 + b2 then s2 else b2 end as s2 from c2),
  c3 as (select m.s0, m.s1, m.s2, (b.s0 + b.s1) / 2 < (m.s0 + m.s1) / 2 * 1.01 as pruned, b.s0 as b0, b.s1 as b1,
         b.s2 as b2 from m, r2 b where m.model = 'm3'),
  r3 as (select 'm3' as model, case when pruned then (s0 + s1) / (b0 + b1) * (b0 + b1 + b2) / 3 else (s0 + s1 + s2) / 3
         end as score, pruned from c3)
  select model, round(score, 6) as score, pruned from r1 union all select model, round(score, 6), pruned from r2
  union all select model, round(score, 6), pruned from r3"""


@query("i8_pruned_cv", sql(_PRUNE_SQL, "oof"))
def i8(spark, folder):
    """The fold scores of three models, scored on Spark fold by fold until the run is stopped."""
    rows = settle(oof(spark, folder))
    cv, out = PrunedCV(3, 0.01, minimize=False), []
    for m in MODELS:
        score = cv.run(lambda f: auc_value(rows.where((F.col("model") == m) & (F.col("fold") == f))))
        out.append((m, score, cv.pruned))
    return tidy(spark.createDataFrame(out, "model string, score double, pruned boolean"))


@query("i8_pruned_training")
def i8_training(spark, folder):
    train = train_part(spark, folder)
    folds = stratified_kfold(train, 5, shuffle=True, seed=1)
    cv = PrunedCV(5, 0.02, minimize=False)
    scores = [(name, cv.cross_val_score(model, train, folds, "auc"))
              for name, model in (("gbdt", small()), ("forest", small("forest")))]
    return spark.createDataFrame(scores, "model string, negated_auc double")


@query("i9_parameter_search")
def i9(spark, folder):
    """Two runs, each with two trials at once, over the declared ranges; rounds are few, so that a trial takes seconds."""
    train = train_part(spark, folder)
    folds = settle(stratified_kfold(train, 3, shuffle=True, seed=1), "folds")

    def objective(params):
        model = booster("goss", **{**tree_params(params), "maxIter": 3})
        return PrunedCV(3, 0.02, splits_to_start_pruning=1, minimize=False).cross_val_score(model, train, folds, "auc")

    path = scratch_path(spark, "trials")
    Study(spark, path, "goss", SPACES["goss"]).optimize(objective, trials=3, parallelism=2)
    study = Study(spark, path, "goss", SPACES["goss"])
    study.optimize(objective, trials=2, parallelism=2)
    return study.history.select("study", "trial", "score", F.col("params")["num_leaves"].alias("num_leaves"))


# The share of a range that a trial draws, and the value there.
_SHARE = "cast('0x' || substr(md5(concat({seed}, ':', trial, ':{name}')), 1, 8) as bigint) / 4294967296.0"


def draw_sql(space: dict, seed: int) -> str:
    """One expression per parameter, over rows with ``trial``."""
    def value(name: str, r: Range) -> str:
        share = _SHARE.format(seed=seed, name=name)
        if r.kind == "int":
            return f"{int(r.low)} + floor({share} * {int(r.high) - int(r.low) + 1})"
        return f"{r.low} * power({r.high / r.low!r}::double, {share})" if r.kind == "loguniform" else f"{r.low} + ({share}) * {r.high - r.low!r}"

    return ", ".join(f"cast({value(n, r)} as double) as {n}" for n, r in space.items())


_BLENDS = {"w1": Range(0.0, 1.0), "w2": Range(0.01, 1.0, "loguniform"), "w3": Range(1, 9, "int")}


@query("i9_shared_search", sql(
    f"+ t as (select unnest(range(8)) as trial), d as (select trial, {draw_sql(_BLENDS, 3)} from t), w as (select TransactionID, "
    "max(label) as label, max(prediction) filter (model = 'm1') as m1, max(prediction) filter (model = 'm2') as m2, "
    "max(prediction) filter (model = 'm3') as m3 from oof group by TransactionID), p as (select trial, label, w1 * m1 + w2 * m2 + "
    f"w3 * m3 as prediction from w cross join d), a as ({auc_sql('p', 'trial')}) select 'blend' as study, cast(trial as bigint) as trial, "
    "round(w1, 6) as w1, round(w2, 6) as w2, round(w3, 6) as w3, round(auc, 6) as score from d join a using (trial)", "oof"))
def i9_shared(spark, folder):
    """Two runs at the same time, with two trials each at once, search blend weights and share one history."""
    wide = settle(blend.wide_predictions(oof(spark, folder), MODELS, [KEY, "label"]), "wide")

    def objective(params):
        mixed = sum(F.col(m) * params[w] for m, w in zip(MODELS, ("w1", "w2", "w3")))
        return auc_value(wide.select("label", mixed.alias("prediction")))

    path = scratch_path(spark, "trials")
    runs = [Study(spark, path, "blend", _BLENDS, seed=3, minimize=False) for _ in range(2)]
    with ThreadPool(2) as pool:
        pool.map(inheritable_thread_target(spark)(lambda run: run.optimize(objective, trials=4, parallelism=2)), runs, chunksize=1)
    history = runs[0].history
    return tidy(history.select("study", F.col("trial").cast("long").alias("trial"), *[F.col("params")[w].alias(w) for w in _BLENDS], "score"))


@query("i10_boosters")
def i10(spark, folder):
    """Test predictions of the five boosters and the forest."""
    rows = model_rows(spark, folder)
    train = settle(assemble(rows.where("split = 'train'"), _NAMES, ["isFraud"]))
    test = assemble(rows.where("split = 'test'"), _NAMES, [KEY])
    out = None
    for kind in ("gbdt", "dart", "goss", "xgb", "cat", "forest"):
        part = predict(small(kind).fit(train), test).withColumn("model", F.lit(kind))
        out = part if out is None else out.unionByName(part)
    return tidy(out)


@query("i11_stage_parameters")
def i11(spark, folder):
    """Selector, then classifier, with parameters set by stage name."""
    rows = model_rows(spark, folder)
    train = assemble(rows.where("split = 'train'"), _NAMES, [KEY, "isFraud"])
    chosen = selection_stages(_NAMES, train, 0.02, small(), small("forest"))
    slicer, classifier = chosen.getStages()
    stages = with_stage_params({"slice": slicer, "classifier": classifier}, {"classifier__maxDepth": 4})
    return tidy(predict(stages.fit(train), assemble(rows, _NAMES, [KEY])))


@query("i12_model_as_feature")
def i12(spark, folder):
    rows = model_rows(spark, folder)
    model = small("forest").fit(assemble(rows.where("split = 'train'"), _NAMES, ["isFraud"]))
    return class_feature(model, assemble(rows, _NAMES, [KEY]), "forest_class").select(KEY, "forest_class")


@query("j2_fitted_stages", sql(
    "+ ok as (select P_emaildomain from tx where P_emaildomain is not null group by P_emaildomain having count(*) filter "
    "(split = 'train') > 100 and count(*) filter (split = 'test') > 0), t as (select ProductCD, avg(isFraud) as m from tx "
    "group by ProductCD), f as (select card6, count(card6) as n from tx group by card6) select TransactionID, case when "
    "P_emaildomain in (select P_emaildomain from ok) then P_emaildomain else 'unknown' end as P_emaildomain, round(t.m, 6) as "
    "ProductCD, n as card6 from tx join t using (ProductCD) join f using (card6)", "tx"))
def j2(spark, folder):
    """Encoders in one Spark ML pipeline, saved and loaded again before use."""
    rows = tx(spark, folder).select(KEY, "split", "isFraud", "addr2", "P_emaildomain", "ProductCD", "card6")
    stages = [CategoryLimit(inputCols=["P_emaildomain"], limit=100), TargetEncoder(inputCols=["ProductCD"]),
              FrequencyEncoder(inputCols=["card6"]), DropConstant(inputCols=["addr2"]),
              SelectColumns(inputCols=[KEY, "P_emaildomain", "ProductCD", "card6"])]
    fitted = Pipeline(stages=stages).fit(rows)
    path = scratch_path(spark, "stages")
    fitted.write().save(path)
    return tidy(PipelineModel.load(path).transform(rows))


@query("j3_feature_functions", sql("select TransactionID, count(*) over (partition by card4) as card4_count_full, cast(floor("
                                   "TransactionDT / 3600.0) as bigint) % 24 as Transaction_hour_of_day from tx", "tx"))
def j3(spark, folder):
    """Feature functions chained on one table."""
    from ..functions.dates import date_features
    rows = tx(spark, folder).select(KEY, "TransactionDT", "TransactionAmt", "card4")
    return tidy(rows.transform(card_counts).transform(date_features).select(
        KEY, "card4_count_full", "Transaction_hour_of_day"))


@query("j1_row_functions", sql("select TransactionID, split_part(coalesce(R_emaildomain, 'nan'), '.', -1) as last_part from "
                               "tx", "tx"))
def j1(spark, folder):
    return tx(spark, folder).select(KEY, last_part("R_emaildomain").alias("last_part"))


_GROUP = [f"V{i}" for i in range(1, 65)]


@query("k8_principal_components")
def k8(spark, folder):
    return tidy(reduced(vmat(spark, folder).select("vec_id", *_GROUP, "V67"), [*_GROUP, "V67"], 3).select(
        "vec_id", "pc1", "pc2", "pc3"))


@query("k8_truncated_svd")
def k8_svd(spark, folder):
    return tidy(reduced(vmat(spark, folder).select("vec_id", *_GROUP), _GROUP, 3, "sv", center=False).select(
        "vec_id", "sv1", "sv2", "sv3"))


_ALL = [*[f"V{i}" for i in range(1, 65)], "V67"]


def _all_components(spark, folder, names, center, prefix):
    """Every component of a column group: squared length per row, and the largest product of two components."""
    made = reduced(vmat(spark, folder).select("vec_id", *names), names, len(names), prefix, center)
    parts = settle(made.select("vec_id", F.array(*[c for c in made.columns if c.startswith(prefix)]).alias("parts")), "parts")
    vectors = MLUtils.convertVectorColumnsFromML(parts.select(array_to_vector("parts").alias("v")), "v")
    cross = np.abs(np.triu(RowMatrix(vectors).computeGramianMatrix().toArray(), 1)).max()
    squares = F.aggregate("parts", F.lit(0.0), lambda t, x: t + x * x)
    return parts, parts.select("vec_id", squares.alias("squares"), F.lit(float(cross)).alias("largest_cross"))


@query("k8_all_components", sql(
    "+ m as (select " + ", ".join(f"avg({c}) as m_{c}" for c in _ALL) + " from vmat) select vec_id, round("
    + " + ".join(f"coalesce(power({c} - m_{c}, 2), 0)" for c in _ALL) + ", 6) as squares, cast(0 as double) as largest_cross, "
    "cast(0 as double) as largest_mean from vmat cross join m", "vmat"))
def k8_all(spark, folder):
    """All principal components: a rotation, so rows keep their distance from the mean; components have mean 0 and do not correlate."""
    parts, rows = _all_components(spark, folder, _ALL, True, "pc")
    mean = parts.select(Summarizer.mean(array_to_vector("parts")).alias("mean")).first()["mean"]
    return tidy(rows.withColumn("largest_mean", F.lit(float(np.abs(mean.toArray()).max()))))


@query("k8_all_singular", sql(
    "select vec_id, round(" + " + ".join(f"power({c}, 2)" for c in _ALL[:64]) + ", 6) as squares, "
    "cast(0 as double) as largest_cross from vmat", "vmat"))
def k8_all_svd(spark, folder):
    """All singular directions: rows keep their length, and the products of two directions add up to 0."""
    return tidy(_all_components(spark, folder, _ALL[:64], False, "sv")[1])


@query("k26_two_stages")
def k26(spark, folder):
    """Training rows carry the out-of-fold score of the first model, test rows its mean over the folds."""
    rows = model_rows(spark, folder)
    train = assemble(rows.where("split = 'train'"), _NAMES, [KEY, "isFraud"])
    test = assemble(rows.where("split = 'test'"), _NAMES, [KEY])
    folds = stratified_kfold(train, 5, shuffle=True, seed=1)
    held, _, tested = cross_validate({"first": small()}, train, folds, test)
    second = settle(second_stage(train, held), "second")
    model = small().fit(second)
    return tidy(predict(model, second).unionByName(predict(model, second_stage_test(test, tested))))


@query("k29_recursive_elimination")
def k29(spark, folder):
    rows = model_rows(spark, folder)
    train = settle(assemble(rows.where("split = 'train'"), _NAMES, ["isFraud"]))
    return rows.select(KEY, *eliminate(train, _NAMES, 4, step=3))


# A label that two of the flags decide: a tree of depth two takes these two and no other.
_BOTH = "case when C1 > 3 and card6 = 'credit' then 1 else 0 end"
_NOISE = 97


def _planted(spark, folder):
    """Long predictions of 100 models: three flags, the first two of which decide the label, and 97 without information."""
    rows = tx(spark, folder).where("split = 'train'").selectExpr(KEY, f"{_BOTH} as label", f"{KEY} % 3 as fold", *[
        f"cast({_FLAGS[n]} as double) as {n}" for n in ("f1", "f2", "f3")])
    # Every row becomes a hundred: rows that came in few large files are spread first.
    spread = rows.repartition(parallelism(spark)).selectExpr("*", f"explode(sequence(1, {_NOISE + 3})) as i")
    flag = " ".join(f"when {i} then coalesce({n}, 0D)" for i, n in enumerate(("f1", "f2", "f3"), 1))
    noise = f"({KEY} % 10007 * (7919 + i - 3)) % 10007 / 10007D"
    return spread.selectExpr(KEY, "label", "fold", "concat(if(i <= 3, 'f', 'n'), if(i <= 3, i, i - 3)) as model",
                             f"case i {flag} else {noise} end as prediction")


@query("k29_model_elimination", sql(
    f"+ b as (select TransactionID, {_BOTH} as label, coalesce(cast({_FLAGS['f1']} as double), 0) as f1, "
    f"coalesce(cast({_FLAGS['f2']} as double), 0) as f2 from tx where split = 'train'), l as (select 'f1' as model, label, f1 as prediction "
    f"from b union all select 'f2', label, f2 from b), a as ({auc_sql('l', 'model')}) select model, round(auc, 6) as auc, "
    f"cast({_NOISE + 3} as bigint) as models from a", "tx"))
def k29_models(spark, folder):
    """Of 100 models the two that decide the label remain; each is scored over all rows."""
    rows = _planted(spark, folder)
    left, report = eliminate_models(rows, 2, step=49, estimator=DecisionTreeClassifier(maxDepth=2, labelCol="label"))
    scored = auc(rows.where(F.col("model").isin(left)), by=["model"])
    return tidy(scored.select("model", "auc", F.lit(report.count()).alias("models")))


@query("k30_seed_average")
def k30(spark, folder):
    rows = model_rows(spark, folder)
    train = settle(assemble(rows.where("split = 'train'"), _NAMES, ["isFraud"]))
    test = assemble(rows.where("split = 'test'"), _NAMES, [KEY])
    return tidy(seed_average(small("forest"), train, test, [1, 2]))


_TWO = " + ".join(f"case when {n} = 1 then ln((s{{0}}_{n} + 1) / (n{{0}} + 2)) else ln(1 - (s{{0}}_{n} + 1) / (n{{0}} + 2)) end" for n in ("f1", "f2"))


def _reloaded(spark, stages, train):
    """The fitted pipeline, saved and loaded again."""
    path = scratch_path(spark, "pipeline")
    Pipeline(stages=stages).fit(train).write().save(path)
    return PipelineModel.load(path)


def both_rows(spark, folder):
    return tx(spark, folder).selectExpr(KEY, "split", f"{_BOTH} as y", *[f"cast({e} as double) as {n}" for n, e in _FLAGS.items()])


@query("g14_importance_stage", sql(
    "+ b as (select TransactionID, split, " + _BOTH + " as y, " + ", ".join(f"cast({e} as double) as {n}" for n, e in _FLAGS.items())
    + " from tx), fit as (select cast(count(*) as double) as n, cast(sum(y) as double) as n1, cast(sum(1 - y) as double) as n0, "
    + ", ".join(f"sum({n} * y) as s1_{n}, sum({n} * (1 - y)) as s0_{n}" for n in ("f1", "f2"))
    + " from b where split = 'train') select TransactionID, f1, f2, round(1 / (1 + exp((ln((n0 + 1) / (n + 2)) + " + _TWO.format(0)
    + ") - (ln((n1 + 1) / (n + 2)) + " + _TWO.format(1) + "))), 6) as prediction from b, fit", "tx"))
def g14_stage(spark, folder):
    """Selector by importance inside a saved pipeline: the classifier behind it sees the two columns that decide the label."""
    rows = both_rows(spark, folder)
    stages = [VectorAssembler(inputCols=list(_FLAGS), outputCol="features"),
              ImportanceSelector(DecisionTreeClassifier(maxDepth=2), labelCol="y"),
              NaiveBayes(modelType="bernoulli", featuresCol="chosen", labelCol="y")]
    scored = _reloaded(spark, stages, rows.where("split = 'train'")).transform(rows)
    chosen = vector_to_array("chosen")
    return tidy(scored.select(KEY, chosen[0].alias("f1"), chosen[1].alias("f2"), vector_to_array("probability")[1].alias("prediction")))


@query("i12_model_stage", sql(
    f"select TransactionID, cast({_BOTH} as double) as boosted, coalesce(dist1, -1.0) as dist1 from tx", "tx"))
def i12_stage(spark, folder):
    """A boosted model as a feature stage behind an imputer, in a saved pipeline; its class is the label that two flags decide."""
    rows = both_rows(spark, folder).join(tx(spark, folder).select(KEY, "dist1"), KEY)
    stages = [FillMissing(inputCols=["dist1"], onNull=-1.0), VectorAssembler(inputCols=list(_FLAGS), outputCol="features"),
              ModelFeature(GBTClassifier(maxIter=1, maxDepth=2), "boosted", labelCol="y"),
              SelectColumns(inputCols=[KEY, "boosted", "dist1"])]
    return tidy(_reloaded(spark, stages, rows.where("split = 'train'")).transform(rows))
