"""Tree models under cross-validation, as Spark ML jobs."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from multiprocessing.pool import ThreadPool

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.feature import PCA, Imputer, StandardScaler, VectorAssembler, VectorSlicer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, functions as F

from ..schema import KEY, LABEL
from ..session import parallelism as session_parallelism, settle
from .folds import kfold, stratified_kfold
from .metrics import METRICS, auc, metric_value

FEATURES = "features"


def assemble(df: DataFrame, columns, keep=(), output: str = FEATURES) -> DataFrame:
    """Dense input vector; nulls must be filled before."""
    numbers = [F.col(c).cast("double").alias(c) for c in columns]
    kept = df.select(*[k for k in keep], *[n for n, c in zip(numbers, columns) if c not in keep])
    return VectorAssembler(inputCols=list(columns), outputCol=output).transform(kept).select(*keep, output)


# The five boosters differ in engine internals; here each is a Spark ML tree
# ensemble with the sampling that sets it apart.
BOOSTERS: dict[str, Callable] = {
    "gbdt": lambda **p: GBTClassifier(**p),
    "dart": lambda **p: GBTClassifier(**{"subsamplingRate": 0.8, **p}),
    "goss": lambda **p: GBTClassifier(**{"subsamplingRate": 0.5, **p}),
    "xgb": lambda **p: GBTClassifier(**{"featureSubsetStrategy": "onethird", **p}),
    "cat": lambda **p: GBTClassifier(**{"minInstancesPerNode": 5, **p}),
    "forest": lambda **p: RandomForestClassifier(**p),
}


def booster(kind: str, label: str = LABEL, **params):
    if kind not in BOOSTERS:
        raise ValueError(f"unknown booster {kind}, one of {sorted(BOOSTERS)}")
    return BOOSTERS[kind](featuresCol=FEATURES, labelCol=label, seed=params.pop("seed", 0), **params)


def predict(model, df: DataFrame, keep=(KEY,)) -> DataFrame:
    return model.transform(df).select(*keep, vector_to_array("probability")[1].alias("prediction"))


def fold_members(folds: DataFrame, key: str = KEY) -> tuple[DataFrame, list[int]]:
    """((key, train, valid), folds): per key the folds that train on its rows and those that validate on them.

    ``folds`` is (key, fold): validated in that fold, trained on in all others,
    keys given several folds in the smallest of them; or (key, fold, role) with
    a row for every fold that uses the key, and any others leave it out.
    """
    numbers = [r["fold"] for r in folds.select("fold").distinct().orderBy("fold").collect()]  # one row per fold
    if "role" in folds.columns:
        at = {role: F.collect_set(F.when(F.col("role") == role, F.col("fold").cast("int"))).alias(role) for role in ("train", "valid")}
        return folds.groupBy(key).agg(*at.values()), numbers
    own = folds.groupBy(key).agg(F.array(F.min("fold").cast("int")).alias("valid"))
    return own.select(key, F.array_except(F.array(*[F.lit(f).cast("int") for f in numbers]), "valid").alias("train"), "valid"), numbers


def more_rounds(factor: float = 1.1, from_fold: int = 3) -> Callable:
    """For ``by_fold``: more rounds of boosting in the folds from ``from_fold`` on, which train on more rows."""
    def change(estimator, fold: int):
        for name in ("maxIter", "numTrees"):
            if fold >= from_fold and estimator.hasParam(name):
                param = estimator.getParam(name)
                return estimator.copy({param: int(np.ceil(round(factor * estimator.getOrDefault(param), 6)))})
        return estimator

    return change


def fit_all(jobs: list[tuple], rows_of: Callable, parallelism: int, spark) -> list:
    """Models of (estimator, fold) jobs, at most ``parallelism`` fits at a time, each in a scheduler pool of its fold."""
    def fit(job):
        estimator, fold = job
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", f"fold-{fold}")
        return estimator.fit(rows_of(fold))

    pool = ThreadPool(processes=max(1, min(parallelism, len(jobs))))
    try:
        return pool.map(inheritable_thread_target(spark)(fit), jobs, chunksize=1) if jobs else []
    finally:
        pool.close()


def predict_all(models: list, rows: DataFrame, keep) -> DataFrame:
    """``keep`` and ``predictions``, an array with one probability per model; one pass over the rows for all models."""
    names, scored = rows.columns, rows
    for i, model in enumerate(models):
        scored = model.transform(scored).select(
            *names, *[f"_p{k}" for k in range(i)], vector_to_array("probability")[1].alias(f"_p{i}"))
    return scored.select(*keep, F.array(*[F.col(f"_p{i}") for i in range(len(models))]).alias("predictions"))


def cross_validate(models: dict, train: DataFrame, folds: DataFrame, test: DataFrame | None = None,
                   label: str = LABEL, key: str = KEY, parallelism: int = 4,
                   by_fold: Callable | None = None) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """Fit every model on the training rows of every fold.

    ``train`` holds key, label and ``features``; ``folds`` is (key, fold), or
    (key, fold, role) where a row may train several folds and a fold may have
    no row to validate (see :func:`fold_members`).  Rows whose key has no fold
    take no part; rows with equal or missing keys are rows of their own.
    ``by_fold`` may change an estimator for a fold.

    Fits run side by side; all fitted models score the rows in one pass, so the
    number of scans does not depend on folds or models.  What is written is one
    row per row with all its predictions; the long rows are made of it when
    they are read.  Returns rows (model, fold, role, key, label, prediction),
    scores (model, fold, train_auc, valid_auc), and, if ``test`` is given, the
    test predictions (model, fold, key, prediction).
    """
    spark = train.sparkSession
    members, numbers = fold_members(folds, key)
    members = members.select(F.col(key).alias("_member"), F.col("train").alias("_train"), F.col("valid").alias("_valid"))
    data = settle(train.join(members, F.col(key).eqNullSafe(F.col("_member"))).drop("_member"), "folds")
    jobs = [(name, f, by_fold(e, f) if by_fold else e) for name, e in models.items() for f in numbers]
    fitted = fit_all([(e, f) for _, f, e in jobs], lambda f: data.where(F.array_contains("_train", f)).drop("_train", "_valid"),
                     parallelism, spark)

    def long(rows: DataFrame, keep: list, more: Callable) -> DataFrame:
        each = [F.struct(F.lit(name).alias("model"), F.lit(f).alias("fold"), *more(f), F.col("predictions")[i].alias("prediction"))
                for i, (name, f, _) in enumerate(jobs)]
        return rows.select(*keep, F.explode(F.array(*each)).alias("_s"))

    def role(f: int) -> list:
        return [F.when(F.array_contains("_valid", f), "valid").when(F.array_contains("_train", f), "train").alias("role")]

    rows = long(settle(predict_all(fitted, data, [key, label, "_train", "_valid"]), "oof"), [key, label], role)
    oof = rows.where("_s.role is not null").select(
        "_s.model", "_s.fold", "_s.role", key, F.col(label).cast("double").alias("label"), "_s.prediction")
    scores = auc(oof, by=["model", "fold", "role"]).groupBy("model", "fold").agg(
        F.max(F.when(F.col("role") == "train", F.col("auc"))).alias("train_auc"),
        F.max(F.when(F.col("role") == "valid", F.col("auc"))).alias("valid_auc"))
    if test is None:
        return oof, scores, None
    spread = test.repartition(session_parallelism(spark))  # a table in order of time has its test rows in few files
    tested = long(settle(predict_all(fitted, spread, [key]), "tested"), [key], lambda f: [])
    return oof, scores, tested.select("_s.model", "_s.fold", key, "_s.prediction")


def mean_score(scores: DataFrame) -> DataFrame:
    """(model, auc): mean validation AUC over the folds."""
    return scores.groupBy("model").agg(F.avg("valid_auc").alias("auc"))


class PrunedCV:
    """Cross-validation that stops early when a run falls behind the best run so far.

    From fold ``splits_to_start_pruning`` on, the mean of the run's scores is
    compared with the mean of the best run's same folds; ``tolerance`` is the
    allowed gap.  A stopped run returns the best run's mean scaled by the
    ratio of the two.  Scores to be maximised are held negated.
    """

    def __init__(self, cv: int, tolerance: float = 0.1, splits_to_start_pruning: int = 2, minimize: bool = True):
        if isinstance(cv, bool) or not isinstance(cv, int):
            raise TypeError("cv must be an int")
        if cv < 2:
            raise ValueError("cv must be at least 2")
        self.cv, self.minimize, self.start = cv, minimize, splits_to_start_pruning
        self.set_tolerance(tolerance)
        self.best: list[float] = []
        self.pruned = False

    def set_tolerance(self, tolerance: float) -> None:
        if not isinstance(tolerance, float):
            raise TypeError("tolerance must be a float")
        if tolerance < 0:
            raise ValueError("tolerance must not be negative")
        self.tolerance = tolerance

    def run(self, score_of_fold: Callable[[int], float]) -> float:
        """Score the folds in turn; ``score_of_fold`` is called for as many as are needed."""
        sign, current = (1 if self.minimize else -1), []
        self.pruned = False
        first = len(self.best) < self.cv
        slack_best = 1 + self.tolerance if self.minimize else 1.0
        slack_run = 1.0 if self.minimize else 1 + self.tolerance
        for fold in range(self.cv):
            score = score_of_fold(fold)
            if not isinstance(score, float):
                raise TypeError("a fold score must be a float")
            current.append(sign * score)
            done = len(current)
            if first or not self.start <= done < self.cv:
                continue
            ours, theirs = sum(current) / done, sum(self.best[:done]) / done
            if theirs * slack_best < ours * slack_run:
                self.pruned = True
                return ours / theirs * sum(self.best) / self.cv
        if first or sum(current) < sum(self.best):
            self.best = current
        return sum(current) / self.cv

    def cross_val_score(self, estimator, data: DataFrame, folds: DataFrame | None = None, metric: str = "mse",
                        label: str = LABEL, key: str = KEY, weight: str | None = None, shuffle: bool = False,
                        seed: int = 0) -> float:
        """Pruned score of an estimator on (key, label, features[, weight]) rows with (key, fold).

        Without ``folds`` the metric chooses them: stratified by the label for
        accuracy and auc, plain for mse and mae.
        """
        if metric not in METRICS:
            raise ValueError(f"metric must be one of {METRICS}")
        if folds is None and metric in ("accuracy", "auc"):
            folds = stratified_kfold(data, self.cv, label, key, shuffle, seed)
        elif folds is None:
            folds = kfold(data, self.cv, key, shuffle, seed)
        own = folds.groupBy(key).agg(F.min("fold").alias("fold")).withColumnRenamed(key, "_member")
        joined = settle(data.join(own, F.col(key).eqNullSafe(F.col("_member"))).drop("_member"), "pruned")
        if weight is not None:
            estimator = estimator.copy({estimator.getParam("weightCol"): weight})

        def score(fold: int) -> float:
            fitted = estimator.fit(joined.where(F.col("fold") != fold))
            held = joined.where(F.col("fold") == fold)
            keep = [label, *([weight] if weight else [])]
            if metric == "auc":
                scored = predict(fitted, held, keep)
            else:
                scored = fitted.transform(held).select(*keep, "prediction")
            return float(metric_value(scored, metric, "prediction", label, weight))

        return self.run(score)


def importances(model, columns) -> dict[str, float]:
    values = model.featureImportances
    return {c: float(values[i]) for i, c in enumerate(columns)}


def important_columns(data: DataFrame, columns, threshold: float | None = None, estimator=None,
                      label: str = LABEL) -> list[str]:
    """Columns whose share of the model's importance reaches ``threshold`` (default: the mean share)."""
    model = (estimator or booster("gbdt", label, maxIter=5, maxDepth=4)).fit(data)
    shares = importances(model, columns)
    limit = 1.0 / len(columns) if threshold is None else threshold
    return [c for c in columns if shares[c] >= limit]


def sliced(columns, chosen, output: str = "chosen") -> VectorSlicer:
    return VectorSlicer(inputCol=FEATURES, outputCol=output, indices=[columns.index(c) for c in chosen])


def eliminate(data: DataFrame, columns, keep: int, step: int = 1, estimator=None, label: str = LABEL) -> list[str]:
    """Recursive elimination: refit, drop the ``step`` least important columns, until ``keep`` remain."""
    left = list(columns)
    estimator = estimator or booster("gbdt", label, maxIter=3, maxDepth=3)
    while len(left) > keep:
        part = sliced(list(columns), left, "_left").transform(data).drop(FEATURES).withColumnRenamed("_left", FEATURES)
        shares = importances(estimator.fit(part), left)
        drop = sorted(left, key=lambda c: (shares[c], -left.index(c)))[:min(step, len(left) - keep)]
        left = [c for c in left if c not in drop]
    return left


def _means(width: int, kinds: dict):
    """Task side: the (at, prediction) entries of a row as one list of ``width`` means, 0.5 where there is none."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, found = batch.num_rows * width, batch.column("found")
            at, prediction = found.flatten().flatten()
            place = np.repeat(np.arange(batch.num_rows), pc.list_value_length(found).to_numpy()) * width + at.to_numpy()
            n = np.bincount(place, minlength=size)
            sums = np.bincount(place, prediction.to_numpy(), size)
            made = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1) * width, pa.int32()),
                                            pa.array(np.where(n > 0, sums / np.maximum(n, 1), 0.5)))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kinds], made], [*kinds, "values"])

    return run


def stacked_vectors(oof: DataFrame, models, key: str = KEY, label: str = "label") -> DataFrame:
    """(key, fold, label, features): the predictions of the models on one row as a dense vector, in the order of ``models``.

    ``oof`` is in long form, a row per model and key, so its width does not
    grow with the models; predictions of a model on one key are averaged, a
    missing one is 0.5.  Rows with a missing key take no part.  The long rows
    are grouped once, by key, with the place of their model in the vector
    instead of its name, so the work per row does not grow with the models.
    """
    places = settle(oof.sparkSession.createDataFrame([(m, i) for i, m in enumerate(models)], "_name string, _at int"), "places")
    placed = oof.where(F.col(key).isNotNull()).join(places, F.col("model") == F.col("_name"), "left")
    entry = F.struct(F.col("_at").alias("at"), F.col("prediction").cast("double").alias("prediction"))
    rows = placed.groupBy(key).agg(
        F.min("fold").alias("fold"), F.max(label).cast("double").alias("label"),
        F.collect_list(F.when(F.col("_at").isNotNull() & F.col("prediction").isNotNull(), entry)).alias("found"))
    kinds = {c: rows.schema[c].dataType.simpleString() for c in (key, "fold", "label")}
    kept = ", ".join(f"`{c}` {kind}" for c, kind in kinds.items())
    return rows.mapInArrow(_means(len(models), kinds), f"{kept}, values array<double>").select(
        key, "fold", "label", array_to_vector("values").alias(FEATURES))


def eliminate_models(oof: DataFrame, keep: int, step: int = 1, estimator=None, key: str = KEY, label: str = "label",
                     parallelism: int = 4) -> tuple[list[str], DataFrame]:
    """Recursive elimination over the out-of-fold predictions of many models.

    In each round the estimator is fitted once per fold, on the rows of the
    other folds, and the ``step`` models with the smallest importance, averaged
    over the folds, go (of equal ones the last by name), until ``keep`` remain.
    Returns their names and (model, round, importance): the round that a model
    was dropped in, null for the ones that remain, and its last importance.
    """
    spark = oof.sparkSession
    models = [r["model"] for r in oof.select("model").distinct().orderBy("model").collect()]  # one name per model
    data = settle(stacked_vectors(oof, models, key, label), "stacked")
    folds = [r["fold"] for r in data.select("fold").distinct().orderBy("fold").collect()]  # one row per fold
    estimator = estimator or booster("gbdt", "label", maxIter=3, maxDepth=3)
    left, last, dropped, turn = list(models), {m: 0.0 for m in models}, {}, 0
    while len(left) > keep:
        part = sliced(models, left, "_left").transform(data).drop(FEATURES).withColumnRenamed("_left", FEATURES)
        fitted = fit_all([(estimator, f) for f in folds], lambda f: part.where(F.col("fold") != f), parallelism, spark)
        each = [importances(m, left) for m in fitted]
        last.update({m: sum(e[m] for e in each) / len(each) for m in left})
        worst = sorted(left, key=lambda m: (last[m], -left.index(m)))[:min(step, len(left) - keep)]
        dropped.update({m: turn for m in worst})
        left, turn = [m for m in left if m not in dropped], turn + 1
    report = spark.createDataFrame([(m, dropped.get(m), float(last[m])) for m in models],
                                   "model string, round int, importance double")
    return left, report


def selection_stages(columns, data: DataFrame, threshold: float | None, selector, classifier) -> Pipeline:
    """Selector fitted on ``data``, then slicer and classifier as one Spark ML pipeline."""
    chosen = important_columns(data, columns, threshold, selector, classifier.getLabelCol())
    if not chosen:
        raise ValueError(f"no column reaches the importance {threshold}")
    final = classifier.copy({classifier.featuresCol: "chosen"})
    return Pipeline(stages=[sliced(list(columns), chosen), final])


def with_stage_params(stages: dict, overrides: dict) -> Pipeline:
    """Pipeline of named stages with ``stage__param`` overrides."""
    for name, value in overrides.items():
        stage, param = name.split("__", 1)
        stages[stage].set(stages[stage].getParam(param), value)
    return Pipeline(stages=list(stages.values()))


def class_feature(model, df: DataFrame, name: str) -> DataFrame:
    """A fitted model as a feature stage: its hard class becomes a column."""
    scored = model.transform(df)
    extra = [c for c in scored.columns if c not in df.columns and c != "prediction"]
    return scored.withColumnRenamed("prediction", name).drop(*extra)


def second_stage(train: DataFrame, oof: DataFrame, key: str = KEY, name: str = "stage1") -> DataFrame:
    """Out-of-fold predictions of a first model appended to the features of a second."""
    return _appended(train, oof.where("role = 'valid'").select(key, F.col("prediction").alias(name)), key, name)


def second_stage_test(test: DataFrame, tested: DataFrame, key: str = KEY, name: str = "stage1") -> DataFrame:
    """The same for test rows: the first model's predictions, averaged over the folds."""
    return _appended(test, tested.groupBy(key).agg(F.avg("prediction").alias(name)), key, name)


def _appended(rows: DataFrame, first: DataFrame, key: str, name: str) -> DataFrame:
    """No row is lost or repeated: equal keys share the mean of their predictions, a row without one gets NaN."""
    one = first.groupBy(F.col(key).alias("_first")).agg(F.avg(name).alias(name))
    joined = rows.join(one, F.col(key).eqNullSafe(F.col("_first")), "left").drop("_first").fillna(float("nan"), [name])
    return VectorAssembler(inputCols=[FEATURES, name], outputCol="_more", handleInvalid="keep").transform(joined).drop(
        FEATURES, name).withColumnRenamed("_more", FEATURES)


def seed_average(estimator, train: DataFrame, test: DataFrame, seeds, key: str = KEY) -> DataFrame:
    """(key, prediction): mean over fits of one model with several seeds."""
    out = None
    for s in seeds:
        part = predict(estimator.copy({estimator.getParam("seed"): s}).fit(train), test, [key])
        out = part if out is None else out.unionByName(part)
    return out.groupBy(key).agg(F.avg("prediction").alias("prediction"))


def _upright(loadings: np.ndarray) -> list[float]:
    """1 or -1 per component, so that its largest loading becomes positive."""
    largest = np.abs(loadings).argmax(axis=0)
    return [-1.0 if loadings[i, j] < 0 else 1.0 for j, i in enumerate(largest)]


def reduced(df: DataFrame, columns, k: int, prefix: str = "pc", center: bool = True) -> DataFrame:
    """Principal components of a column group as columns, with mean 0; nulls take the column mean.

    ``center=False`` gives the truncated singular value decomposition.  The
    largest loading of a component is positive.
    """
    columns = list(columns)
    filled = Imputer(strategy="mean", inputCols=columns, outputCols=[f"_f_{c}" for c in columns])
    doubles = df.withColumns({c: F.col(c).cast("double") for c in columns})
    values = filled.fit(doubles).transform(doubles)
    vector = VectorAssembler(inputCols=[f"_f_{c}" for c in columns], outputCol="_v")
    ready = vector.transform(values).drop(*[f"_f_{c}" for c in columns])
    if center:
        # the fitted PCA turns vectors without moving them, so they are centered before
        ready = StandardScaler(withMean=True, withStd=False, inputCol="_v", outputCol="_c").fit(ready).transform(
            ready).drop("_v").withColumnRenamed("_c", "_v")
        fitted = PCA(k=k, inputCol="_v", outputCol="_pc").fit(ready)
        out, signs = fitted.transform(ready), _upright(fitted.pc.toArray())
    else:
        from pyspark.mllib.linalg.distributed import RowMatrix
        from pyspark.mllib.util import MLUtils
        rows = RowMatrix(MLUtils.convertVectorColumnsFromML(ready.select("_v"), "_v"))
        v = rows.computeSVD(k).V.toArray()
        v = v * np.array(_upright(v))
        arr = vector_to_array("_v")
        parts = [F.aggregate(F.zip_with(arr, F.array(*map(F.lit, v[:, j].tolist())), lambda x, y: x * y), F.lit(0.0),
                             lambda t, x: t + x).alias(f"{prefix}{j + 1}") for j in range(v.shape[1])]
        return ready.select(*df.columns, *parts)
    arr = vector_to_array("_pc")
    return out.select(*df.columns, *[(F.get(arr, F.lit(j)) * signs[j]).alias(f"{prefix}{j + 1}") for j in range(k)])
