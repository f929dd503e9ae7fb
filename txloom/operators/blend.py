"""Blending, stacking and post-processing of predictions.

Predictions are held long: (model, key, prediction), out-of-fold ones also
with fold, role and label.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from ..schema import KEY, LABEL, SPLIT
from ..session import settle
from .lookup import attach
from .metrics import auc
from .ordered import average_rank, group_quantile, row_index
from .training import fit_all


def mean_blend(predictions: DataFrame, by=(KEY,), compat: bool = False) -> DataFrame:
    """Mean over models and folds; ``compat`` adds the folds up as the original did for several models."""
    if not compat:
        return predictions.groupBy(*by).agg(F.avg("prediction").alias("prediction"))
    folds = predictions.groupBy(*by, "fold").agg(F.avg("prediction").alias("_fold"))
    return folds.groupBy(*by).agg(F.sum("_fold").alias("prediction"))


def geometric_blend(predictions: DataFrame, by=(KEY,)) -> DataFrame:
    p = F.col("prediction")
    return predictions.groupBy(*by).agg(
        F.when(F.min(p) <= 0, F.lit(0.0)).otherwise(F.exp(F.avg(F.ln(F.when(p > 0, p))))).alias("prediction"))


def weighted_blend(predictions: DataFrame, weights: dict, of: str = "model", by=(KEY,)) -> DataFrame:
    """Weighted mean; a model (or fold) that has no weight is an error, weight 0 leaves it out."""
    unknown = F.raise_error(F.concat(F.lit(f"no weight for {of} "), F.coalesce(F.col(of).cast("string"), F.lit("null"))))
    w = F.coalesce(*[F.when(F.col(of) == m, F.lit(float(v))) for m, v in weights.items()], unknown.cast("double"))
    return predictions.groupBy(*by).agg(
        (F.sum(F.col("prediction") * w) / F.sum(w)).alias("prediction"))


def rank_blend(predictions: DataFrame, by=(KEY,), chunks: int | None = None) -> DataFrame:
    """Mean over the models of the prediction's average rank in its model, scaled to (0, 1]."""
    ranks = average_rank(predictions, ["model"], "prediction", "_rank", chunks).drop("n")
    sizes = settle(predictions.groupBy("model").agg(F.count("prediction").alias("_size")), "sizes")
    ranked = predictions.where("prediction is not null").join(ranks, ["model", "prediction"], "left").join(
        sizes, "model", "left")
    return ranked.groupBy(*by).agg(F.avg(F.col("_rank") / F.col("_size")).alias("prediction"))


def rank_fused(df: DataFrame, seen: str, general: str, special: str, key: str = KEY,
               chunks: int | None = None) -> DataFrame:
    """(key, fused_rank): two models on one rank scale.

    All rows are ranked by the ``general`` model.  The unseen rows hold some of
    these ranks; they exchange them among themselves so that the order within
    the unseen rows is that of the ``special`` model.
    """
    rows = settle(df.select(key, seen, general, special), "fusion")
    overall = settle(row_index(rows, [], [general, key], "_rank", chunks), "overall")
    unseen = overall.where(~F.col(seen))
    places = row_index(unseen.select(key, general, "_rank"), [], [general, key], "_at", chunks)
    wishes = row_index(unseen.select(key, special), [], [special, key], "_at", chunks)
    swapped = wishes.join(places.select("_at", "_rank"), "_at").select(key, F.col("_rank").alias("fused_rank"))
    return overall.where(F.col(seen)).select(key, F.col("_rank").alias("fused_rank")).unionByName(swapped)


def smooth_by_client(df: DataFrame, client: str, how: str = "mean", q: float = 0.9,
                     prediction: str = "prediction") -> DataFrame:
    """Every row gets one value of its client: mean or quantile; rows without client keep their own."""
    known = df.where(F.col(client).isNotNull())
    if how == "mean":
        table = known.groupBy(client).agg(F.avg(prediction).alias("smoothed"))
    else:
        table = group_quantile(known, [client], prediction, q, "smoothed")
    joined = attach(df, settle(table, "smooth"), {client: client})
    return joined.withColumn(prediction, F.coalesce("smoothed", prediction)).drop("smoothed")


def _client_labels(df: DataFrame, client: str, label: str) -> DataFrame:
    train = df.where((F.col(SPLIT) == "train") & F.col(client).isNotNull() & F.col(label).isNotNull())
    table = train.groupBy(client).agg(F.min(label).alias("_worst"), F.max(label).alias("_best"))
    return attach(df, settle(table, "labels"), {client: client})


def override_known(df: DataFrame, client: str, label: str = LABEL, prediction: str = "prediction") -> DataFrame:
    """Test rows of a client with only positive training rows get 1, with only negative ones 0."""
    known = _client_labels(df, client, label)
    sure = (F.col(SPLIT) == "test") & (F.col("_worst") == F.col("_best"))
    return known.withColumn(prediction, F.when(sure, F.col("_best").cast("double")).otherwise(
        F.col(prediction))).drop("_worst", "_best")


def raise_known(df: DataFrame, client: str, factor: float, label: str = LABEL,
                prediction: str = "prediction") -> DataFrame:
    """Multiply the test predictions of clients with a positive training row; the order of these rows is kept."""
    known = _client_labels(df, client, label)
    hit = (F.col(SPLIT) == "test") & (F.col("_best") == 1)
    return known.withColumn(prediction, F.when(hit, F.col(prediction) * factor).otherwise(F.col(prediction))).drop("_worst", "_best")


def confident_rows(df: DataFrame, low: float = 0.01, high: float = 0.99, prediction: str = "prediction",
                   label: str = LABEL, soft: bool = False) -> DataFrame:
    """Training rows plus the test rows with a sure prediction, labelled by it (as 0/1, or as is)."""
    p = F.col(prediction)
    sure = df.where((F.col(SPLIT) == "test") & ((p <= low) | (p >= high)))
    mark = p if soft else (p >= high).cast("int")
    labelled = sure.withColumn(label, mark.cast("double"))
    train = df.where(F.col(SPLIT) == "train").withColumn(label, F.col(label).cast("double"))
    return train.withColumn("pseudo", F.lit(False)).unionByName(labelled.withColumn("pseudo", F.lit(True)))


def wide_predictions(oof: DataFrame, models, by) -> DataFrame:
    """One column per model."""
    return oof.groupBy(*by).agg(*[F.max(F.when(F.col("model") == m, F.col("prediction"))).alias(m) for m in models])


def stacker(c: float, n: int, weight: str = "_rows") -> LogisticRegression:
    """Logistic regression with the penalty of inverse strength ``c`` (summed loss) on ``n`` rows, ``weight`` equal ones in each."""
    return LogisticRegression(featuresCol="_models", labelCol="label", weightCol=weight, regParam=1.0 / (c * n),
                              elasticNetParam=0.0, standardization=False, maxIter=100, tol=1e-8)


def stack_models(oof: DataFrame, models, c: float = 0.01,
                 tested: DataFrame | None = None) -> tuple[DataFrame, DataFrame | None]:
    """Per fold, a logistic regression on the predictions of the models.

    ``oof`` holds (model, fold, role, key, label, prediction) with the roles
    train (predictions on the rows a fold was fitted on) and valid; ``tested``
    holds (model, fold, key, prediction).  Returns (fold, role, key, label,
    prediction) and, of the test rows, (fold, key, prediction).
    """
    unseen = None if tested is None else _by_fold(wide_predictions(tested, models, ["fold", KEY]), models, "stack-test")
    return _stacked(*stack_input(oof, models), c, unseen)


def _by_fold(wide: DataFrame, models, name: str) -> DataFrame:
    """``wide`` written with files per fold, and the vector of the models' predictions; one that is missing or NaN is an error.

    The vector is made by expressions that filters pass, so a fold reads its
    own rows only; ``VectorAssembler`` would make vectors of all rows first.
    """
    def known(m: str) -> Column:
        unknown = F.raise_error(F.lit(f"a row has no prediction of model {m}")).cast("double")
        return F.when(F.col(m).isNull() | F.isnan(m), unknown).otherwise(F.col(m).cast("double"))

    written = settle(wide, name, "fold", rebalance=False)
    return written.withColumn("_models", array_to_vector(F.array(*[known(m) for m in models])))


def stack_input(oof: DataFrame, models) -> tuple[DataFrame, DataFrame, dict]:
    """Rows (fold, role, key, label, vector of the models' predictions), the training rows and their number per fold.

    Training rows of a fold with the same label and predictions are one row
    with their number, which a fit takes as weight: its steps read what
    differs, never more than the rows.
    """
    wide = wide_predictions(oof, models, ["fold", "role", KEY, "label"]).withColumn("label", F.col("label").cast("double"))
    vectors = _by_fold(wide, models, "stack")
    train = _by_fold(vectors.where("role = 'train'").groupBy("fold", "label", *models).agg(
        F.count(F.lit(1)).cast("double").alias("_rows")), models, "stack-train")
    counts = {r["fold"]: int(r["n"]) for r in train.groupBy("fold").agg(F.sum("_rows").alias("n")).collect()}  # one row per fold
    return vectors, train, counts


def _stacked(vectors: DataFrame, train: DataFrame, counts: dict, c: float,
             unseen: DataFrame | None = None) -> tuple[DataFrame, DataFrame | None]:
    score = vector_to_array("probability")[1].alias("prediction")
    out = out_test = None
    folds = sorted(counts)
    fitted = fit_all([(stacker(c, counts[f]), f) for f in folds], lambda f: train.where(F.col("fold") == f), 4, vectors.sparkSession)
    for fold, model in zip(folds, fitted):
        scored = model.transform(vectors.where(F.col("fold") == fold)).select("fold", "role", KEY, "label", score)
        out = scored if out is None else out.unionByName(scored)
        if unseen is not None:
            part = model.transform(unseen.where(F.col("fold") == fold)).select("fold", KEY, score)
            out_test = part if out_test is None else out_test.unionByName(part)
    return out, out_test


def stack_folds(oof: DataFrame, models, c: float = 0.01) -> DataFrame:
    """(fold, role, key, label, prediction) of :func:`stack_models`."""
    return stack_models(oof, models, c)[0]


def _valid_score(scored: DataFrame) -> float:
    return auc(scored.where("role = 'valid'"), by=["fold"]).agg(F.avg("auc")).first()[0]


def stacking_score(oof: DataFrame, models, c: float) -> float:
    """Mean over folds of the validation AUC of the stacker."""
    return _valid_score(stack_folds(oof, models, c))


def tune_stacking(oof: DataFrame, models, grid=(0.01, 0.1, 1.0)) -> dict[float, float]:
    """The score of :func:`stacking_score` for each strength; the predictions are put side by side once for all of them."""
    made = stack_input(oof, models)
    return {c: _valid_score(_stacked(*made, c)[0]) for c in grid}


def hill_climb(oof: DataFrame, models, steps: int = 10, key: str = KEY, label: str = "label",
               where: Column | None = None) -> tuple[list[str], list[float]]:
    """Models picked one at a time (with repetition) so that the mean of the picks has the best AUC.

    Each step is one aggregate that scores every candidate; it stops when no
    candidate improves the score.  Rows of one class alone have no score, so
    nothing is picked.
    """
    rows = oof.where(where) if where is not None else oof
    wide = settle(wide_predictions(rows, models, [key, label]), "climb")
    picked, scores = [], []
    for _ in range(steps):
        total = sum((F.col(m) for m in picked), F.lit(0.0))
        trial = [F.struct(F.lit(m).alias("model"), ((total + F.col(m)) / (len(picked) + 1)).alias("prediction"))
                 for m in models]
        found = auc(wide.select(label, F.inline(F.array(*trial))), label=label, by=["model"]).collect()
        found = [r for r in found if r["auc"] is not None]
        if not found:
            break
        best = max(found, key=lambda r: (r["auc"], r["model"]))
        if scores and best["auc"] <= scores[-1]:
            break
        picked.append(best["model"])
        scores.append(best["auc"])
    return picked, scores
