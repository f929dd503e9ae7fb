"""Cross-validated training, test scoring and submission."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from ..operators.blend import mean_blend, stack_models, weighted_blend
from ..operators.folds import EXPANDING_WEIGHTS, TIME_SCHEMES, group_kfold, kfold, stratified_kfold, time_folds
from ..operators.metrics import auc
from ..operators.training import assemble, cross_validate, more_rounds
from ..schema import KEY, LABEL, SPLIT
from ..sources.sinks import submission, write_submission


@dataclass
class Scored:
    oof: DataFrame
    scores: DataFrame
    predictions: DataFrame
    auc: float

    def save(self, template: DataFrame, folder: str) -> str:
        return write_submission(submission(template, self.predictions), folder, self.auc)


def make_folds(train: DataFrame, k: int, split_type: str = "stratifiedkfold", group: str | None = None,
               shuffle: bool = True, seed: int = 42) -> DataFrame:
    if split_type == "kfold":
        return kfold(train, k, shuffle=shuffle, seed=seed)
    if split_type == "stratifiedkfold":
        return stratified_kfold(train, k, shuffle=shuffle, seed=seed)
    if split_type == "groupkfold":
        return group_kfold(train, k, group)
    raise ValueError("split_type must be kfold, stratifiedkfold or groupkfold")


def score_test(table: DataFrame, columns, models: dict, k: int = 5, split_type: str = "stratifiedkfold",
               group: str | None = None, seed: int = 42, stacking: str = "lr", c: float = 0.01,
               shuffle: bool = True) -> Scored:
    """Cross-validate on the training rows and score the test rows with every fold's models.

    Several models are joined per fold: ``stacking='lr'`` by a logistic
    regression of inverse penalty ``c``, ``'mean'`` by their mean.  The folds
    are averaged; ``auc`` is the mean validation AUC of what is averaged.
    """
    if stacking not in ("lr", "mean"):
        raise ValueError("stacking must be lr or mean")
    train = table.where(F.col(SPLIT) == "train")
    folds = make_folds(train, k, split_type, group, shuffle, seed)
    rows = assemble(train, columns, [KEY, LABEL])
    test = assemble(table.where(F.col(SPLIT) == "test"), columns, [KEY])
    oof, scores, tested = cross_validate(models, rows, folds, test)
    if len(models) > 1 and stacking == "lr":
        joined, tested = stack_models(oof, list(models), c, tested)
        valid = joined.where("role = 'valid'")
    else:
        valid = oof.where("role = 'valid'").groupBy("fold", KEY, "label").agg(F.avg("prediction").alias("prediction"))
    score = auc(valid, by=["fold"]).agg(F.avg("auc")).first()[0]
    return Scored(oof, scores, mean_blend(tested), score)


def score_expanding(table: DataFrame, columns, models: dict, period: str, splits=None, weights: dict | None = None,
                    rounds: float = 1.1) -> Scored:
    """Train on growing spans of time and validate on the span that follows; a last fold trains on all rows.

    ``period`` numbers the spans of the training rows from 0.  The test
    predictions are the mean of the models, weighted by fold; from the fourth
    fold on, models get ``rounds`` times their rounds.  ``auc`` is the mean
    validation AUC of the folds that have one.
    """
    train = table.where(F.col(SPLIT) == "train")
    folds = time_folds(train, period, splits or TIME_SCHEMES["expanding"], whole=True)
    rows = assemble(train, columns, [KEY, LABEL])
    test = assemble(table.where(F.col(SPLIT) == "test"), columns, [KEY])
    oof, scores, tested = cross_validate(models, rows, folds, test, by_fold=more_rounds(rounds))
    by_model = mean_blend(tested, (KEY, "fold"))
    predictions = weighted_blend(by_model, weights or EXPANDING_WEIGHTS, "fold")
    return Scored(oof, scores, predictions, scores.agg(F.avg("valid_auc")).first()[0])
