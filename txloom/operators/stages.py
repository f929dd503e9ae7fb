"""The fitted operators as Spark ML stages, for use in ``pyspark.ml.Pipeline``.

A fitted stage holds a (column, value, ...) table or a list of column names.
Both are saved with the stage.
"""

from __future__ import annotations

import json

from pyspark import keyword_only
from pyspark.ml import Estimator, Model, Transformer
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param.shared import HasFeaturesCol, HasInputCols, HasLabelCol, HasOutputCol, HasThreshold
from pyspark.ml.util import (
    DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReadable, MLReader,
    MLWritable, MLWriter,
)
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructType

from ..functions.ratios import amount_ratios, pairwise_ratios
from ..schema import LABEL
from ..session import settle
from . import encoders, impute
from .correlation import pruned_ratios
from .groupstats import COLUMN
from .narrow import constant_columns


class _TableWriter(MLWriter):
    def __init__(self, instance):
        super().__init__()
        self.instance = instance

    def saveImpl(self, path):
        # An empty table leaves no files to read a schema from.
        schema = {"tableSchema": self.instance.table.schema.json()}
        DefaultParamsWriter.saveMetadata(self.instance, path, self.sparkSession, schema)
        self.instance.table.write.partitionBy(COLUMN).parquet(f"{path}/table")


class _TableReader(MLReader):
    def __init__(self, cls):
        super().__init__()
        self.cls = cls

    def load(self, path):
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        model = self.cls()
        model._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        schema = StructType.fromJson(json.loads(metadata["tableSchema"]))
        model.table = self.sparkSession.read.schema(schema).parquet(f"{path}/table")
        return model


class TableModel(Model, HasInputCols, MLReadable, MLWritable):
    """A fitted encoder: its table and how it is applied."""

    def __init__(self, table: DataFrame | None = None):
        super().__init__()
        self.table = table

    def write(self):
        return _TableWriter(self)

    @classmethod
    def read(cls):
        return _TableReader(cls)


class _Fitted(Estimator, HasInputCols, DefaultParamsReadable, DefaultParamsWritable):
    """Base of the encoders: ``_table`` builds the table, ``model`` names the fitted class."""

    model: type[TableModel]

    def _table(self, df: DataFrame) -> DataFrame:
        raise NotImplementedError

    def _fit(self, dataset: DataFrame) -> TableModel:
        table = settle(self._table(dataset), type(self).__name__.lower(), COLUMN)
        return self._copyValues(self.model(table))


class HasLimit(Params):
    limit = Param(Params._dummy(), "limit", "training rows a category must exceed", TypeConverters.toInt)

    def __init__(self):
        super().__init__()
        self._setDefault(limit=0)


class CategoryLimitModel(TableModel):
    def _transform(self, dataset):
        return encoders.apply_limit(dataset, self.table, self.getInputCols())


class CategoryLimit(_Fitted, HasLimit):
    """Rare, unshared and null categories become 'unknown'; fitted on rows with a split column."""

    model = CategoryLimitModel

    @keyword_only
    def __init__(self, *, inputCols=None, limit=0):
        super().__init__()
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _table(self, df):
        return encoders.limited_values(df, self.getInputCols(), self.getOrDefault("limit"))


class SharedDictionaryModel(TableModel):
    def _transform(self, dataset):
        return encoders.apply_codes(dataset, self.table, self.getInputCols())


class SharedDictionary(_Fitted, HasLimit):
    """All listed columns coded by one dictionary; fitted on rows with a split column."""

    model = SharedDictionaryModel

    @keyword_only
    def __init__(self, *, inputCols=None, limit=0):
        super().__init__()
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _table(self, df):
        return encoders.shared_dictionary(df, self.getInputCols(), self.getOrDefault("limit"))


class TargetEncoderModel(TableModel):
    def _transform(self, dataset):
        return encoders.apply_means(dataset, self.table, self.getInputCols())


class TargetEncoder(_Fitted, HasLabelCol):
    """Categories become their mean label, unseen ones the mean of the mapped column."""

    model = TargetEncoderModel

    @keyword_only
    def __init__(self, *, inputCols=None, labelCol=LABEL):
        super().__init__()
        self._set(**{k: v for k, v in {"labelCol": LABEL, **self._input_kwargs}.items() if v is not None})

    def _table(self, df):
        return encoders.target_means(df, self.getInputCols(), self.getLabelCol())


class FrequencyEncoderModel(TableModel):
    def _transform(self, dataset):
        return encoders.apply_counts(dataset, self.table, self.getInputCols())


class FrequencyEncoder(_Fitted):
    """Categories become counts, unseen ones 0."""

    model = FrequencyEncoderModel

    @keyword_only
    def __init__(self, *, inputCols=None):
        super().__init__()
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _table(self, df):
        return encoders.frequency_counts(df, self.getInputCols())


class SelectColumns(Transformer, HasInputCols, DefaultParamsReadable, DefaultParamsWritable):
    """Projection by list."""

    @keyword_only
    def __init__(self, *, inputCols=None):
        super().__init__()
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _transform(self, dataset):
        return dataset.select(*self.getInputCols())


class DropColumns(Model, DefaultParamsReadable, DefaultParamsWritable):
    """Drops the columns that a fit found."""

    found = Param(Params._dummy(), "found", "columns to drop", TypeConverters.toListString)

    def __init__(self, found=()):
        super().__init__()
        self._set(found=list(found))

    def _transform(self, dataset):
        return dataset.drop(*self.getOrDefault("found"))


class DropConstant(Estimator, HasInputCols, DefaultParamsReadable, DefaultParamsWritable):
    """Finds the columns with one distinct value."""

    @keyword_only
    def __init__(self, *, inputCols=None):
        super().__init__()
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _fit(self, dataset):
        names = self.getInputCols() if self.isDefined("inputCols") else dataset.columns
        return DropColumns(constant_columns(dataset, names))


class RatiosModel(Model, HasInputCols, DefaultParamsReadable, DefaultParamsWritable):
    """Adds the ratio features that survived, drops the base columns that did not."""

    found = Param(Params._dummy(), "found", "columns to leave out", TypeConverters.toListString)

    def __init__(self, found=()):
        super().__init__()
        self._set(found=list(found))

    def _transform(self, dataset):
        gone = set(self.getOrDefault("found"))
        made = {**amount_ratios(dataset, self.getInputCols()), **pairwise_ratios(dataset, self.getInputCols())}
        return dataset.select("*", *[e.alias(n) for n, e in made.items() if n not in gone]).drop(*gone)


class PrunedRatios(Estimator, HasInputCols, HasThreshold, DefaultParamsReadable, DefaultParamsWritable):
    """Ratio features without rank-correlated repetitions, fitted on the given (training) rows."""

    @keyword_only
    def __init__(self, *, inputCols=None, threshold=0.99):
        super().__init__()
        self._set(**{k: v for k, v in {"threshold": 0.99, **self._input_kwargs}.items() if v is not None})

    def _fit(self, dataset):
        names = self.getInputCols()
        _, dropped = pruned_ratios(dataset, None, self.getThreshold(), names, names)
        return self._copyValues(RatiosModel(sorted({c for cs in dropped.values() for c in cs})))



class _NestedWriter(MLWriter):
    """Params as usual, and the stage inside in a folder of its own."""

    def __init__(self, instance):
        super().__init__()
        self.instance = instance

    def saveImpl(self, path):
        DefaultParamsWriter.saveMetadata(self.instance, path, self.sparkSession)
        self.instance.inner.write().save(f"{path}/inner")


class _NestedReader(MLReader):
    def __init__(self, cls):
        super().__init__()
        self.cls = cls

    def load(self, path):
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        stage = self.cls()
        stage._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(stage, metadata)
        stage.inner = DefaultParamsReader.loadParamsInstance(f"{path}/inner", self.sparkSession)
        return stage


class _Nested(Params, MLReadable, MLWritable):
    """A stage that holds another one: an estimator before, a model after the fit."""

    inner = None

    def write(self):
        return _NestedWriter(self)

    @classmethod
    def read(cls):
        return _NestedReader(cls)

    def copy(self, extra=None):
        """Params of the stage inside may be among ``extra``, so that a search reaches them."""
        that = Params.copy(self, {p: v for p, v in (extra or {}).items() if self.hasParam(p.name) and p.parent == self.uid})
        own = {p: v for p, v in (extra or {}).items() if self.inner is not None and p.parent == self.inner.uid}
        that.inner = self.inner.copy(own) if self.inner is not None else None
        return that


class ImportanceSelectorModel(Model, HasFeaturesCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """Keeps the chosen places of the input vector."""

    chosen = Param(Params._dummy(), "chosen", "places to keep", TypeConverters.toListInt)
    shares = Param(Params._dummy(), "shares", "importance of every place", TypeConverters.toListFloat)

    def __init__(self, chosen=(), shares=()):
        super().__init__()
        self._set(chosen=list(chosen), shares=list(shares))

    def _transform(self, dataset):
        values = vector_to_array(self.getFeaturesCol())
        picked = F.array(*[F.get(values, F.lit(i)) for i in self.getOrDefault("chosen")])
        return dataset.withColumn(self.getOutputCol(), array_to_vector(picked))


class ImportanceSelector(_Nested, Estimator, HasFeaturesCol, HasOutputCol, HasLabelCol, HasThreshold):
    """Columns whose share of a model's importance reaches ``threshold`` (the mean share, if not set).

    The model is fitted together with the stage, so inside a pipeline and under
    cross-validation the choice is made anew on the rows of each fit.
    """

    def __init__(self, estimator=None, threshold=None, outputCol="chosen", featuresCol="features", labelCol=LABEL):
        super().__init__()
        self.inner = estimator
        self._set(outputCol=outputCol, featuresCol=featuresCol, labelCol=labelCol)
        if threshold is not None:
            self._set(threshold=threshold)

    def _fit(self, dataset):
        inner = self.inner.copy({self.inner.featuresCol: self.getFeaturesCol(), self.inner.labelCol: self.getLabelCol()})
        shares = [float(v) for v in inner.fit(dataset).featureImportances.toArray()]
        limit = self.getThreshold() if self.isSet("threshold") else 1.0 / len(shares)
        chosen = [i for i, v in enumerate(shares) if v >= limit]
        if not chosen:
            raise ValueError(f"no column reaches the importance {limit}")
        return ImportanceSelectorModel(chosen, shares)._set(featuresCol=self.getFeaturesCol(), outputCol=self.getOutputCol())


class HasKind(Params):
    kind = Param(Params._dummy(), "kind", "'class' or 'probability' (of class 1)", TypeConverters.toString)


class ModelFeatureModel(_Nested, Model, HasFeaturesCol, HasOutputCol, HasKind):
    """Adds what a fitted model predicts; no other column changes."""

    def _transform(self, dataset):
        scored = self.inner.transform(dataset)
        value = F.col("prediction") if self.getOrDefault("kind") == "class" else vector_to_array("probability")[1]
        return scored.select(*[f"`{c}`" for c in dataset.columns], value.alias(self.getOutputCol()))


class ModelFeature(_Nested, Estimator, HasFeaturesCol, HasOutputCol, HasLabelCol, HasKind):
    """A classifier as a feature: fitted with the pipeline, its hard class or probability becomes a column."""

    def __init__(self, estimator=None, outputCol="model_class", kind="class", featuresCol="features", labelCol=LABEL):
        super().__init__()
        if kind not in ("class", "probability"):
            raise ValueError("kind must be 'class' or 'probability'")
        self.inner = estimator
        self._set(outputCol=outputCol, kind=kind, featuresCol=featuresCol, labelCol=labelCol)

    def _fit(self, dataset):
        inner = self.inner.copy({self.inner.featuresCol: self.getFeaturesCol(), self.inner.labelCol: self.getLabelCol()})
        model = ModelFeatureModel()._set(featuresCol=self.getFeaturesCol(), outputCol=self.getOutputCol(), kind=self.getOrDefault("kind"))
        model.inner = inner.fit(dataset)
        return model


class FillMissing(Transformer, HasInputCols, DefaultParamsReadable, DefaultParamsWritable):
    """Nulls, NaN and infinities of the listed columns become constants."""

    onNull = Param(Params._dummy(), "onNull", "value for null and NaN", TypeConverters.toFloat)
    onInf = Param(Params._dummy(), "onInf", "value for infinities", TypeConverters.toFloat)

    @keyword_only
    def __init__(self, *, inputCols=None, onNull=-999.0, onInf=-999.0):
        super().__init__()
        self._set(**{k: v for k, v in {"onNull": -999.0, "onInf": -999.0, **self._input_kwargs}.items() if v is not None})

    def _transform(self, dataset):
        return impute.fill_constant(dataset, self.getOrDefault("onNull"), self.getOrDefault("onInf"), self.getInputCols())
