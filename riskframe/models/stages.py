"""The operators as Spark ML stages: one ``Pipeline`` from raw table to scores, tuned, saved and loaded like any other.

Every stage is an Estimator with typed parameters; its model keeps what was fitted (numbers, tables, models) and is written
with the same bundles as everything else. Stages that make a vector append to ``featuresCol`` or replace it.

    Pipeline(stages=[FillMissing(inputCols=NUMERIC), Scale(inputCols=NUMERIC, kind="standard"),
                     Assemble(inputCols=NUMERIC), ClusterDistances(k=8), Classify(kind="gbt")])
"""

from __future__ import annotations

import json

from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskframe.models.base import fit_model
from riskframe.operators import build, clean, cluster, encode, project, scale, schema, select
from riskframe.sources.io import load_bundle, save_bundle


def _param(name: str, doc: str, convert) -> Param:
    return Param(Params._dummy(), name, doc, convert)


class Stage(Estimator, DefaultParamsReadable, DefaultParamsWritable):
    """An operator pair: ``fitted`` makes the state from rows, ``apply`` uses it."""

    inputCols = _param("inputCols", "columns read", TypeConverters.toListString)
    featuresCol = _param("featuresCol", "array column of features", TypeConverters.toString)
    labelCol = _param("labelCol", "0/1 label", TypeConverters.toString)
    keyCol = _param("keyCol", "row key", TypeConverters.toString)
    defaults: dict = {}

    def __init__(self, **settings):
        super().__init__()
        self._setDefault(featuresCol="features", labelCol="target", keyCol="company_id", **self.defaults)
        self._set(**settings)

    def get(self, name: str):
        return self.getOrDefault(name)

    def fitted(self, df: DataFrame):
        return None

    def apply(self, df: DataFrame, state) -> DataFrame:
        raise NotImplementedError

    def _fit(self, dataset: DataFrame) -> FittedStage:
        return FittedStage(self.copy(), self.fitted(dataset))

    def _appended(self, df: DataFrame, *parts) -> DataFrame:
        """``featuresCol`` followed by the given arrays."""
        return df.withColumn(self.get("featuresCol"), F.concat(F.col(self.get("featuresCol")), *parts))


class FittedStage(Model, MLReadable, MLWritable):
    """A fitted stage: its settings and its state."""

    def __init__(self, stage: Stage | None = None, state=None):
        super().__init__()
        self.stage, self.state = stage, state

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return self.stage.apply(dataset, self.state)

    def write(self) -> MLWriter:
        return _Writer(self)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader(cls)


class _Writer(MLWriter):
    def __init__(self, model: FittedStage):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        spark = SparkSession.active()
        DefaultParamsWriter.saveMetadata(self.model, path, spark)
        self.model.stage.write().overwrite().save(f"{path}/stage")
        save_bundle({"state": self.model.state}, f"{path}/state", spark)


class _Reader(MLReader):
    def __init__(self, cls):
        super().__init__()
        self.cls = cls

    def load(self, path: str) -> FittedStage:
        spark = SparkSession.active()
        out = self.cls(DefaultParamsReader.loadParamsInstance(f"{path}/stage", spark), load_bundle(spark, f"{path}/state")["state"])
        out._resetUid(DefaultParamsReader.loadMetadata(path, spark)["uid"])
        return out


class FillMissing(Stage):
    """Mean, median or a constant for null and NaN."""

    strategy = _param("strategy", "mean, median or constant", TypeConverters.toString)
    value = _param("value", "the constant", TypeConverters.toFloat)
    defaults = {"strategy": "mean", "value": 0.0}

    def fitted(self, df):
        return clean.fit_impute(df, self.get("inputCols"), self.get("strategy"), self.get("value"))

    def apply(self, df, state):
        return clean.apply_impute(df, state)


class Scale(Stage):
    kind = _param("kind", "standard, robust, minmax, quantile or power", TypeConverters.toString)
    defaults = {"kind": "standard"}

    def fitted(self, df):
        return scale.fit_scale(df, self.get("inputCols"), self.get("kind"))

    def apply(self, df, state):
        return scale.apply_scale(df, state)


class LabelEncode(Stage):
    """Codes by the rank of the category; the dictionary is a table."""

    def fitted(self, df):
        return encode.fit_label(df, self.get("inputCols"))

    def apply(self, df, state):
        return encode.apply_label(df, state)


class TargetEncode(Stage):
    """``<column>_target_encoded`` beside each column."""

    smoothing = _param("smoothing", "weight of the overall rate", TypeConverters.toFloat)
    defaults = {"smoothing": 1.0}

    def fitted(self, df):
        return encode.fit_target(df, self.get("inputCols"), self.get("labelCol"), self.get("smoothing"))

    def apply(self, df, state):
        return encode.apply_target(df, state)


class OneHot(Stage):
    """0/1 columns by category, unseen ones all 0."""

    def fitted(self, df):
        return encode.fit_onehot(df, self.get("inputCols"), drop_first=False)

    def apply(self, df, state):
        return encode.apply_onehot(df, state)


class Bins(Stage):
    n = _param("n", "bins", TypeConverters.toInt)
    strategy = _param("strategy", "quantile or uniform", TypeConverters.toString)
    defaults = {"n": 5, "strategy": "quantile"}

    def fitted(self, df):
        return encode.fit_bins(df, self.get("inputCols"), self.get("n"), self.get("strategy"))

    def apply(self, df, state):
        return encode.apply_bins(df, state)


class Assemble(Stage):
    """The columns into ``featuresCol``; without ``inputCols``, all numbers but key, label and fold, as seen at fit time.

    A column that a table to be scored lacks is 0 there.
    """

    leave = _param("leave", "columns that are no features", TypeConverters.toListString)
    defaults = {"leave": ["fold"]}

    def fitted(self, df):
        if self.isDefined("inputCols"):
            return list(self.get("inputCols"))
        out = {self.get("keyCol"), self.get("labelCol"), *self.get("leave")}
        return [c for c in schema.numeric_cols(df) if c not in out]

    def apply(self, df, state):
        df = df.withColumns({c: F.lit(0.0) for c in state if c not in df.columns})
        return schema.assemble(df, state, self.get("featuresCol"))


class RowStatistics(Stage):
    """Appends ten statistics of each row's features."""

    def apply(self, df, state):
        before = df.columns
        df = build.row_stats(df, self.get("featuresCol"))
        return self._appended(df, F.array(*build.ROW_STATS)).select(before)


class ClusterDistances(Stage):
    """Appends the distances to ``k`` centres."""

    k = _param("k", "centres", TypeConverters.toInt)
    seed = _param("seed", "of the seeding", TypeConverters.toInt)
    defaults = {"k": 8, "seed": 42}

    def fitted(self, df):
        return cluster.fit_kmeans(df, self.get("k"), self.get("seed"), col=self.get("featuresCol"))

    def apply(self, df, state):
        before = df.columns
        return self._appended(cluster.kmeans_features(df, state, self.get("featuresCol")), F.col("centre_dist")).select(before)


class Isolation(Stage):
    """Appends the anomaly score of random trees."""

    trees = _param("trees", "random trees", TypeConverters.toInt)
    sample = _param("sample", "rows of a tree", TypeConverters.toInt)
    seed = _param("seed", "of the trees", TypeConverters.toInt)
    defaults = {"trees": 100, "sample": 256, "seed": 42}

    def fitted(self, df):
        return cluster.fit_isolation(df, self.get("trees"), self.get("sample"), self.get("seed"), key=self.get("keyCol"), feat=self.get("featuresCol"))

    def apply(self, df, state):
        before = df.columns
        return self._appended(cluster.apply_isolation(df, state, self.get("featuresCol")), F.array("anomaly")).select(before)


class OutlierFactor(Stage):
    """Appends the local outlier factor against the fitted rows; a fitted row meets itself there, as a new copy would."""

    k = _param("k", "neighbours", TypeConverters.toInt)
    defaults = {"k": 20}

    def fitted(self, df):
        return cluster.fit_lof(df, self.get("k"), self.get("keyCol"), self.get("featuresCol"))

    def apply(self, df, state):
        key, before = self.get("keyCol"), df.columns
        found = cluster.score_lof(df, state, key, self.get("featuresCol")).withColumnRenamed("lof", "__lof")
        return self._appended(df.join(found, key), F.array("__lof")).select(before)


class Projection(Stage):
    """Features onto the leading directions: ``pca`` (centred) or ``svd``."""

    kind = _param("kind", "pca or svd", TypeConverters.toString)
    k = _param("k", "directions", TypeConverters.toInt)
    defaults = {"kind": "svd", "k": 5}

    def fitted(self, df):
        fit = {"pca": project.fit_pca, "svd": project.fit_svd}[self.get("kind")]
        return fit(df, self.get("k"), col=self.get("featuresCol"))

    def apply(self, df, state):
        return project.project(df, state, self.get("featuresCol"), self.get("featuresCol"))


class Select(Stage):
    """Keeps feature positions: ``variance`` above ``t``, the best ``k`` by ``anova``, or ``fisher`` ratio above ``t``."""

    method = _param("method", "variance, anova or fisher", TypeConverters.toString)
    k = _param("k", "positions kept by anova", TypeConverters.toInt)
    t = _param("t", "least value", TypeConverters.toFloat)
    defaults = {"method": "variance", "k": 10, "t": 0.0}

    def fitted(self, df):
        col, label = self.get("featuresCol"), self.get("labelCol")
        if self.get("method") == "variance":
            mask = select.variance_mask(df, self.get("t"), col)
        elif self.get("method") == "anova":
            mask = select.anova_f(df, label, self.get("k"), col)
        elif self.get("method") == "fisher":
            mask = select.fisher_ratio(df, label, self.get("t"), col)
        else:
            raise ValueError(f"unknown method {self.get('method')!r}")
        return select.selected_positions(mask)

    def apply(self, df, state):
        return schema.slice_features(df, state, self.get("featuresCol"))


class Classify(Stage):
    """A classifier of ``fit_model``; adds ``outputCol``. ``settings`` is its parameters as JSON text."""

    kind = _param("kind", "classifier", TypeConverters.toString)
    settings = _param("settings", "parameters of the classifier, as JSON", TypeConverters.toString)
    weightCol = _param("weightCol", "row weight", TypeConverters.toString)
    outputCol = _param("outputCol", "score", TypeConverters.toString)
    defaults = {"kind": "gbt", "settings": "{}", "outputCol": "proba"}

    def fitted(self, df):
        weight = self.get("weightCol") if self.isDefined("weightCol") else None
        return fit_model(df, self.get("labelCol"), self.get("kind"), json.loads(self.get("settings")), weight, col=self.get("featuresCol"), key=self.get("keyCol"))

    def apply(self, df, state):
        return state.score(df, self.get("outputCol"))
