"""User extension points: metrics over curve points, an ML evaluator, a screening stage, a model-based selector."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.ml import Estimator, Model
from pyspark.ml.evaluation import Evaluator
from pyspark.ml.feature import VectorSlicer
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame, functions as F

from . import discrimination
from .models import LEARNERS, learner, probability
from .thresholds import OBJECTIVES


def register_metric(name: str, aggregate: Callable[[], Column]) -> None:
    """Add a metric: an aggregate over curve points (p, pos, neg, tp, fp, n_pos, n_neg, keep).

    Registered metrics work in ``curve_metrics`` and in the bootstrap; the rows
    of a group are never handed to Python.
    """
    discrimination.CURVE_METRICS[name] = aggregate


def register_objective(name: str, builder: Callable[..., Column]) -> None:
    """Add a threshold rule: builder(**options) -> aggregate over curve points."""
    OBJECTIVES[name] = builder


class CurveEvaluator(Evaluator):
    """Spark ML evaluator for any registered metric (exact, not binned)."""

    def __init__(self, metric: str = "auroc", label: str = "y"):
        super().__init__()
        self.metric, self.label = metric, label

    def _evaluate(self, dataset: DataFrame) -> float:
        pts = discrimination.points_of(probability(dataset), [], self.label, "y_prob")
        row = discrimination.curve_metrics(pts, [], [self.metric]).first()
        return float("nan") if row[0] is None else float(row[0])

    def isLargerBetter(self) -> bool:
        return True


class FeatureScreen(Estimator):
    """Learns which feature columns pass a screen (and the k best of them)."""

    def __init__(self, features: Sequence[str], method: str = "mannwhitney", top: int = 0, k: int | None = None, label: str = "y", id_col: str = "id"):
        super().__init__()
        self.features, self.method, self.top, self.k, self.label, self.id_col = list(features), method, top, k, label, id_col

    def _fit(self, dataset: DataFrame) -> "FeatureScreenModel":
        from .models import select_features

        kept = select_features(dataset, self.features, self.method, self.top, self.k, self.label, self.id_col)
        return FeatureScreenModel(self.features, kept)


class FeatureScreenModel(Model):
    """Drops the feature columns that did not pass."""

    def __init__(self, features: Sequence[str], kept: Sequence[str]):
        super().__init__()
        self.features, self.kept = list(features), list(kept)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        gone = set(self.features) - set(self.kept)
        return dataset.select(*[F.col(c) for c in dataset.columns if c not in gone])


#: Light settings for fits that only rank features.
SELECTOR_SETTINGS = {"RF": {"numTrees": 20, "maxDepth": 5}, "GBT": {"maxIter": 10, "maxDepth": 3}}


def threshold_value(rule: str, importances: np.ndarray) -> float:
    """'mean', 'median', a multiple of one ('1.25*mean') or a number."""
    scale, _, name = rule.rpartition("*")
    if name in ("mean", "median"):
        return float(scale or 1.0) * float(getattr(np, name)(importances))
    return float(rule)


def selected_positions(importances: np.ndarray, rule: str = "median", most: int = 0, least: int = 10) -> list[int]:
    """Positions at or above the threshold, at most ``most`` of them (0: any number).

    Fewer than ``least``: the ``least`` most important instead; none at all among fewer columns: all.  Ties go to the first.
    """
    order = np.argsort(-importances, kind="stable")
    keep = importances >= threshold_value(rule, importances)
    if most:
        keep &= np.isin(np.arange(len(importances)), order[:most])
    if keep.sum() < least <= len(importances):
        keep = np.isin(np.arange(len(importances)), order[:least])
    elif not keep.any():
        keep[:] = True
    return np.flatnonzero(keep).tolist()


class _SelectorParams(Params):
    modelName = Param(Params._dummy(), "modelName", "learner whose importances decide", TypeConverters.toString)
    threshold = Param(Params._dummy(), "threshold", "mean, median, a multiple of one, or a number", TypeConverters.toString)
    maxFeatures = Param(Params._dummy(), "maxFeatures", "at most so many; 0: no limit", TypeConverters.toInt)
    minFeatures = Param(Params._dummy(), "minFeatures", "at least so many", TypeConverters.toInt)
    labelCol = Param(Params._dummy(), "labelCol", "label column", TypeConverters.toString)
    featuresCol = Param(Params._dummy(), "featuresCol", "vector column", TypeConverters.toString)
    outputCol = Param(Params._dummy(), "outputCol", "vector of the selected features", TypeConverters.toString)
    indices = Param(Params._dummy(), "indices", "selected positions", TypeConverters.toListInt)


class ModelSelector(Estimator, _SelectorParams, DefaultParamsReadable, DefaultParamsWritable):
    """Pipeline stage that fits a learner and passes on the features with large coefficients or impurity importances."""

    def __init__(self, modelName: str = "LR_EN", threshold: str = "median", maxFeatures: int = 0, minFeatures: int = 10, labelCol: str = "y", featuresCol: str = "features", outputCol: str = "selected"):
        super().__init__()
        if modelName not in LEARNERS:
            raise ValueError(f"unknown learner {modelName!r}; one of {sorted(LEARNERS)}")
        self._set(modelName=modelName, threshold=str(threshold), maxFeatures=maxFeatures, minFeatures=minFeatures, labelCol=labelCol, featuresCol=featuresCol, outputCol=outputCol)

    def _fit(self, dataset: DataFrame) -> "ModelSelectorModel":
        name = self.getOrDefault("modelName")
        fit = learner(name, self.getOrDefault("labelCol"), **SELECTOR_SETTINGS.get(name, {})).setFeaturesCol(self.getOrDefault("featuresCol")).fit(dataset)
        importances = np.abs((fit.coefficients if hasattr(fit, "coefficients") else fit.featureImportances).toArray())
        positions = selected_positions(importances, self.getOrDefault("threshold"), self.getOrDefault("maxFeatures"), self.getOrDefault("minFeatures"))
        return ModelSelectorModel(positions, self.getOrDefault("featuresCol"), self.getOrDefault("outputCol"))


class ModelSelectorModel(Model, _SelectorParams, DefaultParamsReadable, DefaultParamsWritable):
    """The selected part of the feature vector."""

    def __init__(self, indices: Sequence[int] = (), featuresCol: str = "features", outputCol: str = "selected"):
        super().__init__()
        self._set(indices=list(indices), featuresCol=featuresCol, outputCol=outputCol)

    def selected(self, names: Sequence[str]) -> list[str]:
        """Names of the selected features; ``names`` are those of the vector."""
        return [names[i] for i in self.getOrDefault("indices")]

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return VectorSlicer(inputCol=self.getOrDefault("featuresCol"), outputCol=self.getOrDefault("outputCol"), indices=self.getOrDefault("indices")).transform(dataset)
