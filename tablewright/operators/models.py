"""The supervised models of each task with their search spaces."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark import keyword_only
from pyspark.ml import Estimator
from pyspark.ml.classification import (
    GBTClassifier,
    LogisticRegression,
    OneVsRest,
    RandomForestClassifier,
)
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame

from tablewright.operators.prepare import FEATURES
from tablewright.types import CLASSIFICATION, REGRESSION, SEED, grid_points

LABEL = "_label"
PREDICTION = "_prediction"
RAW = "_raw"
PROBABILITY = "_probability"
# Depth standing in for "no limit": the most that Spark allows.
DEPTH_CAP = 30


class InverseStrengthLogisticRegression(Estimator, DefaultParamsReadable, DefaultParamsWritable):
    """Logistic regression whose penalty is given as C: the weight of the summed loss.

    Spark weighs the mean loss instead, so the equal penalty depends on the rows of each fit.
    """

    C = Param(Params._dummy(), "C", "inverse penalty strength", TypeConverters.toFloat)
    maxIter = Param(Params._dummy(), "maxIter", "iterations", TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, C=1.0, maxIter=1000):
        super().__init__()
        self._setDefault(C=1.0, maxIter=1000)
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame):
        rows = dataset.count()
        return LogisticRegression(
            featuresCol=FEATURES,
            labelCol=LABEL,
            predictionCol=PREDICTION,
            rawPredictionCol=RAW,
            probabilityCol=PROBABILITY,
            regParam=1.0 / (self.getOrDefault(self.C) * max(rows, 1)),
            elasticNetParam=0.0,
            standardization=False,
            maxIter=self.getOrDefault(self.maxIter),
        ).fit(dataset)


@dataclass(frozen=True)
class ModelSpec:
    """A registered model: how to build it, what to try, and whether it ranks features.

    ``grid`` maps public parameter names to (Spark parameter, value, ...) choices; ``make`` gets
    the number of classes (0 for regression). ``sharing`` says what the grid points of a fold have in common:
    "products" (least squares), "boosted" (fewer rounds begin like more), "forest" (smaller ones are parts of
    larger ones) or nothing.
    """

    key: str
    display_name: str
    make: Callable[[int], Estimator]
    grid: dict[str, list[Any]]
    spark_names: dict[str, str] = field(default_factory=dict)
    ranks_features: bool = False
    sharing: str | None = None

    def combinations(self) -> list[dict[str, Any]]:
        """Every grid point, parameters in alphabetical order, the last varying fastest."""
        return grid_points(self.grid, sorted(self.grid))

    def param_map(self, estimator: Estimator, point: dict[str, Any]) -> dict[Param, Any]:
        inner = estimator.getClassifier() if isinstance(estimator, OneVsRest) else estimator
        return {
            inner.getParam(self.spark_names.get(name, name)): value
            for name, value in self.fitted_point(point).items()
        }

    def fitted_point(self, point: dict[str, Any]) -> dict[str, Any]:
        """The values that are really fitted: no depth limit becomes DEPTH_CAP."""
        return {k: DEPTH_CAP if k == "max_depth" and v is None else v for k, v in point.items()}


_COLUMNS = {"featuresCol": FEATURES, "labelCol": LABEL, "predictionCol": PREDICTION}
# Rows remember the node they have come to, so that no level walks the forest from its root, and the histograms of
# many nodes are gathered in one pass.
_GROWTH = {"cacheNodeIds": True, "maxMemoryInMB": 1024}
_FOREST = {"n_estimators": "numTrees", "max_depth": "maxDepth"}
_BOOSTED = {"n_estimators": "maxIter", "max_depth": "maxDepth"}


def _boosted_classifier(n_classes: int) -> Estimator:
    booster = GBTClassifier(stepSize=0.3, seed=SEED, **_COLUMNS)
    booster = booster.setRawPredictionCol(RAW).setProbabilityCol(PROBABILITY)
    if n_classes == 2:
        return booster
    return OneVsRest(classifier=booster, rawPredictionCol=RAW, **_COLUMNS)


# The three models per task and the parameter values each one tries.
REGISTRY: dict[str, list[ModelSpec]] = {
    REGRESSION: [
        ModelSpec(
            "linear_regression",
            "Linear Regression",
            lambda k: LinearRegression(regParam=0.0, **_COLUMNS),
            {"fit_intercept": [True, False]},
            {"fit_intercept": "fitIntercept"},
            sharing="products",
        ),
        ModelSpec(
            "random_forest_regressor",
            "Random Forest Regressor",
            lambda k: RandomForestRegressor(featureSubsetStrategy="all", seed=SEED, **_COLUMNS, **_GROWTH),
            {"n_estimators": [50, 100], "max_depth": [None, 5]},
            _FOREST,
            ranks_features=True,
            sharing="forest",
        ),
        ModelSpec(
            "gbt_regressor",
            "Gradient-Boosted Trees Regressor",
            lambda k: GBTRegressor(stepSize=0.3, seed=SEED, **_COLUMNS),
            {"n_estimators": [50, 100], "max_depth": [3, 5]},
            _BOOSTED,
            ranks_features=True,
            sharing="boosted",
        ),
    ],
    CLASSIFICATION: [
        ModelSpec(
            "logistic_regression",
            "Logistic Regression",
            lambda k: InverseStrengthLogisticRegression(maxIter=1000),
            {"C": [0.1, 1.0, 10.0]},
        ),
        ModelSpec(
            "random_forest_classifier",
            "Random Forest Classifier",
            lambda k: RandomForestClassifier(
                featureSubsetStrategy="sqrt",
                seed=SEED,
                rawPredictionCol=RAW,
                probabilityCol=PROBABILITY,
                **_COLUMNS,
                **_GROWTH,
            ),
            {"n_estimators": [50, 100], "max_depth": [None, 5]},
            _FOREST,
            ranks_features=True,
            sharing="forest",
        ),
        ModelSpec(
            "gbt_classifier",
            "Gradient-Boosted Trees Classifier",
            _boosted_classifier,
            {"n_estimators": [50, 100], "max_depth": [3, 5]},
            _BOOSTED,
            ranks_features=True,
            sharing="boosted",
        ),
    ],
}


def importances(model) -> list[float] | None:
    """Importance per slot of a fitted tree model; the mean over classes for one-vs-rest."""
    if hasattr(model, "featureImportances"):
        return model.featureImportances.toArray().tolist()
    if hasattr(model, "models"):
        per_class = [m.featureImportances.toArray() for m in model.models]
        return (sum(per_class) / len(per_class)).tolist()
    return None
