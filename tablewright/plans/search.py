"""Grid search over folds that fits what differs between grid points and shares the rest.

The feature stages are fitted once per fold and their output is kept for all models and points. Where a model's grid
points contain one another, a fold is fitted once for all of them: linear regression is solved from sums of products,
boosting with fewer rounds is the beginning of a longer run, smaller forests are parts of a larger one.
"""

from __future__ import annotations

import threading
from collections import defaultdict
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

import numpy as np
from pyspark import StorageLevel
from pyspark.errors import PySparkException
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.evaluation import MulticlassClassificationEvaluator, RegressionEvaluator
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.functions.storage import shared_dir
from tablewright.functions.threads import at_once
from tablewright.operators.models import LABEL, PREDICTION, ModelSpec
from tablewright.operators.prepare import FEATURES, feature_stages
from tablewright.operators.products import WIDEST, fold_products, least_squares
from tablewright.operators.staged import Part, ensemble, f1_of_parts, rmse_of_parts, staged_predictions
from tablewright.types import REGRESSION

FOLD = "fold"


@dataclass
class Side:
    """Rows with their features, and the fitted stages that made them."""

    stages: PipelineModel
    rows: DataFrame
    held_out: DataFrame | None = None


@dataclass
class FoldTables:
    """The training rows as features: once with all of them, and once per fold with and without that fold.

    Tables are made when first asked for and kept until ``release``; several searches may ask at a time.
    """

    train: DataFrame
    numeric: list[str]
    categorical: list[str]
    scaler: str
    task: str
    n_classes: int
    folds: list[int]
    #: Tasks of a pass of boosting at most, of which every round needs several; None: as many as the table has.
    round_tasks: int | None = None
    _sides: dict[int | None, Side] = field(default_factory=dict)
    _guard: threading.Lock = field(default_factory=threading.Lock)
    _making: dict[int | None, threading.Lock] = field(default_factory=lambda: defaultdict(threading.Lock))

    def _keep(self, stages: PipelineModel, rows: DataFrame) -> DataFrame:
        return stages.transform(rows).persist(StorageLevel.MEMORY_AND_DISK)

    def side(self, fold: int | None) -> Side:
        """All rows, or those outside of ``fold`` with the fold's own held out; the stages see only the former."""
        with self._guard:
            making = self._making[fold]
        with making:
            if fold not in self._sides:
                rows = self.train if fold is None else self.train.where(F.col(FOLD) != fold)
                stages = Pipeline(stages=feature_stages(self.numeric, self.categorical, self.scaler)).fit(rows)
                held = None if fold is None else self._keep(stages, self.train.where(F.col(FOLD) == fold))
                self._sides[fold] = Side(stages, self._keep(stages, rows), held)
            return self._sides[fold]

    def fitted_rows(self, spec: ModelSpec, side: Side) -> DataFrame:
        return side.rows.coalesce(self.round_tasks) if spec.sharing == "boosted" and self.round_tasks else side.rows

    def prepare(self) -> None:
        """Fit the stages of all folds, side by side."""
        missing = [f for f in self.folds if f not in self._sides]
        at_once(self.train.sparkSession, [lambda f=f: self.side(f) for f in missing], len(missing))

    def release(self) -> None:
        for side in self._sides.values():
            side.rows.unpersist()
            if side.held_out is not None:
                side.held_out.unpersist()
        self._sides.clear()


@dataclass
class Found:
    """The best point's number, the mean score of each point (None where it failed), the pipeline with that point."""

    best: int
    scores: list[float | None]
    fitted: PipelineModel


def evaluator(task: str):
    if task == REGRESSION:
        return RegressionEvaluator(labelCol=LABEL, predictionCol=PREDICTION, metricName="rmse")
    return MulticlassClassificationEvaluator(labelCol=LABEL, predictionCol=PREDICTION, metricName="f1")


def search(spec: ModelSpec, tables: FoldTables, parallelism: int = 4) -> Found:
    """Score every grid point on every fold, then fit the best one on all training rows.

    Ties go to the first point. A point that fails on any fold has no score and cannot win; if all fail, the last
    failure is raised.
    """
    points = spec.combinations()
    groups = _groups(spec, points, tables)
    jobs = [lambda g=g, f=f: g(f) for g in groups for f in g.folds]
    if any(g.by_fold for g in groups):
        tables.prepare()
    outcomes = iter(at_once(tables.train.sparkSession, jobs, parallelism))
    by_point: dict[int, list[float]] = {i: [] for i in range(len(points))}
    failure: dict[int, PySparkException] = {}
    for group in groups:
        for _ in group.folds:
            made = next(outcomes)
            for at, i in enumerate(group.points):
                if isinstance(made, PySparkException):
                    failure[i] = made
                else:
                    by_point[i] += made[at]
    scores = [None if i in failure else float(np.mean(by_point[i])) for i in by_point]
    scored = [i for i, s in enumerate(scores) if s is not None]
    if not scored:
        raise list(failure.values())[-1]
    pick = max if evaluator(tables.task).isLargerBetter() else min
    best = pick(scored, key=lambda i: scores[i])
    whole = tables.side(None)
    estimator = spec.make(tables.n_classes)
    model = estimator.fit(tables.fitted_rows(spec, whole), spec.param_map(estimator, points[best]))
    return Found(best, scores, PipelineModel(stages=[*whole.stages.stages, model]))


@dataclass
class _Group:
    """Grid points that share their fits; called with a fold it gives a list of scores per point, or the failure."""

    points: list[int]
    folds: list[int | None]
    score: Callable[[int | None], list[list[float]]]
    by_fold: bool = True

    def __call__(self, fold):
        try:
            return self.score(fold)
        except PySparkException as exc:
            return exc


def _groups(spec: ModelSpec, points: list[dict], tables: FoldTables) -> list[_Group]:
    every = list(range(len(points)))
    if spec.sharing == "products" and set(spec.grid) <= {"fit_intercept"}:
        width = tables.side(None).rows.select(FEATURES).first()[0].size
        if width <= WIDEST:
            return [_Group(every, [None], lambda _: _by_products(points, tables, width), by_fold=False)]
    if spec.sharing == "boosted":
        depths: dict[Any, list[int]] = {}
        for i, point in enumerate(points):
            depths.setdefault(tuple(v for k, v in sorted(point.items()) if k != "n_estimators"), []).append(i)
        shared = list(depths.values())
    elif spec.sharing == "forest":
        shared = [every]
    else:
        return [_Group([i], tables.folds, lambda f, i=i: _alone(spec, points[i], tables, f)) for i in every]
    return [_Group(g, tables.folds, lambda f, g=g: _in_stages(spec, [points[i] for i in g], tables, f)) for g in shared]


def _alone(spec: ModelSpec, point: dict, tables: FoldTables, fold: int) -> list[list[float]]:
    side = tables.side(fold)
    estimator = spec.make(tables.n_classes)
    model = estimator.fit(side.rows, spec.param_map(estimator, point))
    return [[float(evaluator(tables.task).evaluate(model.transform(side.held_out)))]]


def largest_point(spec: ModelSpec, points: list[dict]) -> dict:
    """The values of the ensemble that contains those of all ``points``."""
    fitted = [spec.fitted_point(p) for p in points]
    sizes = {"n_estimators", "max_depth"} if spec.sharing == "forest" else {"n_estimators"}
    return {k: max(p[k] for p in fitted) if k in sizes else v for k, v in fitted[0].items()}


def _in_stages(spec: ModelSpec, points: list[dict], tables: FoldTables, fold: int) -> list[list[float]]:
    side = tables.side(fold)
    estimator = spec.make(tables.n_classes)
    largest = largest_point(spec, points)
    # Long runs cut their lineage in the shared folder.
    shared_dir(side.rows.sparkSession)
    model = estimator.fit(tables.fitted_rows(spec, side), spec.param_map(estimator, largest))
    limited = [spec.fitted_point(p) for p in points]
    parts = [
        Part(p["n_estimators"], p["max_depth"] if p.get("max_depth") != largest.get("max_depth") else None)
        for p in limited
    ]
    whole = ensemble(side.rows.sparkSession, model, tables.n_classes)
    predicted = staged_predictions(side.held_out, whole, parts, FEATURES, LABEL)
    scores = (rmse_of_parts if tables.task == REGRESSION else f1_of_parts)(predicted, len(parts))
    return [[float(s)] for s in scores]


def _by_products(points: list[dict], tables: FoldTables, width: int) -> list[list[float]]:
    """Scores of the intercept variants on all folds: a training side is the total less the fold.

    Features are scaled by all training rows here; a fold's own scaling only moves the point that a line without
    an intercept goes through.
    """
    rows = tables.side(None).rows
    products, mean = fold_products(rows, FEATURES, LABEL, FOLD, width)
    total = sum(products.values())
    numbers = len(tables.numeric)
    least: dict[int, list[float]] = {}
    if tables.scaler == "minmax" and numbers:
        lows = [F.min(f"_num{i}").alias(f"m{i}") for i in range(numbers)]
        least = {int(r[FOLD]): list(r)[1:] for r in rows.groupBy(FOLD).agg(*lows).collect()}
    scores: list[list[float]] = [[] for _ in points]
    for fold in tables.folds:
        inside = total - products[fold]
        zero = np.zeros(width)
        if tables.scaler == "standard":
            zero[:numbers] = inside[0, 1 : numbers + 1] / inside[0, 0]
        elif least:
            zero[:numbers] = np.min([v for k, v in least.items() if k != fold], axis=0)
        for at, point in enumerate(points):
            line = least_squares(inside, point.get("fit_intercept", True), zero, mean)
            scores[at].append(float(np.sqrt(line.squared_error(products[fold]) / products[fold][0, 0])))
    return scores
