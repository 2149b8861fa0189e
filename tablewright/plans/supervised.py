"""Train, tune and compare the registered models of a regression or classification task."""

from __future__ import annotations

import math
import time
from functools import reduce

from pyspark import StorageLevel
from pyspark.errors import PySparkException
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import IndexToString, SQLTransformer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.functions.expressions import col
from tablewright.functions.threads import at_once
from tablewright.operators.clean import check_config, clean, few_rows_issue, target_issues
from tablewright.operators.metrics import (
    chart_points,
    classification_metrics,
    confusion_matrix,
    regression_metrics,
)
from tablewright.operators.models import (
    LABEL,
    PREDICTION,
    REGISTRY,
    ModelSpec,
    importances,
)
from tablewright.operators.prepare import FEATURES, check_levels, feature_names, feature_stages
from tablewright.operators.splits import folds, holdout
from tablewright.plans.results import ModelOutcome, Run
from tablewright.plans.search import FoldTables, search
from tablewright.types import (
    CLASSIFICATION,
    CLUSTERING,
    LIMITS,
    REGRESSION,
    ConfigError,
    TaskConfig,
)

OUTPUT = "prediction"


def class_labels(cleaned: DataFrame, target: str) -> list:
    """All classes, by their natural order; ``target_issues`` says before that they are few."""
    return [r["label"] for r in cleaned.select(col(target).alias("label")).distinct().orderBy("label").collect()]


def with_label(df: DataFrame, config: TaskConfig, labels: list) -> DataFrame:
    """Add the numeric label: the target itself, or the position of its class."""
    target = col(config.target)
    if config.task == REGRESSION:
        return df.withColumn(LABEL, target.cast("double"))
    index = reduce(
        lambda acc, pair: acc.when(target == F.lit(pair[1]), F.lit(float(pair[0]))),
        enumerate(labels[1:], start=1),
        F.when(target == F.lit(labels[0]), F.lit(0.0)),
    )
    return df.withColumn(LABEL, index)


def train(
    df: DataFrame,
    config: TaskConfig,
    key: list[str] | None = None,
    models: list[ModelSpec] | None = None,
    parallelism: int = 4,
) -> Run:
    """Clean, split, tune on the training part only, score once on the test part.

    ``key`` names a unique key among the selected columns to order the split by; by default the
    whole content of a row decides. ``models`` replaces the registered ones; up to ``parallelism`` of them are searched
    at a time, each with as many fits, so their durations overlap.
    """
    if config.task == CLUSTERING:
        raise ConfigError("Clustering is trained by tablewright.plans.clustering.train.")
    numeric, categorical = check_config(df, config)
    classify = config.task == CLASSIFICATION
    if not classify:
        _raise_all(target_issues(df, config))
    cleaned = clean(df, config).persist(StorageLevel.MEMORY_AND_DISK)
    split = train_rows_df = tables = None
    try:
        rows = cleaned.count()
        if rows < LIMITS.min_rows:
            raise ConfigError(few_rows_issue(rows))
        if classify:
            _raise_all(target_issues(df, config, cleaned))
        labels = class_labels(cleaned, config.target) if classify else []
        check_levels(cleaned, categorical)
        by = config.target if classify else None
        # The passes for the folds, the fits and the test rows all read this table.
        spread = split_large_partitions(cleaned, rows)
        split = with_label(holdout(spread, key, by), config, labels).persist(StorageLevel.MEMORY_AND_DISK)
        train_part = split.where(~F.col("is_test")).drop("is_test")
        test_part = split.where(F.col("is_test")).drop("is_test")
        # Folds are ranges of the same order, so they need the key columns unchanged.
        train_rows_df = merge_small_partitions(
            folds(train_part, key or config.selected, by), rows
        ).persist(StorageLevel.MEMORY_AND_DISK)
        n_train = train_rows_df.count()
        tables = FoldTables(
            train_rows_df, numeric, categorical, config.scaler, config.task, len(labels), list(range(LIMITS.folds)),
            round_tasks=fitting_tasks(rows, usual=1),
        )
        # A search is mostly passes of a few tasks, one after the other, so the models are searched side by side.
        searches = [
            lambda spec=spec: train_one(spec, config, labels, tables, test_part, key, parallelism)
            for spec in (models or REGISTRY[config.task])
        ]
        outcomes = at_once(df.sparkSession, searches, parallelism)
        return Run(config, n_train, rows - n_train, outcomes, df.sparkSession)
    finally:
        if tables is not None:
            tables.release()
        for kept in (train_rows_df, split):
            if kept is not None:
                kept.unpersist()
        cleaned.unpersist()


def split_large_partitions(df: DataFrame, rows: int, per_task: int = 50_000) -> DataFrame:
    """More partitions where a file of few row groups gave too few for the rows; otherwise unchanged."""
    wanted = math.ceil(rows / per_task)
    return df if df.rdd.getNumPartitions() >= wanted else df.repartition(wanted)


def fitting_tasks(rows: int, per_task: int = 50_000, usual: int = 3, most: int = 400_000) -> int:
    """Tasks of one pass of a fit: ``per_task`` rows each up to ``usual`` tasks, then fuller ones of at most ``most``.

    Several fits run at once, and each task of a tree sends the statistics of every node.
    """
    return max(1, min(math.ceil(rows / per_task), usual), math.ceil(rows / most))


def merge_small_partitions(df: DataFrame, rows: int) -> DataFrame:
    """Fewer, fuller partitions for iterative fits; never more than before."""
    return df.coalesce(fitting_tasks(rows))


def _raise_all(issues: list[str]) -> None:
    if issues:
        raise ConfigError(" ".join(issues))


def train_one(
    spec: ModelSpec,
    config: TaskConfig,
    labels: list,
    tables: FoldTables,
    test_part: DataFrame,
    key: list[str] | None = None,
    parallelism: int = 4,
) -> ModelOutcome:
    """Tune and score one model; what goes wrong with it stays with it."""
    started = time.perf_counter()
    try:
        points = spec.combinations()
        found = search(spec, tables, parallelism)
        best, scores, fitted = found.best, found.scores, found.fitted
        predicted = fitted.transform(test_part)
        metrics, charts = _score(predicted, config, labels, key)
        ranked = []
        if spec.ranks_features:
            names = feature_names(tables.numeric, tables.categorical, fitted)
            ranked = list(zip(names, importances(fitted.stages[-1]), strict=True))
        return ModelOutcome(
            spec.key,
            spec.display_name,
            "success",
            time.perf_counter() - started,
            {k: str(v) for k, v in spec.fitted_point(points[best]).items()},
            metrics,
            pipeline=_exportable(fitted, config, labels, tables.train.schema[config.target].dataType),
            importance=ranked,
            charts=charts,
            search=[
                ({k: str(v) for k, v in spec.fitted_point(p).items()}, s)
                for p, s in zip(points, scores, strict=True)
            ],
        )
    except (PySparkException, ValueError, RuntimeError) as exc:
        if test_part.sparkSession.sparkContext._jsc is None:
            raise
        return ModelOutcome(
            spec.key,
            spec.display_name,
            "failed",
            time.perf_counter() - started,
            warning=str(exc),
        )


def _score(predicted: DataFrame, config: TaskConfig, labels: list, key: list[str] | None):
    if config.task == REGRESSION:
        metrics = regression_metrics(predicted, LABEL, PREDICTION).first().asDict()
        points = chart_points(predicted, LABEL, PREDICTION, key or config.selected)
        # At most 500 rows: kept as a local table so that the charts outlive the cached split.
        charts = {
            "actual_vs_predicted": points.select("actual", "predicted"),
            "residuals": points.select("predicted", "residual"),
        }
    else:
        metrics = classification_metrics(predicted, LABEL, PREDICTION).first().asDict()
        matrix = confusion_matrix(predicted, LABEL, PREDICTION, [float(i) for i in range(len(labels))])
        text = F.array(*[F.lit(str(label)) for label in labels])
        charts = {
            "confusion_matrix": matrix.select(
                F.element_at(text, F.col("actual").cast("int") + 1).alias("actual"),
                F.element_at(text, F.col("predicted").cast("int") + 1).alias("predicted"),
                "count",
                "support",
            )
        }
    spark = predicted.sparkSession
    local = {n: spark.createDataFrame(c.collect(), c.schema) for n, c in charts.items()}
    return metrics, local


def _exportable(fitted: PipelineModel, config: TaskConfig, labels: list, dtype: T.DataType) -> PipelineModel:
    """The fitted pipeline with the prediction in the target's own terms, and type, as ``prediction``."""
    if config.task == REGRESSION:
        last = SQLTransformer(statement=f"SELECT *, {PREDICTION} AS {OUTPUT} FROM __THIS__")
    elif isinstance(dtype, T.StringType):
        last = IndexToString(
            inputCol=PREDICTION, outputCol=OUTPUT, labels=[str(label) for label in labels]
        )
    else:
        classes = ", ".join(f"CAST('{_written(label)}' AS {dtype.simpleString()})" for label in labels)
        place = f"CAST({PREDICTION} AS INT) + 1"
        last = SQLTransformer(statement=f"SELECT *, element_at(array({classes}), {place}) AS {OUTPUT} FROM __THIS__")
    return PipelineModel(stages=[*fitted.stages, last])


def _written(label) -> str:
    """A class in a form that its type can be cast from; numbers, dates and truth values have no quotes in it."""
    return repr(label) if isinstance(label, float) else str(label)


def fit_one(
    df: DataFrame, config: TaskConfig, key: str, params: dict | None = None
) -> PipelineModel:
    """One registered model on all clean rows, without a search; ready for ``score``."""
    numeric, categorical = check_config(df, config)
    _raise_all(target_issues(df, config))
    spec = next(s for s in REGISTRY[config.task] if s.key == key)
    cleaned = clean(df, config)
    labels = class_labels(cleaned, config.target) if config.task == CLASSIFICATION else []
    estimator = spec.make(len(labels))
    chosen = params or spec.combinations()[0]
    pipeline = Pipeline(stages=[*feature_stages(numeric, categorical, config.scaler), estimator])
    fitted = pipeline.fit(with_label(cleaned, config, labels), spec.param_map(estimator, chosen))
    return _exportable(fitted, config, labels, cleaned.schema[config.target].dataType)


def score(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """Raw rows plus ``prediction``; works on batches and on streams alike."""
    internal = {FEATURES, PREDICTION, "_raw", "_probability"}
    scored = model.transform(rows)
    drop = [
        c
        for c in scored.columns
        if c not in rows.columns
        and (c in internal or c.startswith(("_num", "_cat", "_idx", "_hot")))
    ]
    return scored.drop(*drop)
