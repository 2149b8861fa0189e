"""Column kinds, task configuration, default thresholds and errors."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import types as T

NUMERIC = "numeric"
CATEGORICAL = "categorical"

REGRESSION = "regression"
CLASSIFICATION = "classification"
CLUSTERING = "clustering"
TASKS = (REGRESSION, CLASSIFICATION, CLUSTERING)
SCALERS = ("none", "standard", "minmax")

SEED = 42


class TablewrightError(Exception):
    """Base of every error this package raises on purpose."""


class ConfigError(TablewrightError):
    """The task configuration does not fit the table."""


class IngestError(TablewrightError):
    """The input file cannot be used as a table."""


class ExperimentError(TablewrightError):
    """An experiment, or a model inside it, is unknown or unusable."""


@dataclass(frozen=True)
class Limits:
    """Thresholds of the profile and of the configuration checks."""

    histogram_bins: int = 10
    discrete_max: int = 12
    top_categories: int = 20
    identifier_ratio: float = 0.5
    preview_rows: int = 50
    chart_points: int = 500
    min_rows: int = 30
    row_loss_ratio: float = 0.3
    max_classes: int = 20
    min_class_rows: int = 6
    classes_named: int = 10
    test_fraction: float = 0.2
    folds: int = 3


LIMITS = Limits()


@dataclass(frozen=True)
class TaskConfig:
    """What to predict (or cluster), from which columns, prepared how."""

    task: str
    target: str | None
    features: list[str] = field(default_factory=list)
    drop_duplicates: bool = True
    scaler: str = "standard"

    @property
    def selected(self) -> list[str]:
        return [*self.features, self.target] if self.target else list(self.features)


def kind(dtype: T.DataType) -> str:
    """Logical kind of a Spark type; nested and binary types are refused."""
    if isinstance(dtype, T.NumericType):
        return NUMERIC
    if isinstance(
        dtype,
        (T.StringType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType, T.NullType),
    ):
        return CATEGORICAL
    raise ConfigError(f"Columns of type {dtype.simpleString()} cannot be profiled or modelled.")


def split_kinds(df: DataFrame, columns: list[str] | None = None) -> tuple[list[str], list[str]]:
    """(numeric, categorical) column names, each in the order given."""
    names = list(df.columns) if columns is None else list(columns)
    kinds = {name: kind(df.schema[name].dataType) for name in names}
    return (
        [n for n in names if kinds[n] == NUMERIC],
        [n for n in names if kinds[n] == CATEGORICAL],
    )


def numeric_columns(df: DataFrame) -> list[str]:
    return split_kinds(df)[0]


def categorical_columns(df: DataFrame) -> list[str]:
    return split_kinds(df)[1]


def grid_points(grid: dict[str, list], names: list[str]) -> list[dict]:
    """Every choice of one value per parameter; of ``names``, the last varies fastest.

    A choice's number, written with one digit per parameter, says which values it takes.
    """
    total = math.prod(len(grid[n]) for n in names)
    points = []
    for number in range(total):
        digits = {}
        for name in reversed(names):
            number, digit = divmod(number, len(grid[name]))
            digits[name] = grid[name][digit]
        points.append({name: digits[name] for name in names})
    return points
