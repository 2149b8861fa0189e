"""The one feature pipeline: scale numbers, one-hot encode categories, assemble a vector.

Fitting yields only stages that Spark itself can save and load.
"""

from __future__ import annotations

from pyspark import keyword_only
from pyspark.ml import Estimator, Pipeline, PipelineModel
from pyspark.ml.feature import OneHotEncoder, SQLTransformer, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.functions.expressions import col
from tablewright.types import ConfigError, split_kinds

# Beside the caller's own columns, under a name that those do not have.
FEATURES = "__features__"
# More levels than this in one column would not fit the label lists on the driver.
MAX_LEVELS = 1_000_000


def scale_statistics(df: DataFrame, names: list[str], scaler: str) -> list[tuple[float, float]]:
    """(offset, divisor) per column, from one aggregate. A constant column is divided by 1."""
    if scaler == "none" or not names:
        return [(0.0, 1.0)] * len(names)
    aggs = []
    for i, name in enumerate(names):
        value = col(name).cast("double")
        if scaler == "standard":
            aggs += [F.avg(value).alias(f"o{i}"), F.stddev_pop(value).alias(f"d{i}")]
        else:
            low, high = F.min(value), F.max(value)
            aggs += [low.alias(f"o{i}"), (high - low).alias(f"d{i}")]
    row = df.agg(*aggs).first()
    return [(row[f"o{i}"] or 0.0, row[f"d{i}"] or 1.0) for i in range(len(names))]


def scaled(df: DataFrame, names: list[str], scaler: str) -> DataFrame:
    """The table with the named columns scaled in place."""
    statistics = dict(zip(names, scale_statistics(df, names, scaler), strict=True))

    def value(name: str) -> Column:
        if name not in statistics:
            return col(name)
        offset, divisor = statistics[name]
        return ((col(name).cast("double") - offset) / divisor).alias(name)

    return df.select(*[value(n) for n in df.columns])


class ColumnPreparer(Estimator, DefaultParamsReadable, DefaultParamsWritable):
    """Fits scaling constants; the model is a plain SQL projection.

    Adds ``_num<i>`` (scaled doubles) and ``_cat<i>`` (categories as text).
    """

    numericCols = Param(Params._dummy(), "numericCols", "", TypeConverters.toListString)
    categoricalCols = Param(Params._dummy(), "categoricalCols", "", TypeConverters.toListString)
    scaler = Param(Params._dummy(), "scaler", "none, standard or minmax", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, numericCols=None, categoricalCols=None, scaler="standard"):
        super().__init__()
        self._setDefault(numericCols=[], categoricalCols=[], scaler="standard")
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _fit(self, dataset: DataFrame) -> SQLTransformer:
        numeric = self.getOrDefault(self.numericCols)
        statistics = scale_statistics(dataset, numeric, self.getOrDefault(self.scaler))
        parts = ["*"]
        for i, (name, (offset, divisor)) in enumerate(zip(numeric, statistics, strict=True)):
            parts.append(
                f"(CAST({_quoted(name)} AS DOUBLE) - {_double(offset)}) / {_double(divisor)} AS _num{i}"
            )
        for i, name in enumerate(self.getOrDefault(self.categoricalCols)):
            parts.append(f"CAST({_quoted(name)} AS STRING) AS _cat{i}")
        return SQLTransformer(statement=f"SELECT {', '.join(parts)} FROM __THIS__")


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _double(value: float) -> str:
    return f"CAST('{float(value)!r}' AS DOUBLE)"


def feature_stages(numeric: list[str], categorical: list[str], scaler: str) -> list:
    """Stages of the feature pipeline: numbers first, then one slot per category level.

    The indexer keeps a slot for unknown categories and the encoder drops exactly that one, so
    every known level has a slot and an unseen one encodes to zeros.
    """
    stages: list = [
        ColumnPreparer(numericCols=numeric, categoricalCols=categorical, scaler=scaler)
    ]
    inputs = [f"_num{i}" for i in range(len(numeric))]
    if categorical:
        texts = [f"_cat{i}" for i in range(len(categorical))]
        indexes = [f"_idx{i}" for i in range(len(categorical))]
        hots = [f"_hot{i}" for i in range(len(categorical))]
        stages += [
            StringIndexer(
                inputCols=texts,
                outputCols=indexes,
                stringOrderType="alphabetAsc",
                handleInvalid="keep",
            ),
            OneHotEncoder(inputCols=indexes, outputCols=hots, dropLast=True),
        ]
        inputs += hots
    stages.append(VectorAssembler(inputCols=inputs, outputCol=FEATURES))
    return stages


def check_levels(df: DataFrame, categorical: list[str], limit: int = MAX_LEVELS) -> None:
    """Refuse to one-hot encode a column whose levels would not fit the driver."""
    if not categorical:
        return
    row = df.agg(
        *[F.approx_count_distinct(col(n)).alias(f"u{i}") for i, n in enumerate(categorical)]
    ).first()
    large = [n for i, n in enumerate(categorical) if row[f"u{i}"] > limit]
    if large:
        raise ConfigError(f"Too many levels to one-hot encode (over {limit}): {', '.join(large)}.")


def fit_features(df: DataFrame, features: list[str], scaler: str) -> PipelineModel:
    numeric, categorical = split_kinds(df, features)
    check_levels(df, categorical)
    return Pipeline(stages=feature_stages(numeric, categorical, scaler)).fit(df)


def feature_names(numeric: list[str], categorical: list[str], fitted: PipelineModel) -> list[str]:
    """``age``, ``region_East``, ... in the order of the vector's slots."""
    names = list(numeric)
    indexers = [s for s in fitted.stages if type(s).__name__ == "StringIndexerModel"]
    if categorical and indexers:
        for name, labels in zip(categorical, indexers[0].labelsArray, strict=True):
            names += [f"{name}_{label}" for label in labels]
    return names


def wide_features(df: DataFrame, keys: list[str], features: list[str], scaler: str) -> DataFrame:
    """Keys plus one double column per slot of the fitted feature vector, readably named."""
    numeric, categorical = split_kinds(df, features)
    fitted = fit_features(df, features, scaler)
    names = feature_names(numeric, categorical, fitted)
    slots = fitted.transform(df).select(
        *[col(k) for k in keys], vector_to_array(FEATURES).alias("_slots")
    )
    return slots.select(
        *[col(k) for k in keys], *[F.col("_slots")[i].alias(n) for i, n in enumerate(names)]
    )
