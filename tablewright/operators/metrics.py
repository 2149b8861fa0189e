"""Scores and diagnostics of predictions, as aggregates over (actual, predicted)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.functions.expressions import col, order_key, ratio
from tablewright.types import LIMITS, SEED


def regression_metrics(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """One row: mae, rmse, r2. A constant target scores 1 if predicted exactly, else 0."""
    y, p = col(actual).cast("double"), col(predicted).cast("double")
    sums = df.agg(
        F.avg(F.abs(y - p)).alias("mae"),
        F.avg((y - p) * (y - p)).alias("mse"),
        F.var_pop(y).alias("variance"),
    )
    mse, variance = F.col("mse"), F.col("variance")
    flat = F.when(mse == 0.0, 1.0).otherwise(0.0)
    return sums.select(
        "mae",
        F.sqrt(mse).alias("rmse"),
        F.when(variance == 0.0, flat).otherwise(1.0 - ratio(mse, variance)).alias("r2"),
    )


def confusion_counts(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """(actual, predicted, count) of the pairs that occur."""
    pairs = df.groupBy(col(actual).alias("actual"), col(predicted).alias("predicted"))
    return pairs.agg(F.count(F.lit(1)).alias("count"))


def classification_metrics(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """One row: accuracy and support-weighted precision, recall, f1; 0 where undefined."""
    counts = confusion_counts(df, actual, predicted)
    hit = F.when(F.col("actual") == F.col("predicted"), F.col("count")).otherwise(0)
    nothing = F.lit(0).cast("bigint")
    roles = F.array(
        F.struct(
            F.col("actual").alias("label"),
            F.col("count").alias("support"),
            nothing.alias("claimed"),
            hit.cast("bigint").alias("hits"),
        ),
        F.struct(
            F.col("predicted").alias("label"),
            nothing.alias("support"),
            F.col("count").alias("claimed"),
            nothing.alias("hits"),
        ),
    )
    per_class = (
        counts.select(F.inline(roles))
        .groupBy("label")
        .agg(*[F.sum(c).alias(c) for c in ("support", "claimed", "hits")])
    )
    precision = ratio(F.col("hits"), F.col("claimed"), 0.0)
    recall = ratio(F.col("hits"), F.col("support"), 0.0)
    f1 = ratio(2.0 * precision * recall, precision + recall, 0.0)

    def weighted(value):
        return ratio(F.sum(value * F.col("support")), F.sum("support"), 0.0)

    return per_class.agg(
        ratio(F.sum("hits"), F.sum("support"), 0.0).alias("accuracy"),
        weighted(precision).alias("precision"),
        weighted(recall).alias("recall"),
        weighted(f1).alias("f1"),
    )


def confusion_matrix(df: DataFrame, actual: str, predicted: str, labels: list) -> DataFrame:
    """(actual, predicted, count, support) for every pair of ``labels``, zeros included."""
    dtype = df.schema[actual].dataType
    every = F.array(*[F.lit(label).cast(dtype) for label in labels])
    grid = (
        df.sparkSession.range(1)
        .select(F.explode(every).alias("actual"))
        .select("actual", F.explode(every).alias("predicted"))
    )
    counts = confusion_counts(df, actual, predicted)
    filled = grid.join(counts, ["actual", "predicted"], "left").withColumn(
        "count", F.coalesce("count", F.lit(0))
    )
    support = filled.groupBy("actual").agg(F.sum("count").alias("support"))
    return filled.join(F.broadcast(support), "actual").select(
        "actual", "predicted", "count", "support"
    )


def chart_points(
    df: DataFrame,
    actual: str,
    predicted: str,
    key: list[str],
    limit: int = LIMITS.chart_points,
    seed: int = SEED,
) -> DataFrame:
    """Actual, predicted and residual of the first ``limit`` rows in the seeded order."""
    y, p = col(actual).cast("double"), col(predicted).cast("double")
    rows = df.select(
        order_key(key, seed).alias("position"),
        y.alias("actual"),
        p.alias("predicted"),
        (y - p).alias("residual"),
    )
    return rows.orderBy("position", "actual", "predicted").limit(limit).drop("position")
