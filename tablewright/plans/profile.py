"""The whole profile of a table as six flat tables."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.functions.expressions import bin_label, col, normalize
from tablewright.operators.profile import (
    category_frequencies,
    column_profile,
    correlation,
    dataset_dims,
    duplicate_rows,
    histograms,
    numeric_summary,
)
from tablewright.types import CATEGORICAL, LIMITS, TaskConfig, kind

TABLES = ("overview", "columns", "numeric", "distributions", "frequencies", "correlations")


@dataclass
class Profile:
    """Six tables about ``df``; each is computed when first asked for.

    The per-column table has one row per column, so it is kept and shared by the others.
    """

    df: DataFrame
    approx: bool = False

    @cached_property
    def columns(self) -> DataFrame:
        table = column_profile(self.df, self.approx)
        return self.df.sparkSession.createDataFrame(table.orderBy("ordinal").collect(), table.schema)

    @cached_property
    def overview(self) -> DataFrame:
        repeated = duplicate_rows(self.df).select("duplicate_row_count").first()
        return dataset_dims(self.df).withColumn(
            "duplicate_row_count", F.lit(repeated["duplicate_row_count"]).cast("bigint")
        )

    @cached_property
    def numeric(self) -> DataFrame:
        return numeric_summary(self.df, self.approx)

    @cached_property
    def distributions(self) -> DataFrame:
        bins = histograms(self.df)
        return bins.withColumn("label", bin_label(F.col("bin_start"), F.col("bin_end")))

    @cached_property
    def frequencies(self) -> DataFrame:
        return category_frequencies(self.df, self.columns)

    @cached_property
    def correlations(self) -> DataFrame:
        return correlation(self.df)

    def long(self) -> DataFrame:
        """Everything as (section, column, item, value)."""

        def rows(table: DataFrame, section: str, column: Column, items: dict[str, Column]) -> DataFrame:
            cells = [c for name, value in items.items() for c in (F.lit(name), value.cast("double"))]
            return table.select(
                F.lit(section).alias("section"),
                column.alias("column"),
                F.stack(F.lit(len(items)), *cells).alias("item", "value"),
            )

        def named(table: DataFrame, section: str, item: Column, value: Column, column: str) -> DataFrame:
            return table.select(
                F.lit(section).alias("section"),
                F.col(column).alias("column"),
                item.alias("item"),
                value.cast("double").alias("value"),
            )

        def fields(names: list[str]) -> dict[str, Column]:
            return {name: F.col(name) for name in names}

        dims = ["row_count", "column_count", "missing_cells", "duplicate_row_count"]
        shape = ["missing_count", "missing_percentage", "unique_count"]
        stats = ["count", "mean", "std", "min", "q25", "median", "q75", "max"]
        value = F.when(F.col("is_other"), F.lit("(rest)")).otherwise(F.col("value"))
        parts = [
            rows(self.overview, "overview", F.lit(""), fields(dims)),
            rows(self.columns, "column", F.col("column"), fields(shape)),
            rows(self.numeric, "numeric", F.col("column"), fields(stats)),
            named(self.distributions, "bin", F.col("bin").cast("string"), F.col("count"), "column"),
            named(self.frequencies, "category", value, F.col("count"), "column"),
            named(self.correlations, "correlation", F.col("column_y"), F.col("r"), "column_x"),
        ]
        return reduce(DataFrame.unionByName, parts)

    def write(self, path: str) -> None:
        """The six tables as Parquet below ``path``."""
        for name in TABLES:
            getattr(self, name).write.mode("overwrite").parquet(f"{path.rstrip('/')}/{name}")


def profile(df: DataFrame, approx: bool = False) -> Profile:
    return Profile(normalize(df), approx)


def target_distribution(cleaned: DataFrame, config: TaskConfig) -> DataFrame:
    """Classes (at most the top ones and the rest) or bins of the target over the clean rows."""
    target = cleaned.select(col(config.target))
    if config.task == "classification" or kind(target.schema[0].dataType) == CATEGORICAL:
        texts = target.select(col(config.target).cast("string").alias(config.target))
        everything = column_profile(texts).withColumn("unique_count", F.lit(1).cast("bigint"))
        table = category_frequencies(texts, everything, LIMITS.top_categories)
        return table.select(F.col("rank").alias("bin"), F.col("value").alias("label"), "count")
    bins = histograms(target)
    return bins.select("bin", bin_label(F.col("bin_start"), F.col("bin_end")).alias("label"), "count")


def feature_distributions(cleaned: DataFrame, config: TaskConfig) -> tuple[DataFrame, DataFrame]:
    """(bins of the numeric features, frequencies of the categorical ones) over the clean rows."""
    features = cleaned.select(*[col(n) for n in config.features])
    return histograms(features), category_frequencies(features)
