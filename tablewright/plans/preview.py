"""What a configuration would do to the table, before anything is trained."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.functions.expressions import col
from tablewright.operators.clean import (
    check_config,
    clean,
    few_rows_issue,
    row_accounting,
    target_issues,
)
from tablewright.operators.values import is_missing, value_counts
from tablewright.types import CLASSIFICATION, LIMITS, REGRESSION, TaskConfig

SCHEMA = (
    "task string, target string, features array<string>, original_rows bigint, "
    "removed_missing_rows bigint, removed_duplicate_rows bigint, final_rows bigint, "
    "feature_count bigint, final_feature_columns array<string>, ready_to_train boolean, "
    "warnings array<string>"
)


def final_features(df: DataFrame, config: TaskConfig) -> DataFrame:
    """(position, level, name) of every column the feature pipeline would make.

    Numeric features in their order, then the levels each categorical one has in clean rows.
    """
    numeric, categorical = check_config(df, config)
    spark = df.sparkSession
    rows = clean(df, TaskConfig(config.task, config.target, config.features, False, config.scaler))
    order = {name: len(numeric) + i for i, name in enumerate(categorical)}
    plain = spark.createDataFrame(
        [(i, None, name) for i, name in enumerate(numeric)], "position int, level string, name string"
    )
    if not categorical:
        return plain
    texts = rows.select(*[col(n).cast("string").alias(n) for n in categorical])
    levels = value_counts(texts).where(~is_missing())
    names = spark.createDataFrame(
        [(texts.columns.index(n), order[n], n) for n in categorical],
        "ordinal int, position int, feature string",
    )
    hot = levels.join(F.broadcast(names), "ordinal").select(
        "position",
        F.col("as_text").alias("level"),
        F.concat("feature", F.lit("_"), F.col("as_text")).alias("name"),
    )
    return plain.unionByName(hot)


def prep_preview(df: DataFrame, config: TaskConfig) -> DataFrame:
    """One row: row accounting, final feature columns, readiness and warnings."""
    check_config(df, config)
    counts = row_accounting(df, config).first()
    original, final = counts["original_rows"], counts["final_rows"]
    lost = original - final
    supervised = config.task == REGRESSION or (config.task == CLASSIFICATION and final > 0)
    issues = target_issues(df, config) if supervised else []
    # Messages, and whether each of them stands in the way of training.
    notes = [
        (
            lost > LIMITS.row_loss_ratio * original,
            f"Cleaning removes {lost} of {original} rows ({lost / max(original, 1):.0%}).",
            False,
        ),
        (final < LIMITS.min_rows, few_rows_issue(final), True),
        *((True, issue, True) for issue in issues),
    ]
    warnings = [message for holds, message, _ in notes if holds]
    ready = not any(holds and stops for holds, _, stops in notes)
    listed = final_features(df, config) if final else None
    row = (
        config.task,
        config.target,
        list(config.features),
        original,
        counts["removed_missing_rows"],
        counts["removed_duplicate_rows"],
        final,
        0,
        [],
        ready,
        warnings,
    )
    known = df.sparkSession.createDataFrame([row], SCHEMA)
    if listed is None:
        return known
    # The names meet in the one row by an aggregate; the driver sees none of them.
    ordered = F.sort_array(F.collect_list(F.struct("position", "level", "name")))
    names = listed.agg(F.transform(ordered, lambda f: f["name"]).alias("names"))
    return known.join(names, F.lit(True)).select(
        *known.columns[:7],
        F.size("names").cast("bigint").alias("feature_count"),
        F.col("names").alias("final_feature_columns"),
        "ready_to_train",
        "warnings",
    )
