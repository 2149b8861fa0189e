"""Finished runs on shared storage: pipelines, comparison, charts, assignments, profile."""

from __future__ import annotations

import json
import re
import uuid

from pyspark.errors import PySparkException
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.functions.expressions import all_present, col, order_key
from tablewright.functions.storage import cut_lineage
from tablewright.operators.nearest import nearest_reference, nearest_within
from tablewright.operators.points import points_of
from tablewright.plans.profile import TABLES, Profile
from tablewright.plans.results import Run
from tablewright.plans.supervised import score
from tablewright.types import CLUSTERING, ExperimentError

# The shape of experiment ids and model keys.
ID_PATTERN = r"^[a-f0-9]{32}$"
KEY_PATTERN = r"^[a-z][a-z0-9_]*$"

NOTES = {
    "supervised": (
        "The saved pipeline prepares and predicts: give it raw rows with the training features."
    ),
    "clustering": (
        "K-Means labels new rows. Agglomerative clustering and DBSCAN only label the rows they "
        "were fitted on; those labels are in the assignments table. On request, other rows get the "
        "label of the nearest micro-cluster, or of the nearest core point within reach."
    ),
}
# Clusterings whose pipeline cannot label rows it has not seen.
FITTED_ROWS_ONLY = {"agglomerative_clustering", "dbscan"}


def save_experiment(run: Run, base: str, dataset: str, profile: Profile | None = None) -> str:
    """Write a run that has a winner below ``base``; returns its new id.

    Tables are appended and shared by all experiments; models and the profile get a folder each.
    """
    if run.winner is None:
        raise ExperimentError("No model trained successfully, so there is nothing to save.")
    base = base.rstrip("/")
    experiment_id = uuid.uuid4().hex
    for outcome in run.outcomes:
        if outcome.status == "success" and outcome.pipeline is not None:
            outcome.pipeline.write().save(f"{base}/models/{experiment_id}/{outcome.key}")
        for chart, table in outcome.charts.items():
            _append(table, f"{base}/charts/{chart}", experiment_id, outcome.key)
        if outcome.assignments is not None:
            _append(outcome.assignments, f"{base}/assignments", experiment_id, outcome.key)
        if outcome.references is not None:
            marked = outcome.references.withColumn("reach", F.lit(outcome.reach).cast("double"))
            _append(marked, f"{base}/references", experiment_id, outcome.key)
    records = experiment_records(run, experiment_id, dataset)
    ranked = run.importance().withColumnRenamed("key", "model_key")
    ranked.withColumn("experiment_id", F.lit(experiment_id)).write.mode("append").parquet(
        f"{base}/importances"
    )
    metrics = records.select(
        "experiment_id", "model_key", F.explode("metrics").alias("metric", "value")
    )
    metrics.write.mode("append").parquet(f"{base}/metrics")
    if profile is not None:
        profile.write(f"{base}/profiles/{experiment_id}")
    # Last, so that an experiment is only found once it is complete.
    records.write.mode("append").parquet(f"{base}/experiments")
    return experiment_id


def _append(table: DataFrame, path: str, experiment_id: str, key: str) -> None:
    tagged = table.withColumn("experiment_id", F.lit(experiment_id)).withColumn(
        "model_key", F.lit(key)
    )
    tagged.write.mode("append").partitionBy("experiment_id", "model_key").parquet(path)


def experiment_records(run: Run, experiment_id: str, dataset: str) -> DataFrame:
    """One row per model with everything known about the run it belongs to."""
    config = run.config
    note = NOTES["clustering" if config.task == CLUSTERING else "supervised"]
    return run.comparison().select(
        F.lit(experiment_id).alias("experiment_id"),
        F.lit(dataset).alias("dataset"),
        F.lit(config.task).alias("task"),
        F.lit(config.target).cast("string").alias("target"),
        F.array(*[F.lit(n) for n in config.features]).alias("features"),
        F.lit(config.scaler).alias("scaler"),
        F.lit(config.drop_duplicates).alias("drop_duplicates"),
        F.lit(run.train_rows).cast("bigint").alias("train_rows"),
        F.lit(run.test_rows).cast("bigint").alias("test_rows"),
        F.lit(run.primary_metric).alias("primary_metric"),
        F.lit(run.winner).cast("string").alias("winner_key"),
        F.current_timestamp().alias("created_at"),
        F.lit(note).alias("prediction_note"),
        F.col("key").alias("model_key"),
        "display_name",
        "status",
        "duration_seconds",
        "best_params",
        "metrics",
        "warning",
        "is_best",
    )


def find_experiment(spark: SparkSession, base: str, experiment_id: str) -> DataFrame:
    """The records of one experiment; an unknown or malformed id is an error."""
    if re.match(ID_PATTERN, experiment_id):
        try:
            table = spark.read.parquet(f"{base.rstrip('/')}/experiments")
        except PySparkException as missing:
            # Anything but a folder that does not exist is an error of its own.
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            table = None
        if table is not None:
            found = table.where(F.col("experiment_id") == experiment_id)
            if not found.isEmpty():
                return found
    raise ExperimentError(f"There is no experiment '{experiment_id}'.")


def load_model(spark: SparkSession, base: str, experiment_id: str, key: str) -> PipelineModel:
    records = find_experiment(spark, base, experiment_id)
    succeeded = (F.col("model_key") == key) & (F.col("status") == "success")
    if not re.match(KEY_PATTERN, key) or records.where(succeeded).isEmpty():
        raise ExperimentError(f"Experiment '{experiment_id}' has no successful model '{key}'.")
    return PipelineModel.load(f"{base.rstrip('/')}/models/{experiment_id}/{key}")


def score_rows(
    spark: SparkSession, base: str, experiment_id: str, key: str, rows: DataFrame
) -> DataFrame:
    """Raw rows, batch or stream, plus the saved model's ``prediction``."""
    if key in FITTED_ROWS_ONLY:
        raise ExperimentError(
            f"'{key}' labels only the rows it was fitted on; read them from the assignments."
        )
    return score(load_model(spark, base, experiment_id, key), rows)


def assignments(spark: SparkSession, base: str, experiment_id: str, key: str) -> DataFrame:
    """(id, w, label) of the rows a clustering was fitted on."""
    find_experiment(spark, base, experiment_id)
    table = spark.read.parquet(f"{base.rstrip('/')}/assignments")
    mine = (F.col("experiment_id") == experiment_id) & (F.col("model_key") == key)
    return table.where(mine).select("id", "w", "label")


def label_rows(
    spark: SparkSession, base: str, experiment_id: str, key: str, rows: DataFrame, columns: list[str]
) -> DataFrame:
    """``columns`` of every row, and ``label``: the cluster that the saved clustering gives it.

    Rows with the features of a fitted row have that row's label. Others are labelled by the model (K-Means), by the
    nearest micro-cluster (agglomerative clustering), or by the nearest core point within eps, else as noise
    (DBSCAN). Rows with a missing feature have no label.
    """
    record = find_experiment(spark, base, experiment_id).where(F.col("model_key") == key).first()
    if record is None or record["status"] != "success" or record["task"] != CLUSTERING:
        raise ExperimentError(f"Experiment '{experiment_id}' has no successful clustering '{key}'.")
    features = list(record["features"])
    # Equal rows are labelled once.
    distinct = points_of(rows.where(all_present(features)), features, load_model(spark, base, experiment_id, key))
    distinct = cut_lineage(distinct.select("id", "x", *(["prediction"] if key == "kmeans" else [])))
    if key == "kmeans":
        found = distinct.select("id", F.col("prediction").cast("bigint").alias("label"))
    else:
        own = assignments(spark, base, experiment_id, key).select("id", "label")
        fitted = distinct.join(own, "id").select("id", "label")
        strange = distinct.join(own, "id", "left_anti")
        place = f"{base.rstrip('/')}/references/experiment_id={experiment_id}/model_key={key}"
        references = spark.read.parquet(place)
        reach = references.select(F.max("reach")).first()[0]
        near = nearest_reference(strange, references) if reach is None else nearest_within(strange, references, reach)
        found = fitted.unionByName(near)
    labels = found.select(F.col("id").alias("_id"), "label")
    # The digest of a row with a missing feature would be that of another row.
    place = F.when(all_present(features), order_key(features))
    keyed = rows.select(*[col(c).alias(f"k{i}") for i, c in enumerate(columns)], place.alias("_id"))
    return keyed.join(labels, "_id", "left").drop("_id").toDF(*columns, "label")


def read_chart(spark: SparkSession, base: str, experiment_id: str, key: str, chart: str) -> DataFrame:
    """The points of one saved chart of one model."""
    find_experiment(spark, base, experiment_id)
    if re.match(KEY_PATTERN, key) and re.match(KEY_PATTERN, chart):
        try:
            return spark.read.parquet(
                f"{base.rstrip('/')}/charts/{chart}/experiment_id={experiment_id}/model_key={key}"
            )
        except PySparkException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
    raise ExperimentError(f"Experiment '{experiment_id}' has no chart '{chart}' of a model '{key}'.")


def read_importances(spark: SparkSession, base: str, experiment_id: str) -> DataFrame:
    """(model_key, feature, importance), the most important first within a model."""
    find_experiment(spark, base, experiment_id)
    table = spark.read.parquet(f"{base.rstrip('/')}/importances")
    mine = table.where(F.col("experiment_id") == experiment_id).drop("experiment_id")
    return mine.orderBy("model_key", F.col("importance").desc(), "feature")


def read_metrics(spark: SparkSession, base: str, experiment_id: str) -> DataFrame:
    """(model_key, metric, value) of the models that succeeded."""
    find_experiment(spark, base, experiment_id)
    table = spark.read.parquet(f"{base.rstrip('/')}/metrics")
    return table.where(F.col("experiment_id") == experiment_id).drop("experiment_id")


def read_profile(spark: SparkSession, base: str, experiment_id: str, section: str) -> DataFrame:
    """One table of the profile that was saved with an experiment."""
    find_experiment(spark, base, experiment_id)
    if section not in TABLES:
        raise ExperimentError(f"A profile has no table '{section}'; it has {', '.join(TABLES)}.")
    try:
        return spark.read.parquet(f"{base.rstrip('/')}/profiles/{experiment_id}/{section}")
    except PySparkException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
    raise ExperimentError(f"Experiment '{experiment_id}' was saved without a profile.")


def as_json(records: DataFrame) -> list[dict]:
    """Records of one experiment (a row per model) as plain dictionaries."""
    return [json.loads(r["j"]) for r in records.select(F.to_json(F.struct("*")).alias("j")).collect()]
