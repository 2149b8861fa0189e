"""What a training run hands back: flat tables and fitted pipelines."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tablewright.types import TaskConfig

# The metric that decides, and whether less or more of it wins.
PRIMARY = {"regression": "rmse", "classification": "f1", "clustering": "silhouette"}
LESS_WINS = {"rmse"}
# A clustering can be asked for the score over squared distances instead; a run uses one of the two throughout.
STAND_INS = {"silhouette": "silhouette_sq"}

RESULT_SCHEMA = (
    "position int, key string, display_name string, status string, duration_seconds double, "
    "best_params map<string,string>, metrics map<string,double>, warning string"
)


@dataclass
class ModelOutcome:
    """One model's row of the comparison and what belongs to it."""

    key: str
    display_name: str
    status: str
    duration_seconds: float
    best_params: dict[str, str] | None = None
    metrics: dict[str, float] | None = None
    warning: str | None = None
    pipeline: PipelineModel | None = None
    importance: list[tuple[str, float]] = field(default_factory=list)
    charts: dict[str, DataFrame] = field(default_factory=dict)
    search: list[tuple[dict[str, str], float | None]] = field(default_factory=list)
    assignments: DataFrame | None = None
    references: DataFrame | None = None
    reach: float | None = None


@dataclass
class Run:
    config: TaskConfig
    train_rows: int
    test_rows: int
    outcomes: list[ModelOutcome]
    spark: SparkSession

    @property
    def primary_metric(self) -> str:
        return PRIMARY[self.config.task]

    @property
    def winner(self) -> str | None:
        best = self.comparison().where("is_best").select("key").first()
        return best["key"] if best else None

    def outcome(self, key: str) -> ModelOutcome:
        return next(o for o in self.outcomes if o.key == key)

    def results(self) -> DataFrame:
        rows = [
            (
                i,
                o.key,
                o.display_name,
                o.status,
                o.duration_seconds,
                o.best_params,
                o.metrics,
                o.warning,
            )
            for i, o in enumerate(self.outcomes)
        ]
        return self.spark.createDataFrame(rows, RESULT_SCHEMA)

    def comparison(self) -> DataFrame:
        return mark_best(self.results(), self.primary_metric)

    def importance(self) -> DataFrame:
        """(key, feature, importance), the most important first within a model."""
        rows = [(o.key, f, v) for o in self.outcomes for f, v in o.importance]
        table = self.spark.createDataFrame(rows, "key string, feature string, importance double")
        return table.orderBy("key", F.col("importance").desc(), "feature")

    def search_results(self) -> DataFrame:
        """(key, point, params, mean_score): every grid point tried, NULL score if it failed."""
        rows = [
            (o.key, i, params, score)
            for o in self.outcomes
            for i, (params, score) in enumerate(o.search)
        ]
        schema = "key string, point int, params map<string,string>, mean_score double"
        return self.spark.createDataFrame(rows, schema)


def mark_best(results: DataFrame, metric: str) -> DataFrame:
    """Add ``score`` and ``is_best``: the best successful model, the first registered on a tie."""
    names = [metric, STAND_INS[metric]] if metric in STAND_INS else [metric]
    value = F.coalesce(*[F.try_element_at("metrics", F.lit(name)) for name in names])
    score = F.when(F.col("status") == "success", value)
    signed = F.col("score") if metric in LESS_WINS else -F.col("score")
    # One row per registered model: a handful.
    order = Window.partitionBy(F.col("score").isNotNull()).orderBy(signed, "position")
    ranked = results.withColumn("score", score).withColumn("_place", F.row_number().over(order))
    return ranked.withColumn(
        "is_best", F.col("score").isNotNull() & (F.col("_place") == 1)
    ).drop("_place")
