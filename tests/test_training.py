import threading
from dataclasses import replace

import numpy as np
import pytest
from pyspark import keyword_only
from pyspark.ml import Estimator, PipelineModel
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import functions as F

from tablewright.operators.models import LABEL, PREDICTION, REGISTRY, InverseStrengthLogisticRegression, ModelSpec
from tablewright.operators.prepare import FEATURES
from tablewright.plans.supervised import fit_one, fitting_tasks, score, train
from tablewright.types import ConfigError, TaskConfig

SEEN = []
COLUMNS = {"featuresCol": FEATURES, "labelCol": LABEL, "predictionCol": PREDICTION}


class Spy(Estimator):
    """Linear regression that notes which rows it was fitted on; can refuse a penalty."""

    penalty = Param(Params._dummy(), "penalty", "", TypeConverters.toFloat)

    @keyword_only
    def __init__(self, *, penalty=0.0):
        super().__init__()
        self._setDefault(penalty=0.0)

    def _fit(self, dataset):
        if self.getOrDefault(self.penalty) < 0:
            return LinearRegression(regParam=-1.0, **COLUMNS).fit(dataset)
        SEEN.append({r["x1"] for r in dataset.select("x1").collect()})
        return LinearRegression(**COLUMNS).fit(dataset)


def spec(*penalties):
    return ModelSpec("spy", "Spy", lambda k: Spy(), {"penalty": list(penalties)})


def only(task, *keys, **grid):
    return [replace(s, grid=grid or s.grid) for s in REGISTRY[task] if s.key in keys]


@pytest.fixture(scope="module")
def houses(spark):
    rng = np.random.default_rng(3)
    rows = [
        (float(a), int(b), "xyz"[i % 3], float(3 * a + 10 * b + 50 * (i % 3) + rng.normal(0, 1)))
        for i, (a, b) in enumerate(zip(rng.uniform(20, 200, 150), rng.integers(1, 6, 150), strict=True))
    ]
    return spark.createDataFrame(rows, "area double, rooms bigint, zone string, price double")


def test_search_never_sees_the_test_rows(spark):
    SEEN.clear()
    rows = [(float(i), float(i % 7), 2.0 * i) for i in range(40)]
    df = spark.createDataFrame(rows, "x1 double, x2 double, y double")
    run = train(df, TaskConfig("regression", "y", ["x1", "x2"]), models=[spec(0.0, 1.0)])
    assert (run.train_rows, run.test_rows) == (32, 8)
    assert len(set.union(*SEEN)) == 32
    assert sorted(len(s) for s in SEEN)[-1] == 32
    assert all(len(s) in (21, 22, 32) for s in SEEN)


def test_one_bad_point_and_one_bad_model_stay_alone(spark):
    rows = [(float(i), float(i % 7), 2.0 * i) for i in range(40)]
    df = spark.createDataFrame(rows, "x1 double, x2 double, y double")
    good, bad = spec(-1.0, 0.0), replace(spec(-1.0), key="bad")
    run = train(df, TaskConfig("regression", "y", ["x1", "x2"]), models=[bad, good])
    assert [o.status for o in run.outcomes] == ["failed", "success"]
    assert run.outcome("bad").warning and run.outcome("bad").pipeline is None
    assert [s is None for _, s in run.outcome("spy").search] == [True, False]
    assert run.winner == "spy"


def test_linear_regression_run(houses):
    config = TaskConfig("regression", "price", ["area", "rooms", "zone"])
    run = train(houses, config, models=only("regression", "linear_regression"))
    metrics = run.outcome("linear_regression").metrics
    assert metrics["r2"] > 0.99 and metrics["rmse"] >= metrics["mae"]
    assert run.outcome("linear_regression").charts["residuals"].count() == run.test_rows == 30
    assert run.search_results().count() == 2


def test_trees_rank_features(houses):
    config = TaskConfig("regression", "price", ["area", "rooms", "zone"])
    models = only("regression", "random_forest_regressor", n_estimators=[5], max_depth=[None])
    run = train(houses, config, models=models)
    ranked = run.importance().collect()
    assert ranked[0]["feature"] == "area"
    assert {r["feature"] for r in ranked} == {"area", "rooms", "zone_x", "zone_y", "zone_z"}
    assert sum(r["importance"] for r in ranked) == pytest.approx(1.0)


def test_no_depth_limit_is_the_most_spark_allows(spark):
    df = spark.createDataFrame([(float(i), 2.0**i) for i in range(40)], "x double, y double")
    config = TaskConfig("regression", "y", ["x"])
    models = only("regression", "random_forest_regressor", n_estimators=[3], max_depth=[None])
    run = train(df, config, models=models)
    outcome = run.outcome("random_forest_regressor")
    assert outcome.best_params == {"max_depth": "30", "n_estimators": "3"}
    assert outcome.search[0][0] == outcome.best_params
    forest = outcome.pipeline.stages[-2]
    assert forest.getMaxDepth() == 30 and max(t.depth for t in forest.trees) > 10


def test_three_string_classes_with_boosting(spark):
    rows = [(float(i % 3) + 0.01 * (i // 3), i % 5, ["low", "mid", "top"][i % 3]) for i in range(90)]
    df = spark.createDataFrame(rows, "x double, z bigint, y string")
    config = TaskConfig("classification", "y", ["x", "z"])
    models = only("classification", "gbt_classifier", n_estimators=[3], max_depth=[3])
    models += only("classification", "logistic_regression")
    run = train(df, config, models=models)
    for outcome in run.outcomes:
        assert outcome.status == "success" and outcome.metrics["f1"] > 0.8
        matrix = outcome.charts["confusion_matrix"].collect()
        assert len(matrix) == 9 and sum(r["count"] for r in matrix) == run.test_rows
    scored = score(run.outcome("gbt_classifier").pipeline, df)
    assert scored.columns == ["x", "z", "y", "prediction"]
    assert scored.where("prediction = y").count() > 80


def test_integer_classes_sort_as_numbers(spark):
    df = spark.createDataFrame([(float(i % 2), [2, 10][i % 2]) for i in range(80)], "x double, y bigint")
    config = TaskConfig("classification", "y", ["x"], drop_duplicates=False)
    model = fit_one(df, config, "logistic_regression")
    scored = score(model, df)
    assert scored.schema["prediction"].dataType == scored.schema["y"].dataType
    assert scored.where("prediction = y").count() == 80


@pytest.mark.parametrize("kind", ["string", "boolean", "date", "decimal(5,2)", "float", "timestamp", "tinyint"])
def test_predictions_have_the_type_of_the_target(spark, kind):
    words = {"boolean": ["false", "true"], "date": ["2020-01-31", "2021-02-28"], "string": ["it's", "__THIS__"]}
    words["timestamp"] = ["2020-01-31 01:02:03.5", "2021-02-28 00:00:00"]
    low, high = words.get(kind, ["1", "2"])
    df = spark.createDataFrame([(float(i % 2), [low, high][i % 2]) for i in range(80)], "x double, y string")
    df = df.withColumn("y", F.col("y").cast(kind))
    config = TaskConfig("classification", "y", ["x"], drop_duplicates=False)
    numbers = kind in ("decimal(5,2)", "float", "tinyint")
    scored = score(fit_one(df, config, "logistic_regression"), df)
    assert scored.schema["prediction"].dataType == df.schema["y"].dataType or not numbers
    assert scored.where("prediction = y").count() == 80


def test_inverse_strength_depends_on_rows(spark):
    df = spark.createDataFrame([(float(i), float(i > 20)) for i in range(40)], "x double, y double")
    config = TaskConfig("classification", "y", ["x"])
    model = fit_one(df, config, "logistic_regression", {"C": 0.5}).stages[-2]
    assert model.getRegParam() == pytest.approx(1 / (0.5 * 40))
    assert InverseStrengthLogisticRegression(C=2.0).copy().getOrDefault("C") == 2.0


def test_rejected_configurations(spark):
    few = spark.createDataFrame([(i, i) for i in range(10)], "a bigint, t bigint")
    with pytest.raises(ConfigError, match="at least 30"):
        train(few, TaskConfig("regression", "t", ["a"]))
    words = spark.createDataFrame([(i, "rb"[i % 2]) for i in range(40)], "a bigint, y string")
    with pytest.raises(ConfigError, match="numeric"):
        train(words, TaskConfig("regression", "y", ["a"]))
    rare = spark.createDataFrame([(i, int(i >= 35)) for i in range(38)], "a bigint, y bigint")
    with pytest.raises(ConfigError, match="Too few"):
        train(rare, TaskConfig("classification", "y", ["a"]))


def test_grids_expand_in_sorted_order():
    forest = REGISTRY["regression"][1].combinations()
    assert forest == [
        {"max_depth": None, "n_estimators": 50}, {"max_depth": None, "n_estimators": 100},
        {"max_depth": 5, "n_estimators": 50}, {"max_depth": 5, "n_estimators": 100},
    ]
    assert {t: [s.key for s in specs] for t, specs in REGISTRY.items()} == {
        "regression": ["linear_regression", "random_forest_regressor", "gbt_regressor"],
        "classification": ["logistic_regression", "random_forest_classifier", "gbt_classifier"],
    }


def test_saved_pipeline_predicts_the_same(houses, tmp_path):
    config = TaskConfig("regression", "price", ["area", "zone"])
    model = fit_one(houses, config, "linear_regression")
    model.write().save(f"{tmp_path}/m")
    again = PipelineModel.load(f"{tmp_path}/m")
    a, b = (score(m, houses).select("area", F.round("prediction", 6)) for m in (model, again))
    assert a.exceptAll(b).count() == 0


def test_a_large_table_of_one_partition_is_fitted_in_several_tasks(spark, monkeypatch):
    """120,000 rows from a file with one row group: the split, the folds and the fits do not stay in one task."""
    df = spark.range(0, 120_000, 1, 1).select(F.col("id").cast("double").alias("x"), (F.col("id") % 7).cast("double").alias("y"))
    tasks = []
    fit = LinearRegression._fit
    monkeypatch.setattr(LinearRegression, "_fit", lambda self, rows: tasks.append(rows.rdd.getNumPartitions()) or fit(self, rows))
    config = TaskConfig("regression", "y", ["x"], drop_duplicates=False)
    run = train(df, config, key=["x"], models=only("regression", "linear_regression"))
    assert (run.train_rows, run.test_rows, tasks) == (96_000, 24_000, [3])


def test_tasks_of_a_fit_grow_with_its_rows():
    assert [fitting_tasks(n) for n in (0, 50_000, 50_001, 120_000, 1_200_000, 7_200_000)] == [1, 1, 2, 3, 3, 18]
    assert [fitting_tasks(n, usual=1) for n in (0, 120_000, 480_000, 7_200_000)] == [1, 1, 2, 18]


def test_boosting_has_fewer_tasks_than_other_fits(spark, monkeypatch):
    df = spark.range(0, 120_000, 1, 1).select(F.col("id").cast("double").alias("x"), (F.col("id") % 7).cast("double").alias("y"))
    tasks = []
    fit = GBTRegressor._fit
    monkeypatch.setattr(GBTRegressor, "_fit", lambda self, rows: tasks.append(rows.rdd.getNumPartitions()) or fit(self, rows))
    boosted = only("regression", "gbt_regressor", n_estimators=[1], max_depth=[2])
    run = train(df, TaskConfig("regression", "y", ["x"], drop_duplicates=False), key=["x"], models=boosted)
    assert run.outcomes[0].status == "success" and tasks == [1, 1, 1, 1]


class Waiting(Estimator):
    """Linear regression whose fit begins once another model's has begun, too."""

    def __init__(self, mine: threading.Event, other: threading.Event):
        super().__init__()
        self.mine, self.other = mine, other

    def _fit(self, dataset):
        self.mine.set()
        if not self.other.wait(60):
            raise RuntimeError("The other model waits for this one.")
        return LinearRegression(**COLUMNS).fit(dataset)


def test_models_are_searched_side_by_side(spark):
    a, b = threading.Event(), threading.Event()
    models = [
        ModelSpec("one", "One", lambda k: Waiting(a, b), {}),
        ModelSpec("two", "Two", lambda k: Waiting(b, a), {}),
    ]
    config = TaskConfig("regression", "price", ["area"], drop_duplicates=False)
    rows = spark.range(60).select(F.col("id").cast("double").alias("area"), (F.col("id") * 2.0).alias("price"))
    run = train(rows, config, models=models, parallelism=2)
    assert [(o.key, o.status) for o in run.outcomes] == [("one", "success"), ("two", "success")]
