"""The shared fits of a grid search give what separate fits give."""

from dataclasses import replace

import numpy as np
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, OneVsRest, RandomForestClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator, RegressionEvaluator
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import functions as F

from tablewright.operators.models import LABEL, PREDICTION, REGISTRY
from tablewright.operators.prepare import FEATURES, feature_stages
from tablewright.operators.staged import Part, ensemble, f1_of_parts, rmse_of_parts, staged_predictions
from tablewright.plans.search import FoldTables, largest_point, search

COLUMNS = {"featuresCol": FEATURES, "labelCol": LABEL, "predictionCol": PREDICTION}


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(8)
    made = []
    for i in range(240):
        a, b, zone = rng.uniform(0, 9), int(rng.integers(1, 6)), "wxyz"[int(rng.integers(0, 4))]
        made.append((i, float(a), b, zone, float(3 * a + b * b + 5 * (zone == "x") + rng.normal()), float((a > 4) + (b > 3))))
    # A level that only one fold has.
    made.append((240, 1.0, 2, "rare", 4.0, 0.0))
    df = spark.createDataFrame(made, "id int, a double, b int, zone string, y double, c double")
    return df.withColumn("fold", F.col("id") % 3).cache()


def prepared(rows, label):
    df = rows.withColumn(LABEL, F.col(label))
    stages = Pipeline(stages=feature_stages(["a", "b"], ["zone"], "standard")).fit(df)
    return stages.transform(df).select(FEATURES, LABEL, "id").coalesce(1).cache()


def predictions(df, model, parts, classes=0):
    made = staged_predictions(df, ensemble(df.sparkSession, model, classes), parts, FEATURES, LABEL)
    return [np.array(p) for p in zip(*[r["predictions"] for r in made.collect()])]


def direct(df, model):
    return np.array([r[0] for r in model.transform(df).select(PREDICTION).collect()])


def test_fewer_rounds_are_the_beginning_of_more(rows):
    df = prepared(rows, "y")
    fit = lambda n: GBTRegressor(maxIter=n, maxDepth=3, stepSize=0.3, seed=42, **COLUMNS).fit(df)
    got = predictions(df, fit(12), [Part(5), Part(12)])
    assert np.allclose(got[0], direct(df, fit(5))) and np.allclose(got[1], direct(df, fit(12)))


def test_boosted_classes_in_stages(rows):
    two = prepared(rows.withColumn("c", (F.col("c") > 0).cast("double")), "c")
    fit = lambda n: GBTClassifier(maxIter=n, maxDepth=2, stepSize=0.3, seed=42, **COLUMNS).fit(two)
    got = predictions(two, fit(6), [Part(2), Part(6)], 2)
    assert (got[0] == direct(two, fit(2))).all() and (got[1] == direct(two, fit(6))).all()
    three = prepared(rows, "c")
    every = lambda n: OneVsRest(
        classifier=GBTClassifier(maxIter=n, maxDepth=2, stepSize=0.3, seed=42, **COLUMNS), **COLUMNS
    ).fit(three)
    got = predictions(three, every(6), [Part(2), Part(6)], 3)
    assert (got[0] == direct(three, every(2))).all() and (got[1] == direct(three, every(6))).all()


@pytest.mark.parametrize("classes", [0, 3])
def test_forests_cut_at_a_depth(rows, classes):
    df = prepared(rows, "c" if classes else "y")
    kind = RandomForestClassifier if classes else RandomForestRegressor

    def fit(depth):
        return kind(numTrees=8, maxDepth=depth, featureSubsetStrategy="all", seed=42, **COLUMNS).fit(df)

    deep = fit(30)
    got = predictions(df, deep, [Part(8), Part(8, 4), Part(8, 0), Part(3)], classes)
    assert np.allclose(got[0], direct(df, deep)) and np.allclose(got[1], direct(df, fit(4)))
    assert np.allclose(got[2], direct(df, fit(0)))
    assert classes or len({tuple(g) for g in got}) == 4


def test_scores_of_parts_are_the_evaluators(rows, spark):
    df = prepared(rows, "c")
    model = RandomForestClassifier(numTrees=3, maxDepth=2, seed=1, **COLUMNS).fit(df)
    parts = [Part(3), Part(3, 1)]
    made = staged_predictions(df, ensemble(spark, model, 3), parts, FEATURES, LABEL)
    scorer = MulticlassClassificationEvaluator(labelCol=LABEL, predictionCol=PREDICTION, metricName="f1")
    assert f1_of_parts(made, 2)[0] == pytest.approx(scorer.evaluate(model.transform(df)))
    one = made.select(F.col("label").alias(LABEL), F.col("predictions")[1].alias(PREDICTION))
    assert f1_of_parts(made, 2)[1] == pytest.approx(scorer.evaluate(one))
    rmse = RegressionEvaluator(labelCol=LABEL, predictionCol=PREDICTION)
    assert rmse_of_parts(made, 2)[1] == pytest.approx(rmse.evaluate(one))


def tables(rows, task, label, classes=0, scaler="standard", words=("zone",)):
    return FoldTables(rows.withColumn(LABEL, F.col(label)), ["a", "b"], list(words), scaler, task, classes, [0, 1, 2])


def spec(task, key):
    return next(s for s in REGISTRY[task] if s.key == key)


@pytest.mark.parametrize("words", [("zone",), ()])
@pytest.mark.parametrize("scaler", ["standard", "minmax", "none"])
def test_linear_scores_are_those_of_separate_fits(rows, scaler, words):
    known = rows.where("zone <> 'rare'")
    found = search(spec("regression", "linear_regression"), tables(known, "regression", "y", scaler=scaler, words=words))
    expected = []
    for intercept in (True, False):
        errors = []
        for fold in range(3):
            df = known.withColumn(LABEL, F.col("y"))
            line = LinearRegression(fitIntercept=intercept, regParam=0.0, **COLUMNS)
            stages = [*feature_stages(["a", "b"], list(words), scaler), line]
            model = Pipeline(stages=stages).fit(df.where(F.col("fold") != fold))
            scorer = RegressionEvaluator(labelCol=LABEL, predictionCol=PREDICTION)
            errors.append(scorer.evaluate(model.transform(df.where(F.col("fold") == fold))))
        expected.append(np.mean(errors))
    assert found.scores == pytest.approx(expected, rel=1e-6)
    assert expected[found.best] == pytest.approx(min(expected))


def test_linear_search_with_a_level_of_one_fold_and_a_constant(rows):
    df = rows.withColumn("b", F.lit(3))
    found = search(spec("regression", "linear_regression"), tables(df, "regression", "y"))
    assert all(np.isfinite(s) and 0 < s < 20 for s in found.scores)


def test_linear_search_reads_the_rows_once(rows, spark):
    """One aggregate for the mean and one pass for the products, whatever the folds and points."""
    kept = tables(rows, "regression", "y")
    kept.side(None).rows.count()
    made = search(spec("regression", "linear_regression"), kept)
    assert len(made.scores) == 2 and list(kept._sides) == [None]


def test_one_fit_per_fold_and_kind_of_tree(rows, monkeypatch):
    fits = []
    fit = GBTRegressor._fit
    monkeypatch.setattr(GBTRegressor, "_fit", lambda self, df: fits.append((self.getMaxIter(), self.getMaxDepth())) or fit(self, df))
    boosted = spec("regression", "gbt_regressor")
    small = replace(boosted, grid={"n_estimators": [2, 4], "max_depth": [2, 3]})
    found = search(small, tables(rows, "regression", "y"))
    assert sorted(set(fits[:6])) == [(4, 2), (4, 3)] and len(fits) == 7
    assert len(found.scores) == 4 and found.scores[1] < found.scores[0]
    point = small.combinations()[found.best]
    assert found.fitted.stages[-1].getNumTrees == point["n_estimators"]


def test_largest_point():
    forest = spec("regression", "random_forest_regressor")
    assert largest_point(forest, forest.combinations()) == {"max_depth": 30, "n_estimators": 100}
    boosted = spec("regression", "gbt_regressor")
    assert largest_point(boosted, boosted.combinations()[:2]) == {"max_depth": 3, "n_estimators": 100}


@pytest.mark.parametrize("classes", [0, 3])
def test_nodes_are_read_as_columns(rows, monkeypatch, classes):
    df = prepared(rows, "c" if classes else "y")
    made = RandomForestClassifier if classes else RandomForestRegressor
    model = made(numTrees=4, maxDepth=6, seed=42, **COLUMNS).fit(df)

    def by_rows(self):
        raise AssertionError("millions of nodes, one by one")

    monkeypatch.setattr(type(df), "toPandas", by_rows)
    assert (predictions(df, model, [Part(4)], classes)[0] == direct(df, model)).all() if classes else np.allclose(
        predictions(df, model, [Part(4)])[0], direct(df, model)
    )
