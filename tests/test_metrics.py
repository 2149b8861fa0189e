import pytest

from tablewright.operators.metrics import (
    chart_points,
    classification_metrics,
    confusion_matrix,
    regression_metrics,
)
from tablewright.plans.results import RESULT_SCHEMA, mark_best


def test_regression_scores_by_hand(spark):
    df = spark.createDataFrame([(3.0, 2.5), (-0.5, 0.0), (2.0, 2.0), (7.0, 8.0)], "y double, p double")
    row = regression_metrics(df, "y", "p").first()
    assert row["mae"] == pytest.approx(0.5)
    assert row["rmse"] == pytest.approx(0.6123724356957945)
    assert row["r2"] == pytest.approx(0.9486081370449679)


@pytest.mark.parametrize(("p", "r2"), [(2.0, 1.0), (3.0, 0.0)])
def test_constant_target(spark, p, r2):
    df = spark.createDataFrame([(2.0, p), (2.0, p)], "y double, p double")
    assert regression_metrics(df, "y", "p").first()["r2"] == r2


def test_classification_scores_by_hand(spark):
    pairs = [("a", "a"), ("a", "b"), ("b", "b"), ("b", "b"), ("c", "a")]
    row = classification_metrics(spark.createDataFrame(pairs, "y string, p string"), "y", "p").first()
    assert row["accuracy"] == pytest.approx(0.6)
    assert row["precision"] == pytest.approx((2 * 0.5 + 2 * 2 / 3 + 0) / 5)
    assert row["recall"] == pytest.approx(0.6)
    assert row["f1"] == pytest.approx((2 * 0.5 + 2 * 0.8 + 0) / 5)


def test_confusion_matrix_is_filled(spark):
    df = spark.createDataFrame([(1, 1), (1, 2), (10, 1)], "y bigint, p bigint")
    rows = {(r["actual"], r["predicted"]): (r["count"], r["support"]) for r in confusion_matrix(df, "y", "p", [1, 2, 10]).collect()}
    assert len(rows) == 9 and rows[(1, 2)] == (1, 2) and rows[(2, 2)] == (0, 0) and rows[(10, 1)] == (1, 1)


def test_chart_points_are_limited_and_stable(spark):
    df = spark.range(900).selectExpr("id", "id * 1.0 as y", "id + 0.5 as p")
    first = chart_points(df, "y", "p", ["id"])
    assert first.count() == 500 and {r["residual"] for r in first.collect()} == {-0.5}
    assert first.exceptAll(chart_points(df.repartition(9), "y", "p", ["id"])).count() == 0


def outcome(position, key, status, **metrics):
    return (position, key, key, status, 0.1, None, metrics or None, None)


@pytest.mark.parametrize(
    ("metric", "rows", "winner"),
    [
        ("rmse", [("a", 2.0), ("b", 1.0), ("c", 1.0)], "b"),
        ("f1", [("a", 0.2), ("b", 0.9), ("c", 0.9)], "b"),
        ("silhouette", [("a", -0.2), ("b", -0.1), ("c", None)], "b"),
    ],
)
def test_winner(spark, metric, rows, winner):
    data = [
        outcome(i, k, "success", **{metric: v}) if v is not None else outcome(i, k, "failed")
        for i, (k, v) in enumerate(rows)
    ]
    marked = mark_best(spark.createDataFrame(data, RESULT_SCHEMA), metric)
    assert [r["key"] for r in marked.where("is_best").collect()] == [winner]


def test_no_winner_when_all_failed(spark):
    data = [outcome(0, "a", "failed"), outcome(1, "b", "failed")]
    marked = mark_best(spark.createDataFrame(data, RESULT_SCHEMA), "rmse")
    assert marked.where("is_best").count() == 0
