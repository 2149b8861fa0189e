import math

import pytest
from pyspark.sql import functions as F

from tablewright.operators import splits


@pytest.fixture(scope="module")
def df(spark):
    return spark.range(1003).select("id", (F.col("id") % 7 % 3).cast("string").alias("c")).repartition(5)


def test_holdout_has_the_exact_size_and_order(df):
    split = splits.holdout(df, ["id"]).withColumn("k", F.expr("md5(concat_ws('|','42',cast(id as string)))"))
    rows = sorted(split.collect(), key=lambda r: r["k"])
    n = math.ceil(0.2 * 1003)
    assert [r["is_test"] for r in rows] == [True] * n + [False] * (1003 - n)


@pytest.mark.parametrize("limit", [1, 40, 10_000])
def test_refinement_depth_does_not_matter(df, monkeypatch, limit):
    expected = {r["id"]: r["fold"] for r in splits.folds(df, ["id"]).collect()}
    monkeypatch.setattr(splits, "_RANK_ROWS", limit)
    found = {r["id"]: r["fold"] for r in splits.folds(df.repartition(3), ["id"]).collect()}
    assert found == expected


def test_folds_are_even(df):
    sizes = [r["count"] for r in splits.folds(df, ["id"]).groupBy("fold").count().collect()]
    assert sorted(sizes) == [334, 334, 335]


def test_stratified_holdout_and_folds(df):
    totals = {r["c"]: r["count"] for r in df.groupBy("c").count().collect()}
    split = splits.holdout(df, ["id"], by="c")
    test = {r["c"]: r["count"] for r in split.where("is_test").groupBy("c").count().collect()}
    assert sum(test.values()) == math.ceil(0.2 * 1003)
    assert all(abs(test[c] - 0.2 * totals[c]) < 1 for c in totals)
    folded = splits.folds(df, ["id"], by="c").groupBy("c", "fold").count().collect()
    for c in totals:
        sizes = [r["count"] for r in folded if r["c"] == c]
        assert max(sizes) - min(sizes) <= 1
    whole = [sum(r["count"] for r in folded if r["fold"] == f) for f in range(3)]
    assert max(whole) - min(whole) <= 1


def test_copies_on_the_boundary_are_counted_off(spark, monkeypatch):
    monkeypatch.setattr(splits, "_COPIES_PER_TASK_ROW", 7)
    df = spark.range(100).select((F.col("id") % 3 > 0).cast("string").alias("v"))
    split = splits.holdout(df)
    assert split.count() == 100 and split.where("is_test").count() == 20
    assert split.groupBy("v").count().exceptAll(df.groupBy("v").count()).count() == 0
    sizes = sorted(r["count"] for r in splits.folds(df).groupBy("fold").count().collect())
    assert sizes == [33, 33, 34]


def test_shared_keys_are_told_apart_by_content(spark):
    df = spark.range(90).select(F.lit("same").alias("k"), "id")
    split = splits.holdout(df, ["k"])
    assert split.where("is_test").count() == 18
    again = splits.holdout(df.repartition(4), ["k"])
    assert split.exceptAll(again).count() == 0


def test_threshold_split_is_near_the_fraction(df):
    n = splits.holdout_by_threshold(df, ["id"]).where("is_test").count()
    assert abs(n - 200) < 60


def test_quotas():
    assert splits.test_quotas({"a": 50, "b": 30, "c": 20}) == {"a": 10, "b": 6, "c": 4}
    assert sum(splits.test_quotas({"a": 7, "b": 7, "c": 7}).values()) == 5


def test_assignment_moves_no_rows(df):
    plan = splits.holdout(df.sparkSession.range(1000), ["id"])._jdf.queryExecution().executedPlan()
    assert "Exchange" not in plan.toString()


def split_by_hand(sizes, fraction):
    """Test rows of classes given as (class, rows), in order."""
    total, n = math.ceil(round(fraction * sum(s for _, s in sizes), 9)), sum(s for _, s in sizes)
    rest = sorted(range(len(sizes)), key=lambda i: (-(total * sizes[i][1] % n), i))
    more = set(rest[: total - sum(total * s // n for _, s in sizes)])
    return {g: total * s // n + (i in more) for i, (g, s) in enumerate(sizes)}


@pytest.mark.parametrize("limit", [0, 30, 200_000])
def test_very_many_classes(spark, monkeypatch, limit):
    """10,000 classes in one table; the number only falls where classes are narrowed one by one."""
    monkeypatch.setattr(splits, "_RANK_ROWS", limit)
    classes = 10_000 if limit > 30 else 12
    df = spark.range(3 * classes).select("id", F.pmod(F.xxhash64("id"), F.lit(classes)).alias("c"))
    sizes = sorted((r["c"], r["count"]) for r in df.groupBy("c").count().collect())
    split = splits.holdout(df, ["id"], by="c").cache()
    assert split.count() == 3 * classes
    found = {r["c"]: r["count"] for r in split.where("is_test").groupBy("c").count().collect()}
    assert found == {c: n for c, n in split_by_hand(sizes, 0.2).items() if n}
    rows = split.withColumn("k", F.expr("md5(concat_ws('|','42',cast(id as string)))")).collect()
    last = {}
    for r in sorted(rows, key=lambda r: (r["c"], r["k"])):
        assert not (r["is_test"] and last.get(r["c"]) is False)
        last[r["c"]] = r["is_test"]
    folded = splits.folds(df, ["id"], by="c").groupBy("c", "fold").count().collect()
    whole = [sum(r["count"] for r in folded if r["fold"] == f) for f in range(3)]
    assert sum(whole) == 3 * classes and max(whole) - min(whole) <= 1


def test_classes_of_copies_and_missing_values(spark, monkeypatch):
    monkeypatch.setattr(splits, "_COPIES_PER_TASK_ROW", 7)
    rows = [("a",)] * 50 + [("b",)] * 23 + [(None,)] * 27 + [("",)] * 2
    df = spark.createDataFrame(rows, "c string")
    split = splits.holdout(df, by="c")
    assert split.count() == 102 and split.schema.names == ["c", "is_test"]
    found = {r["c"]: r["count"] for r in split.where("is_test").groupBy("c").count().collect()}
    assert found == {k: n for k, n in split_by_hand([(None, 27), ("", 2), ("a", 50), ("b", 23)], 0.2).items() if n}
    folded = splits.folds(df, by="c").groupBy("c", "fold").count().collect()
    assert sum(r["count"] for r in folded) == 102
    for c in ("a", "b", None):
        sizes = [r["count"] for r in folded if r["c"] == c]
        assert max(sizes) - min(sizes) <= 1 and len(sizes) == 3
    whole = [sum(r["count"] for r in folded if r["fold"] == f) for f in range(3)]
    assert max(whole) - min(whole) <= 1


def test_splits_of_tiny_and_empty_tables(spark):
    for n in (0, 1, 2):
        df = spark.range(n).select("id", F.lit("x").alias("c"))
        for by in (None, "c"):
            assert splits.holdout(df, ["id"], by).where("is_test").count() == math.ceil(0.2 * n)
            assert sorted(r["fold"] for r in splits.folds(df, ["id"], by).collect()) == list(range(n))
