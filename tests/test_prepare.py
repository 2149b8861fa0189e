import numpy as np
import pytest
from pyspark.ml import PipelineModel

from tablewright.operators.levels import encode, fit_slots
from tablewright.operators.prepare import (
    FEATURES,
    check_levels,
    feature_names,
    fit_features,
    scaled,
    wide_features,
)
from tablewright.types import ConfigError


@pytest.fixture(scope="module")
def df(spark):
    rows = [
        (20.0, 100.0, "North", True), (30.0, 300.0, "South", False), (40.0, 200.0, "East", True),
        (50.0, 500.0, "North", False), (35.0, 400.0, "South", True),
    ]
    return spark.createDataFrame(rows, "age double, `in.come` double, region string, vip boolean")


def slots(model, df):
    return np.array([r[FEATURES].toArray() for r in model.transform(df).collect()])


def test_standard_scaling_uses_the_population_deviation(df):
    x = slots(fit_features(df, ["age", "in.come"], "standard"), df)
    assert x.mean(axis=0) == pytest.approx([0, 0], abs=1e-12)
    assert x.std(axis=0) == pytest.approx([1, 1])


def test_minmax_and_none(df):
    x = slots(fit_features(df, ["age", "in.come"], "minmax"), df)
    assert x.min(axis=0).tolist() == [0, 0] and x.max(axis=0).tolist() == [1, 1]
    x = slots(fit_features(df, ["in.come"], "none"), df)
    assert x[:, 0].tolist() == [100, 300, 200, 500, 400]


@pytest.mark.parametrize("scaler", ["standard", "minmax"])
def test_constant_columns_become_zero(spark, scaler):
    df = spark.createDataFrame([(5.0,), (5.0,)], "c double")
    assert slots(fit_features(df, ["c"], scaler), df).tolist() == [[0.0], [0.0]]
    assert [r["c"] for r in scaled(df, ["c"], scaler).collect()] == [0.0, 0.0]


def test_names_order_and_unseen_levels(spark, df):
    model = fit_features(df, ["region", "age", "vip"], "none")
    names = feature_names(["age"], ["region", "vip"], model)
    assert names == ["age", "region_East", "region_North", "region_South", "vip_false", "vip_true"]
    new = spark.createDataFrame([(1.0, "West", True)], "age double, region string, vip boolean")
    assert slots(model, new).tolist() == [[1.0, 0, 0, 0, 0, 1.0]]


def test_pipeline_survives_saving(df, tmp_path):
    model = fit_features(df, ["age", "region"], "standard")
    model.write().save(f"{tmp_path}/m")
    again = PipelineModel.load(f"{tmp_path}/m")
    assert np.allclose(slots(model, df), slots(again, df))


def test_wide_features(df):
    wide = wide_features(df, ["age"], ["region", "in.come"], "minmax")
    assert wide.columns == ["age", "in.come", "region_East", "region_North", "region_South"]


def test_too_many_levels(df):
    with pytest.raises(ConfigError, match="region"):
        check_levels(df, ["region", "vip"], limit=2)


def test_columns_may_be_called_like_our_own(spark):
    df = spark.createDataFrame([(float(i), i % 3, "ab"[i % 2]) for i in range(6)], "features double, prediction int, x string")
    fitted = fit_features(df, ["features", "prediction", "x"], "none")
    assert slots(fitted, df).tolist() == [[float(i), i % 3, i % 2 == 0, i % 2 == 1] for i in range(6)]


def test_slots_are_those_of_the_pipeline(spark, df):
    slotted = fit_slots(df, ["region", "age", "vip", "in.come"], "standard")
    fitted = fit_features(df, ["region", "age", "vip", "in.come"], "standard")
    assert [r["name"] for r in slotted.names().orderBy("slot").collect()] == feature_names(["age", "in.come"], ["region", "vip"], fitted)
    found = np.zeros((5, slotted.size))
    rows = encode(df, slotted, ["age"]).collect()
    for n, r in enumerate(sorted(rows, key=lambda r: [x["age"] for x in df.collect()].index(r["age"]))):
        found[n, r["indices"]] = r["values"]
        assert r["indices"] == sorted(r["indices"]) and r["size"] == slotted.size
    assert np.allclose(found, slots(fitted, df))


def test_slots_of_unseen_missing_and_very_many_levels(spark):
    df = spark.range(200_000).selectExpr("id", "concat('level ', id) as name", "if(id % 2 = 0, 'hot', null) as part")
    slotted = fit_slots(df, ["name", "part"])
    assert slotted.size == 200_001 and slotted.numeric == []
    found = encode(df, slotted, ["id"])
    sizes = found.selectExpr("size(indices) as n").groupBy("n").count().collect()
    assert sorted(map(tuple, sizes)) == [(1, 100_000), (2, 100_000)]
    assert found.selectExpr("count(distinct indices[0])").first()[0] == 200_000
    strange = spark.createDataFrame([(1, "new", None), (2, None, "hot")], "id bigint, name string, part string")
    assert {r["id"]: r["indices"] for r in encode(strange, slotted, ["id"]).collect()} == {1: [], 2: [200_000]}
    empty = fit_slots(df.limit(0), ["name"])
    assert empty.size == 0 and empty.names().count() == 0 and encode(df.limit(0), empty, ["id"]).count() == 0
