import pytest

from tablewright.operators.clean import check_config, clean, row_accounting, target_issues
from tablewright.plans.preview import final_features, prep_preview
from tablewright.plans.supervised import fit_one
from tablewright.types import ConfigError, TaskConfig


@pytest.fixture(scope="module")
def df(spark):
    rows = [(float(i), "ab"[i % 2], i % 3, i) for i in range(60)]
    rows += [rows[0], rows[1]]
    rows += [(None, "a", 0, 100), (1.0, None, 0, 101), (float("nan"), "b", 1, 102)]
    return spark.createDataFrame(rows, "x double, s string, y bigint, extra bigint")


@pytest.mark.parametrize(
    ("config", "message"),
    [
        (TaskConfig("regression", "nope", ["zz", "x"]), "nope, zz"),
        (TaskConfig("regression", "y", []), "At least one feature"),
        (TaskConfig("regression", None, ["x"]), "target column is needed"),
        (TaskConfig("clustering", "y", ["x"]), "no target"),
        (TaskConfig("regression", "y", ["x", "y"]), "cannot be one of the features"),
        (TaskConfig("regression", "y", ["x", "x"]), "more than once"),
        (TaskConfig("clustering", None, ["x", "s"]), "numeric features only, not: s"),
        (TaskConfig("guess", "y", ["x"]), "Task must be"),
    ],
)
def test_structural_checks(df, config, message):
    with pytest.raises(ConfigError, match=message):
        check_config(df, config)


def test_only_selected_columns_decide(df):
    config = TaskConfig("regression", "y", ["x", "s"])
    assert clean(df, config).count() == 60
    counts = row_accounting(df, config).first().asDict()
    assert counts == {
        "original_rows": 65, "removed_missing_rows": 3, "removed_duplicate_rows": 2, "final_rows": 60,
    }
    kept = TaskConfig("regression", "y", ["x", "s"], drop_duplicates=False)
    assert row_accounting(df, kept).first()["final_rows"] == clean(df, kept).count() == 62


def test_preview(df):
    row = prep_preview(df, TaskConfig("classification", "y", ["s", "x"])).first()
    assert row["final_rows"] == 60 and row["ready_to_train"] and row["warnings"] == []
    assert row["final_feature_columns"] == ["x", "s_a", "s_b"] and row["feature_count"] == 3


def test_levels_come_from_clean_rows_only(spark):
    df = spark.createDataFrame([("a", 1), ("b", None)], "s string, y bigint")
    names = [r["name"] for r in final_features(df, TaskConfig("regression", "y", ["s"])).collect()]
    assert names == ["s_a"]


def test_preview_warnings(spark):
    few = spark.createDataFrame([(i, i, i) for i in range(10)], "a bigint, b bigint, t bigint")
    row = prep_preview(few, TaskConfig("regression", "t", ["a", "b"])).first()
    assert row["final_rows"] == 10 and not row["ready_to_train"] and "at least" in row["warnings"][0]
    lossy = spark.createDataFrame([(i if i % 2 else None, i) for i in range(100)], "a bigint, t bigint")
    row = prep_preview(lossy, TaskConfig("regression", "t", ["a"])).first()
    assert row["ready_to_train"] and row["warnings"] == ["Cleaning removes 50 of 100 rows (50%)."]
    nothing = spark.createDataFrame([(None, 1)] * 3, "a bigint, t bigint")
    row = prep_preview(nothing, TaskConfig("classification", "t", ["a"])).first()
    assert row["final_rows"] == 0 and row["final_feature_columns"] == []


def test_target_rules(spark):
    words = spark.createDataFrame([(i, "rb"[i % 2]) for i in range(40)], "a bigint, y string")
    assert "numeric" in target_issues(words, TaskConfig("regression", "y", ["a"]))[0]
    many = spark.createDataFrame([(i, i * 1.5) for i in range(60)], "a bigint, y double")
    issue = target_issues(many, TaskConfig("classification", "y", ["a"]))[0]
    assert "too many" in issue and "continuous" in issue and "60 distinct" in issue
    rare = spark.createDataFrame([(i, int(i >= 35)) for i in range(38)], "a bigint, y bigint")
    issue = target_issues(rare, TaskConfig("classification", "y", ["a"]))[0]
    assert "class 1 has fewer than 6" in issue and "Too few" in issue
    one = spark.createDataFrame([(i, 1) for i in range(40)], "a bigint, y bigint")
    assert "two classes" in target_issues(one, TaskConfig("classification", "y", ["a"]))[0]
    thin = spark.createDataFrame([(i, i % 15) for i in range(45)], "a bigint, y bigint")
    issue = target_issues(thin, TaskConfig("classification", "y", ["a"]))[0]
    assert "and 5 more" in issue and len(issue) < 400


def test_names_with_dots(spark):
    rows = [(float(i), float(i % 7), "x" if i % 2 else "y") for i in range(60)] + [(None, 1.0, "x")]
    df = spark.createDataFrame(rows, "`a.b` double, `y.z` double, `k.k` string")
    config = TaskConfig("regression", "y.z", ["a.b", "k.k"], drop_duplicates=False)
    assert clean(df, config).count() == 60
    row = prep_preview(df, config).first()
    assert row["final_rows"] == 60 and row["final_feature_columns"] == ["a.b", "k.k_x", "k.k_y"]
    assert row["ready_to_train"] and row["feature_count"] == 3


def test_too_many_classes_stop_a_single_fit(spark):
    df = spark.range(500).selectExpr("double(id) as a", "id % 25 as c")
    config = TaskConfig("classification", "c", ["a"], drop_duplicates=False)
    with pytest.raises(ConfigError, match="25 distinct values"):
        fit_one(df, config, "logistic_regression")
