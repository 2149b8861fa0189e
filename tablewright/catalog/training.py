"""Whole training runs on targets whose best predictor SQL can state, and the experiments saved from them.

The target is a step of p_size: trees that find the step predict it exactly, and the linear model is the least
squares plane. All three models are searched over their full spaces.
"""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from tablewright.catalog.registry import query, rounded, table
from tablewright.functions.storage import scratch_path
from tablewright.operators.models import REGISTRY
from tablewright.plans import supervised
from tablewright.plans.profile import profile
from tablewright.sources.experiments import (
    find_experiment,
    read_chart,
    read_importances,
    read_metrics,
    read_profile,
    save_experiment,
    score_rows,
)
from tablewright.types import TaskConfig

FEATURES = ["s", "p_partkey"]
LEVEL = TaskConfig("regression", "y", FEATURES, drop_duplicates=False)
GRADE = TaskConfig("classification", "c", FEATURES, drop_duplicates=False)


def steps(spark, folder):
    s = F.col("p_size") % 10
    return table(spark, folder, "part").select(
        "p_partkey",
        s.alias("s"),
        F.when(s > 4, 10.0).otherwise(2.0).alias("y"),
        F.when(s > 4, "high").otherwise("low").alias("c"),
    )


@cache
def stepped(spark, folder, config_task):
    """One run per session, table folder and task, shared by the queries that look at it."""
    config = LEVEL if config_task == "regression" else GRADE
    return supervised.train(steps(spark, folder), config, key=["p_partkey"], parallelism=8)


@cache
def stored(spark, folder):
    base = scratch_path(spark, "step-experiments")
    profiled = profile(steps(spark, folder))
    return base, save_experiment(stepped(spark, folder, "regression"), base, "part", profiled)


def written_out(params: str) -> Column:
    pairs = F.transform(F.map_entries(params), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return F.array_join(F.array_sort(pairs), ",")


# Rows with the step, the place in the split's order and the fold.
_ROWS = """rows as (select p_partkey, (p_size % 10)::double as x1, p_partkey::double as x2,
    case when p_size % 10 > 4 then 10.0 else 2.0 end::double as y, count(*) over () as n,
    row_number() over (order by md5(concat_ws('|', '42', p_partkey::varchar))) as rk from part),
  split as (select *, rk <= ceil(round(0.2 * n, 9)) as is_test from rows),
  train as (select *, row_number() over (order by rk) as k, count(*) over () as m from split where not is_test),
  folds as (select *, case when k <= m // 3 + (m % 3 >= 1)::int then 0
    when k <= 2 * (m // 3) + least(m % 3, 2) then 1 else 2 end as fold from train)"""

_PLANE = """my, m1, m2, (b * p - c * q) / (a * b - c * c) as b1, (a * q - c * p) / (a * b - c * c) as b2 from (select {key}
  avg(y) as my, avg(x1) as m1, avg(x2) as m2, var_pop(x1) as a, var_pop(x2) as b, covar_pop(x1, x2) as c,
  covar_pop(x1, y) as p, covar_pop(x2, y) as q from {rows})"""


def _points(key: str) -> list[str]:
    spec = next(s for specs in REGISTRY.values() for s in specs if s.key == key)
    return [",".join(f"{k}={v}" for k, v in sorted(spec.fitted_point(p).items())) for p in spec.combinations()]


def _listed(keys: list[str]) -> str:
    return ", ".join(f"('{key}', {i}, '{p}')" for key in keys for i, p in enumerate(_points(key)))


# A tree that finds the step predicts the mean of each side: what is left is that mean's error.
_TREE_ERROR = "(select sqrt(avg((y - g) ** 2)) from (select y, avg(y) over (partition by x1 > 4) as g from folds))"


@query(
    "step_cv_results",
    f"""with {_ROWS},
  planes as (select fold, {_PLANE.format(key="w.fold,", rows="folds f join (select distinct fold from folds) w on f.fold <> w.fold group by w.fold")}),
  errors as (select fold, sqrt(avg((y - my - b1 * (x1 - m1) - b2 * (x2 - m2)) ** 2)) as with_it,
    sqrt(avg((y - b1 * (x1 - m1) - b2 * (x2 - m2)) ** 2)) as without from folds join planes using (fold) group by fold)
  select 'linear_regression' as key, 0 as point, 'fit_intercept=True' as params, round(avg(with_it), 6) as mean_score from errors
  union all select 'linear_regression', 1, 'fit_intercept=False', round(avg(without), 6) from errors
  union all select key, point, params, round({_TREE_ERROR}, 6)
    from (values {_listed(["random_forest_regressor", "gbt_regressor"])}) t(key, point, params)""",
)
def _(spark, folder):
    found = stepped(spark, folder, "regression").search_results()
    return rounded(found.select("key", "point", written_out("params").alias("params"), "mean_score"), 6)


_WHOLE = f"""{_ROWS}, plane as (select {_PLANE.format(key="", rows="train")}),
  test as (select *, my + b1 * (x1 - m1) + b2 * (x2 - m2) as line from split, plane where is_test)"""


@query(
    "step_comparison",
    f"""with {_WHOLE}, found as (
    select 'linear_regression' as key, 'fit_intercept=True' as best_params, sqrt(avg((y - line) ** 2)) as rmse,
      avg(abs(y - line)) as mae, 1 - sum((y - line) ** 2) / (var_pop(y) * count(*)) as r2 from test
    union all select key, params, {_TREE_ERROR}, {_TREE_ERROR}, 1
      from (values {_listed(["random_forest_regressor", "gbt_regressor"])}) t(key, point, params) where point = 0)
  select key, 'success' as status, best_params, round(rmse, 6) as rmse, round(mae, 6) as mae, round(r2, 6) as r2,
    key = 'random_forest_regressor' as is_best from found""",
)
def _(spark, folder):
    found = stepped(spark, folder, "regression").comparison()
    metrics = [F.col("metrics")[name].alias(name) for name in ("rmse", "mae", "r2")]
    return rounded(found.select("key", "status", written_out("best_params").alias("best_params"), *metrics, "is_best"), 6)


@query(
    "step_importance",
    """select key, feature, (feature = 's')::int::double as importance
  from (values ('random_forest_regressor'), ('gbt_regressor')) t(key), (values ('s'), ('p_partkey')) u(feature)
  where (select count(distinct p_size % 10 > 4) from part) = 2""",
)
def _(spark, folder):
    return rounded(stepped(spark, folder, "regression").importance(), 9)


_DRAWN = f"with {_WHOLE}, drawn as (select * from test order by rk limit 500)"


@query(
    "step_residuals",
    f"""{_DRAWN} select 'linear_regression' as key, round(line, 6) as predicted, round(y - line, 6) as residual from drawn
  union all select 'random_forest_regressor', y, 0.0 from drawn union all select 'gbt_regressor', y, 0.0 from drawn""",
)
def _(spark, folder):
    tables = [
        o.charts["residuals"].select(F.lit(o.key).alias("key"), "predicted", "residual")
        for o in stepped(spark, folder, "regression").outcomes
    ]
    found = rounded(tables[0].union(tables[1]).union(tables[2]), 6)
    # A zero has no sign in the chart.
    return found.withColumn("residual", F.col("residual") + 0.0)


# Classes are split apart, each in digest order; a side's share goes to the largest remainder first.
_GRADES = """sizes as (select c, count(*) as n from (select case when p_size % 10 > 4 then 'high' else 'low' end as c from part) group by 1),
  total as (select ceil(round(0.2 * sum(n), 9))::bigint as t, sum(n)::bigint as n from sizes),
  quota as (select c, t * sizes.n // total.n as q, t * sizes.n % total.n as r, t from sizes, total),
  tested as (select c, (q + (row_number() over (order by r desc, c) <= t - sum(q) over ())::int)::bigint as n from quota)"""


@query(
    "step_classes_cv",
    f"""select key, point, params, round((select count(*) from part)::double / (select count(*) from part), 6) as mean_score
  from (values {_listed(["random_forest_classifier", "gbt_classifier"])}) t(key, point, params)""",
)
def _(spark, folder):
    found = stepped(spark, folder, "classification").search_results().where("key <> 'logistic_regression'")
    return rounded(found.select("key", "point", written_out("params").alias("params"), "mean_score"), 6)


@query(
    "step_confusion",
    f"""with {_GRADES} select key, a.c as actual, b.c as predicted, case when a.c = b.c then a.n else 0 end as count, a.n as support
  from tested a, tested b, (values ('random_forest_classifier'), ('gbt_classifier')) t(key)""",
)
def _(spark, folder):
    run = stepped(spark, folder, "classification")
    tables = [
        run.outcome(key).charts["confusion_matrix"].select(F.lit(key).alias("key"), "actual", "predicted", "count", "support")
        for key in ("random_forest_classifier", "gbt_classifier")
    ]
    return tables[0].union(tables[1])


# --- read back from a saved experiment --------------------------------------------------------


@query(
    "saved_record",
    f"""with {_ROWS} select 'part' as dataset, 'regression' as task, 'y' as target, 's,p_partkey' as features,
    'standard' as scaler, (select count(*) from train)::bigint as train_rows,
    (select count(*) from split where is_test)::bigint as test_rows, 'rmse' as primary_metric,
    'random_forest_regressor' as winner_key, key as model_key, 'success' as status
  from (values ('linear_regression'), ('random_forest_regressor'), ('gbt_regressor')) t(key)""",
)
def _(spark, folder):
    base, experiment_id = stored(spark, folder)
    return find_experiment(spark, base, experiment_id).select(
        "dataset", "task", "target", F.array_join("features", ",").alias("features"), "scaler", "train_rows",
        "test_rows", "primary_metric", "winner_key", "model_key", "status",
    )


@query(
    "saved_metrics",
    f"""with {_WHOLE}, line as (select sqrt(avg((y - line) ** 2)) as rmse, avg(abs(y - line)) as mae,
    1 - sum((y - line) ** 2) / (var_pop(y) * count(*)) as r2 from test)
  select 'linear_regression' as model_key, unnest(['rmse', 'mae', 'r2']) as metric, round(unnest([rmse, mae, r2]), 6) as value from line
  union all select key, unnest(['rmse', 'mae', 'r2']), unnest([{_TREE_ERROR}, {_TREE_ERROR}, 1.0])
    from (values ('random_forest_regressor'), ('gbt_regressor')) t(key)""",
)
def _(spark, folder):
    return rounded(read_metrics(spark, *stored(spark, folder)), 6)


@query(
    "saved_importances",
    """select key as model_key, feature, (feature = 's')::int::double as importance
  from (values ('random_forest_regressor'), ('gbt_regressor')) t(key), (values ('s'), ('p_partkey')) u(feature)
  where (select count(distinct p_size % 10 > 4) from part) = 2""",
)
def _(spark, folder):
    return rounded(read_importances(spark, *stored(spark, folder)), 9)


@query("saved_chart", f"{_DRAWN} select round(y, 6) as actual, round(line, 6) as predicted from drawn")
def _(spark, folder):
    base, experiment_id = stored(spark, folder)
    return rounded(read_chart(spark, base, experiment_id, "linear_regression", "actual_vs_predicted"), 6)


@query(
    "saved_profile",
    """select 'p_partkey' as column, 'numeric' as kind, count(*)::bigint as row_count, 0::bigint as missing_count,
    count(distinct p_partkey)::bigint as unique_count from part
  union all select 's', 'numeric', count(*)::bigint, 0, count(distinct p_size % 10)::bigint from part
  union all select 'y', 'numeric', count(*)::bigint, 0, count(distinct p_size % 10 > 4)::bigint from part
  union all select 'c', 'categorical', count(*)::bigint, 0, count(distinct p_size % 10 > 4)::bigint from part""",
)
def _(spark, folder):
    found = read_profile(spark, *stored(spark, folder), "columns")
    return found.select("column", "kind", "row_count", "missing_count", "unique_count")


@query(
    "saved_predictions",
    """select p_partkey, key as model_key, case when p_size % 10 > 4 then 10.0 else 2.0 end::double as prediction
  from part, (values ('random_forest_regressor'), ('gbt_regressor')) t(key)""",
)
def _(spark, folder):
    base, experiment_id = stored(spark, folder)
    rows = steps(spark, folder).drop("y", "c")
    tables = [
        score_rows(spark, base, experiment_id, key, rows).select("p_partkey", F.lit(key).alias("model_key"), "prediction")
        for key in ("random_forest_regressor", "gbt_regressor")
    ]
    return rounded(tables[0].union(tables[1]), 6)
