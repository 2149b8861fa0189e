"""Metrics, training, clustering, export and scoring queries."""

from __future__ import annotations

from dataclasses import replace
from functools import cache, reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablewright.catalog.registry import query, rounded, table
from tablewright.functions.storage import cut_lineage, scratch_path
from tablewright.operators import metrics
from tablewright.operators.clusters import (
    cluster_counts,
    cluster_sizes,
    davies_bouldin,
    projection,
    silhouette_points,
)
from tablewright.operators.dbscan import build_grid, core_points, dbscan, neighbor_counts
from tablewright.operators.hierarchy import merge, micro_clusters
from tablewright.operators.models import REGISTRY
from tablewright.operators.nearest import nearest_within
from tablewright.plans import clustering, supervised
from tablewright.plans.profile import profile
from tablewright.plans.results import mark_best
from tablewright.sources.experiments import (
    assignments,
    find_experiment,
    label_rows,
    load_model,
    save_experiment,
)
from tablewright.streaming.score import read_folder, score_stream
from tablewright.types import TaskConfig

# --- metrics on predictors that SQL can state -------------------------------------------------

PRICED_SQL = """(select o_orderkey, o_totalprice as actual, avg(o_totalprice) over
  (partition by o_orderstatus, o_orderpriority) as predicted from orders)"""


def priced(spark, folder):
    orders = table(spark, folder, "orders")
    groups = orders.groupBy("o_orderstatus", "o_orderpriority").agg(
        F.avg("o_totalprice").alias("predicted")
    )
    joined = orders.join(groups, ["o_orderstatus", "o_orderpriority"])
    return joined.select("o_orderkey", F.col("o_totalprice").alias("actual"), "predicted")


@query(
    "regression_metrics",
    f"""select round(avg(abs(actual - predicted)), 5) as mae,
    round(sqrt(avg((actual - predicted) ** 2)), 5) as rmse,
    round(1 - sum((actual - predicted) ** 2) / (var_pop(actual) * count(*)), 8) as r2 from {PRICED_SQL}""",
)
def _(spark, folder):
    scores = metrics.regression_metrics(priced(spark, folder), "actual", "predicted")
    return scores.select(F.round("mae", 5).alias("mae"), F.round("rmse", 5).alias("rmse"), F.round("r2", 8).alias("r2"))


POINTS_SQL = f"""select round(actual, 5) as actual, round(predicted, 5) as predicted,
  round(actual - predicted, 5) as residual from {PRICED_SQL}
  order by md5(concat_ws('|', '42', o_orderkey::varchar)) limit 500"""


@query("actual_vs_predicted", f"select actual, predicted from ({POINTS_SQL})")
def _(spark, folder):
    points = metrics.chart_points(priced(spark, folder), "actual", "predicted", ["o_orderkey"])
    return rounded(points.select("actual", "predicted"), 5)


@query("residuals", f"select predicted, residual from ({POINTS_SQL})")
def _(spark, folder):
    points = metrics.chart_points(priced(spark, folder), "actual", "predicted", ["o_orderkey"])
    return rounded(points.select("predicted", "residual"), 5)


MAJORITY_SQL = """(select o.o_orderpriority as actual, m.guess as predicted from orders o join
  (select o_orderstatus, (o_custkey % 7) as part, o_orderpriority as guess, row_number() over (
    partition by o_orderstatus, o_custkey % 7 order by count(*) desc, o_orderpriority) as rk
   from orders group by 1, 2, 3) m
  on m.o_orderstatus = o.o_orderstatus and m.part = o.o_custkey % 7 and m.rk = 1)"""


def majority(spark, folder):
    orders = table(spark, folder, "orders").withColumn("part", F.col("o_custkey") % 7)
    sizes = orders.groupBy("o_orderstatus", "part", "o_orderpriority").count()
    order = Window.partitionBy("o_orderstatus", "part").orderBy(F.desc("count"), "o_orderpriority")
    best = sizes.withColumn("rk", F.row_number().over(order)).where("rk = 1")
    guess = best.select("o_orderstatus", "part", F.col("o_orderpriority").alias("predicted"))
    return orders.join(guess, ["o_orderstatus", "part"]).select(
        F.col("o_orderpriority").alias("actual"), "predicted"
    )


@query(
    "classification_metrics",
    f"""with p as (select * from {MAJORITY_SQL}),
    c as (select l, (select count(*) from p where actual = l) as support,
      (select count(*) from p where predicted = l) as claimed,
      (select count(*) from p where actual = l and predicted = l) as hits
      from (select distinct actual as l from p)),
    s as (select *, coalesce(hits / nullif(claimed, 0)::double, 0) as pr,
      coalesce(hits / nullif(support, 0)::double, 0) as re from c)
    select round(sum(hits) / sum(support)::double, 9) as accuracy,
    round(sum(pr * support) / sum(support)::double, 9) as "precision",
    round(sum(re * support) / sum(support)::double, 9) as recall,
    round(sum(coalesce(2 * pr * re / nullif(pr + re, 0), 0) * support) / sum(support)::double, 9) as f1 from s""",
)
def _(spark, folder):
    return rounded(metrics.classification_metrics(majority(spark, folder), "actual", "predicted"), 9)


@query(
    "confusion_matrix",
    f"""with p as (select * from {MAJORITY_SQL}), l as (select distinct o_orderpriority as l from orders)
    select a.l as actual, b.l as predicted,
    (select count(*) from p where p.actual = a.l and p.predicted = b.l)::bigint as count,
    (select count(*) from p where p.actual = a.l)::bigint as support from l a, l b""",
)
def _(spark, folder):
    predicted = majority(spark, folder)
    labels = supervised.class_labels(predicted, "actual")
    return metrics.confusion_matrix(predicted, "actual", "predicted", labels)


GUESSES = ["l_returnflag", "l_linestatus", "l_linenumber"]


@query(
    "winner",
    "with r as ("
    + " union all ".join(
        f"""select {i}::int as position, '{g}' as key, round(sqrt(avg((l_extendedprice - p) ** 2)), 6)
        as score from (select l_extendedprice, avg(l_extendedprice) over (partition by {g}) as p
        from lineitem)"""
        for i, g in enumerate(GUESSES)
    )
    + ") select key, score, row_number() over (order by score, position) = 1 as is_best from r",
)
def _(spark, folder):
    lines, rows = table(spark, folder, "lineitem"), []
    for i, g in enumerate(GUESSES):
        means = lines.groupBy(g).agg(F.avg("l_extendedprice").alias("p"))
        scores = metrics.regression_metrics(lines.join(means, g), "l_extendedprice", "p")
        rmse = round(scores.first()["rmse"], 6)
        rows.append((i, g, "success", {"rmse": rmse}))
    results = spark.createDataFrame(
        rows, "position int, key string, status string, metrics map<string,double>"
    )
    return mark_best(results, "rmse").select("key", "score", "is_best")


# --- supervised training ----------------------------------------------------------------------

Y_SQL = "(3 * l_quantity - 20 * l_discount + l_linenumber)"


@query(
    "linreg_single",
    f"""select round(regr_intercept({Y_SQL}, l_quantity), 6) as intercept,
    round(regr_slope({Y_SQL}, l_quantity), 6) as slope from lineitem""",
)
def _(spark, folder):
    lines = table(spark, folder, "lineitem").select("l_quantity", F.expr(Y_SQL).alias("y"))
    config = TaskConfig("regression", "y", ["l_quantity"], drop_duplicates=False, scaler="none")
    model = supervised.fit_one(lines, config, "linear_regression").stages[-2]
    # The fitted line at 0 and 1 says intercept and slope.
    line = [(float(model.intercept), float(model.coefficients[0]))]
    return rounded(spark.createDataFrame(line, "intercept double, slope double"), 6)


@query(
    "linreg_recovers_target",
    f"select l_orderkey, l_linenumber, round({Y_SQL}, 5) as prediction from lineitem",
)
def _(spark, folder):
    lines = table(spark, folder, "lineitem")
    features = ["l_quantity", "l_discount", "l_linenumber"]
    config = TaskConfig("regression", "y", features, drop_duplicates=False)
    model = supervised.fit_one(lines.withColumn("y", F.expr(Y_SQL)), config, "linear_regression")
    scored = supervised.score(model, lines)
    return rounded(scored.select("l_orderkey", "l_linenumber", "prediction"), 5)


@query(
    "cv_linear_score",
    """with r as (select p_partkey::double as x, p_retailprice as y, count(*) over () as n,
        row_number() over (order by md5(concat_ws('|', '42', p_partkey::varchar))) as rk from part),
    s as (select *, rk <= ceil(round(0.2 * n, 9)) as is_test from r),
    train as (select x, y, row_number() over (order by rk) as k, count(*) over () as m from s where not is_test),
    f as (select x, y, case when k <= m // 3 + (m % 3 >= 1)::int then 0
        when k <= 2 * (m // 3) + least(m % 3, 2) then 1 else 2 end as fold from train),
    lines as (select w.fold, regr_slope(y, x) as a, regr_intercept(y, x) as b
        from f join (select distinct fold from f) w on f.fold <> w.fold group by w.fold),
    errors as (select f.fold, sqrt(avg((y - b - a * x) ** 2)) as rmse from f join lines using (fold) group by f.fold),
    whole as (select regr_slope(y, x) as a, regr_intercept(y, x) as b from train)
    select (select count(*) from train)::bigint as train_rows, (select count(*) from s where is_test)::bigint as test_rows,
      round((select avg(rmse) from errors), 6) as mean_score,
      round((select sqrt(avg((y - b - a * x) ** 2)) from s, whole where is_test), 6) as test_rmse""",
)
def _(spark, folder):
    config = TaskConfig("regression", "p_retailprice", ["p_partkey"], drop_duplicates=False, scaler="none")
    line = [s for s in REGISTRY["regression"] if s.key == "linear_regression"]
    run = supervised.train(table(spark, folder, "part"), config, key=["p_partkey"], models=line)
    outcome = run.outcomes[0]
    mean_score = next(score for params, score in outcome.search if params["fit_intercept"] == "True")
    row = (run.train_rows, run.test_rows, float(mean_score), float(outcome.metrics["rmse"]))
    return rounded(
        spark.createDataFrame([row], "train_rows bigint, test_rows bigint, mean_score double, test_rmse double"), 6
    )


PRICE = TaskConfig("regression", "p_retailprice", ["p_size", "p_brand", "p_type"])
QUALITY = TaskConfig("classification", "quality", ["n_chars", "lang", "source"])
BALANCE = TaskConfig("clustering", None, ["c_acctbal", "c_nationkey"])


@cache
def trained(spark, folder, task):
    """One run per session, table folder and task, shared by the queries that look at it."""
    if task == "regression":
        return supervised.train(table(spark, folder, "part"), PRICE, parallelism=8)
    if task == "classification":
        documents, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
        joined = documents.join(labels, "doc_id", "left")
        return supervised.train(joined, QUALITY, parallelism=8)
    return clustering.train(table(spark, folder, "customer"), BALANCE)


def _register_run(task: str) -> None:
    @query(f"cv_results_{task}")
    def _(spark, folder):
        return trained(spark, folder, task).search_results()

    @query(f"comparison_{task}")
    def _(spark, folder):
        return trained(spark, folder, task).comparison()


for _task in ("regression", "classification", "clustering"):
    _register_run(_task)


@query("feature_importance")
def _(spark, folder):
    regression = trained(spark, folder, "regression").importance()
    return regression.unionByName(trained(spark, folder, "classification").importance())


@query("trained_confusion_matrix")
def _(spark, folder):
    return trained(spark, folder, "classification").outcome("logistic_regression").charts["confusion_matrix"]


@query("trained_residuals")
def _(spark, folder):
    return trained(spark, folder, "regression").outcome("linear_regression").charts["residuals"]


# --- clustering -------------------------------------------------------------------------------


def embedded(spark, folder, noise: int | None = None):
    label = F.col("label").cast("bigint")
    if noise is not None:
        label = F.when(label == noise, -1).otherwise(label)
    return table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("id"),
        F.col("embedding").cast("array<double>").alias("x"),
        F.lit(1).cast("bigint").alias("w"),
        label.cast("bigint").alias("label"),
    )


NOISY_SQL = """(select vec_id as id, embedding::double[] as x,
  case when label = 9 then -1 else label end::bigint as label from embeddings)"""


@query(
    "cluster_counts",
    f"""select count(distinct case when label <> -1 then label end)::bigint as n_clusters,
    count(*) filter (label = -1)::bigint as noise_points, count(*)::bigint as row_count,
    count(distinct case when label <> -1 then label end) between 2 and count(*) - 1 as is_valid
    from {NOISY_SQL}""",
)
def _(spark, folder):
    return cluster_counts(embedded(spark, folder, 9))


@query(
    "cluster_validity",
    """select 'given' as clustering, count(distinct label) >= 2 and count(distinct label) < count(*) as is_valid
      from embeddings
    union all select 'one', 1 >= 2 and 1 < count(*) from embeddings
    union all select 'singletons', count(*) >= 2 and count(*) < count(*) from embeddings
    union all select 'noise', 0 >= 2 and 0 < count(*) from embeddings""",
)
def _(spark, folder):
    given = embedded(spark, folder)
    variants = {
        "given": given,
        "one": given.withColumn("label", F.lit(0)),
        "singletons": given.withColumn("label", F.col("id")),
        "noise": given.withColumn("label", F.lit(-1)),
    }
    rows = [(name, cluster_counts(df).first()["is_valid"]) for name, df in variants.items()]
    return spark.createDataFrame(rows, "clustering string, is_valid boolean")


@query(
    "cluster_sizes",
    f"select label, count(*)::bigint as size from {NOISY_SQL} where label <> -1 group by 1",
)
def _(spark, folder):
    return cluster_sizes(embedded(spark, folder, 9))


SILHOUETTE_SQL = f"""with e as (select * from {NOISY_SQL} where label <> -1),
  s as (select label, count(*) as size from e group by 1),
  d as (select a.id, a.label, b.label as other, sum(list_distance(a.x, b.x)) as dist
    from e a, e b group by 1, 2, 3),
  m as (select d.id, d.label, max(case when d.label = other then size end) as size,
    max(case when d.label = other then dist / nullif(size - 1, 0) end) as a,
    min(case when d.label <> other then dist / size end) as b
    from d join s on s.label = d.other group by 1, 2)
  select id, label, case when size = 1 then 0.0::double else (b - a) / greatest(a, b) end as silhouette from m"""


@query(
    "silhouette_points",
    f"select id, label, round(silhouette, 8) as silhouette from ({SILHOUETTE_SQL})",
)
def _(spark, folder):
    points = embedded(spark, folder, 9)
    scores = silhouette_points(points, points.count())
    return rounded(scores.select("id", "label", "silhouette"), 8)


@query(
    "silhouette_euclid",
    f"select round(avg(silhouette), 8) as silhouette from ({SILHOUETTE_SQL})",
)
def _(spark, folder):
    points = embedded(spark, folder, 9)
    scores = silhouette_points(points, points.count())
    return rounded(scores.agg(F.avg("silhouette").alias("silhouette")), 8)


@query(
    "davies_bouldin",
    f"""with e as (select * from {NOISY_SQL} where label <> -1),
    u as (select id, label, unnest(x) as v, generate_subscripts(x, 1) as i from e),
    c as (select label, list(m order by i) as c from (select label, i, avg(v) as m from u group by 1, 2) group by 1),
    s as (select e.label, any_value(c.c) as c, avg(list_distance(e.x, c.c)) as spread
      from e join c on c.label = e.label group by 1),
    r as (select a.label, max((a.spread + b.spread) / nullif(list_distance(a.c, b.c), 0)) as worst
      from s a, s b where a.label <> b.label group by 1)
    select round(avg(worst), 8) as davies_bouldin from r""",
)
def _(spark, folder):
    points = embedded(spark, folder, 9)
    n_clusters = cluster_counts(points).first()["n_clusters"]
    return rounded(davies_bouldin(points, n_clusters), 8)


@query(
    "pca_two_columns",
    """with p as (select c_custkey as id, c_acctbal / 1000 as u, c_nationkey::double as v from customer),
    m as (select avg(u) as mu, avg(v) as mv, var_samp(u) as a, var_samp(v) as c, covar_samp(u, v) as b from p),
    e as (select *, (a + c) / 2 + sqrt(((a - c) / 2) ** 2 + b ** 2) as top from m),
    n as (select *, sqrt(b ** 2 + (top - a) ** 2) as size from e),
    axes as (select mu, mv, b / size as s, (top - a) / size as t from n),
    signed as (select mu, mv, s * sign(case when abs(s) >= abs(t) then s else t end) as s1,
      t * sign(case when abs(s) >= abs(t) then s else t end) as t1,
      t * sign(case when abs(t) >= abs(s) then t else -s end) as s2,
      -s * sign(case when abs(t) >= abs(s) then t else -s end) as t2 from axes)
    select id, round((u - mu) * s1 + (v - mv) * t1, 6) as x, round((u - mu) * s2 + (v - mv) * t2, 6) as y
    from p, signed order by id limit 500""",
)
def _(spark, folder):
    points = table(spark, folder, "customer").select(
        F.col("c_custkey").alias("id"),
        F.array(F.col("c_acctbal") / 1000, F.col("c_nationkey").cast("double")).alias("x"),
        F.lit(1).cast("bigint").alias("w"),
    )
    return rounded(projection(points), 6)


@query("pca_projection")
def _(spark, folder):
    return projection(embedded(spark, folder))


EPS, MIN_SAMPLES = 0.2, 4
PLANE_SQL = f"""plane as (select c_custkey as id, c_acctbal / 1000 as x, c_nationkey::double as y from customer),
  near as (select a.id, b.id as other from plane a, plane b
    where (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= {EPS}::double * {EPS}::double),
  counted as (select id, count(*) as neighbors from near group by 1),
  core as (select id from counted where neighbors >= {MIN_SAMPLES}),
  linked as (select id, other from near where id in (from core) and other in (from core)),
  reached as (select id, id as root from core union
    select linked.other, reached.root from reached join linked on linked.id = reached.id
    where reached.root < linked.other),
  clusters as (select id, min(root) as root from reached group by 1),
  numbers as (select root, row_number() over (order by root) - 1 as label from
    (select distinct root from clusters)),
  placed as (select clusters.id, label from clusters join numbers using (root)),
  border as (select near.id, min(label) as label from near join placed on placed.id = near.other
    where near.id not in (from core) group by 1)"""


def plane(spark, folder):
    """Customers as points: the balance in thousands, the nation's number."""
    x = F.array(F.col("c_acctbal") / 1000, F.col("c_nationkey").cast("double"))
    return table(spark, folder, "customer").select(
        F.col("c_custkey").alias("id"), x.alias("x"), F.lit(1).cast("bigint").alias("w")
    )


@query(
    "eps_neighbor_counts", f"with recursive {PLANE_SQL} select id, neighbors::bigint as neighbors from counted"
)
def _(spark, folder):
    return neighbor_counts(build_grid(plane(spark, folder), EPS))


@query(
    "dbscan_core",
    f"with recursive {PLANE_SQL} select id, neighbors >= {MIN_SAMPLES} as is_core from counted",
)
def _(spark, folder):
    grid = build_grid(plane(spark, folder), EPS)
    return core_points(grid, MIN_SAMPLES).select("id", "is_core")


@query(
    "dbscan_labels",
    f"""with recursive {PLANE_SQL} select plane.id, coalesce(placed.label, border.label, -1)::bigint as label
    from plane left join placed on placed.id = plane.id left join border on border.id = plane.id""",
)
def _(spark, folder):
    return dbscan(plane(spark, folder), EPS, MIN_SAMPLES).select("id", "label")


@query("kmeans_sizes")
def _(spark, folder):
    outcome = trained(spark, folder, "clustering").outcome("kmeans")
    return outcome.charts["cluster_sizes"]


@query("hierarchical_sizes")
def _(spark, folder):
    points = embedded(spark, folder).drop("label")
    micro = micro_clusters(points, points.count())
    cuts = [
        clusters.select(F.lit(linkage).alias("linkage"), F.lit(k).alias("k"), "label", "cluster")
        for linkage in ("ward", "average")
        for k, clusters in merge(micro, [2, 3, 4, 5], linkage).items()
    ]
    # All cuts at once: a micro-cluster's rows fall to one cluster in each.
    joined = micro.summary.select("label", "size").join(reduce(DataFrame.unionByName, cuts), "label")
    sizes = joined.groupBy("linkage", "k", "cluster").agg(F.sum("size").alias("size"))
    return sizes.withColumnRenamed("cluster", "label")


GROUPS = 4


@query(
    "separated_clusters",
    f"""select algorithm, count(*)::bigint as size from customer, (values ('kmeans'), ('agglomerative_clustering ward'),
    ('agglomerative_clustering average'), ('dbscan')) t(algorithm) group by algorithm, c_custkey % {GROUPS}""",
)
def _(spark, folder):
    """Groups that lie far apart: every algorithm has to find exactly them."""
    x = F.array((F.col("c_custkey") % GROUPS) * 1000 + F.col("c_acctbal") / 1000, F.col("c_nationkey").cast("double"))
    points = table(spark, folder, "customer").select(
        F.col("c_custkey").alias("id"), x.alias("x"), F.lit(1).cast("bigint").alias("w")
    )
    n = points.count()
    grids = {
        "kmeans": [{"n_clusters": GROUPS}],
        "agglomerative_clustering": [{"n_clusters": GROUPS, "linkage": k} for k in ("ward", "average")],
        "dbscan": [{"eps": 30.0, "min_samples": 3}],
    }
    sizes = [
        cluster_sizes(found.labelled).select(
            F.lit(f"{spec.key} {found.params.get('linkage', '')}".strip()).alias("algorithm"), "size"
        )
        for spec in clustering.CLUSTERERS
        for found in spec.fit(points, n, grids[spec.key])
    ]
    return reduce(DataFrame.unionByName, sizes)


NEW_ROWS_SQL = PLANE_SQL.replace("from customer)", "from customer where c_custkey % 2 = 0)", 1)


@query(
    "new_row_labels",
    f"""with recursive {NEW_ROWS_SQL},
    fresh as (select c_custkey as id, c_acctbal / 1000 as x, c_nationkey::double as y from customer where c_custkey % 2 = 1),
    gaps as (select fresh.id, placed.label, (fresh.x - p.x) * (fresh.x - p.x) + (fresh.y - p.y) * (fresh.y - p.y) as gap
      from fresh join plane p on abs(fresh.x - p.x) <= {EPS} and abs(fresh.y - p.y) <= {EPS} join placed on placed.id = p.id),
    best as (select id, first(label order by gap, label) as label from gaps where gap <= {EPS}::double * {EPS}::double group by id)
    select fresh.id, coalesce(best.label, -1)::bigint as label from fresh left join best using (id)""",
)
def _(spark, folder):
    """The clustering of one half of the customers labels the other half."""
    points = plane(spark, folder)
    fitted = dbscan(points.where("id % 2 = 0"), EPS, MIN_SAMPLES).where("is_core")
    cores = points.join(fitted.select("id", "label"), "id").select("x", "label")
    return nearest_within(points.where("id % 2 = 1"), cores, EPS)


@query(
    "saved_cluster_labels",
    f"""select c_custkey, count(*) over (partition by c_custkey % {GROUPS}, key) as cluster_rows, key as model_key
    from customer, (values ('kmeans'), ('agglomerative_clustering')) t(key)""",
)
def _(spark, folder):
    """Labels of all customers, with their key, from clusterings that were fitted on two thirds of them and saved."""
    x = (F.col("c_custkey") % GROUPS) * 1000 + F.col("c_acctbal") / 1000
    rows = table(spark, folder, "customer").select("c_custkey", x.alias("x"), F.col("c_nationkey").cast("double").alias("y"))
    config = TaskConfig("clustering", None, ["x", "y"], scaler="none")
    specs = [
        replace(s, grid={k: [v for v in values if v in (GROUPS, "ward")] for k, values in s.grid.items()})
        for s in clustering.CLUSTERERS[:2]
    ]
    run = clustering.train(rows.where("c_custkey % 3 > 0"), config, models=specs)
    base = scratch_path(spark, "cluster-experiments")
    saved_id = save_experiment(run, base, "customer")
    tables = [
        label_rows(spark, base, saved_id, s.key, rows, ["c_custkey"]).withColumn("model_key", F.lit(s.key)) for s in specs
    ]
    labels = cut_lineage(reduce(DataFrame.unionByName, tables))
    sizes = labels.groupBy("model_key", "label").agg(F.count(F.lit(1)).alias("cluster_rows"))
    return labels.join(sizes, ["model_key", "label"]).select("c_custkey", "cluster_rows", "model_key")


@query("cluster_projection")
def _(spark, folder):
    return trained(spark, folder, "clustering").outcome("kmeans").charts["pca_projection"]


# --- export and scoring -----------------------------------------------------------------------


@cache
def saved(spark, folder, task):
    base = scratch_path(spark, "experiments")
    run = trained(spark, folder, task)
    source = {"regression": "part", "clustering": "customer"}[task]
    profiled = profile(table(spark, folder, source))
    return base, save_experiment(run, base, source, profiled)


@query("experiment_log")
def _(spark, folder):
    base, experiment_id = saved(spark, folder, "regression")
    return find_experiment(spark, base, experiment_id).drop("created_at", "duration_seconds")


@query("experiment_metrics")
def _(spark, folder):
    base, experiment_id = saved(spark, folder, "regression")
    return spark.read.parquet(f"{base}/metrics")


@query("score_saved_model")
def _(spark, folder):
    base, experiment_id = saved(spark, folder, "regression")
    model = load_model(spark, base, experiment_id, "gbt_regressor")
    return supervised.score(model, table(spark, folder, "part"))


@query("cluster_assignments")
def _(spark, folder):
    base, experiment_id = saved(spark, folder, "clustering")
    return assignments(spark, base, experiment_id, "agglomerative_clustering")


TOTAL = TaskConfig("regression", "o_totalprice", ["o_custkey"], drop_duplicates=False)
SCORED_SQL = """select o_orderkey, round(i + s * o_custkey, 3) as prediction from orders,
  (select regr_intercept(o_totalprice, o_custkey) as i, regr_slope(o_totalprice, o_custkey) as s from orders)"""


def _saved_line(spark, folder):
    path = scratch_path(spark, "model")
    supervised.fit_one(table(spark, folder, "orders"), TOTAL, "linear_regression").save(path)
    return supervised.PipelineModel.load(path)


@query("score_batch", SCORED_SQL)
def _(spark, folder):
    scored = supervised.score(_saved_line(spark, folder), table(spark, folder, "orders"))
    return rounded(scored.select("o_orderkey", "prediction"), 3)


@query("score_stream", SCORED_SQL)
def _(spark, folder):
    model = _saved_line(spark, folder)
    rows = read_folder(spark, folder, "orders.parquet", like=f"{folder}/orders.parquet")
    output, checkpoint = scratch_path(spark, "scored"), scratch_path(spark, "progress")
    score_stream(model, rows, output, checkpoint).awaitTermination()
    return rounded(spark.read.parquet(output).select("o_orderkey", "prediction"), 3)
