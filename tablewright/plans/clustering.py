"""Search, score and compare the clustering algorithms of a table."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.errors import PySparkException
from pyspark.ml import PipelineModel
from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.functions import array_to_vector
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.functions.storage import cut_lineage
from tablewright.functions.threads import at_once
from tablewright.operators.clean import check_config, clean, few_rows_issue
from tablewright.operators.clusters import (
    EUCLIDEAN,
    cluster_sizes,
    projection,
    score_labelings,
)
from tablewright.operators.dbscan import build_grid, dbscan
from tablewright.operators.hierarchy import MICRO_CLUSTERS, labels_for, merge, micro_clusters
from tablewright.operators.kmeans import best_runs, kmeans_runs
from tablewright.operators.points import points_of, spread_out
from tablewright.operators.prepare import FEATURES, fit_features
from tablewright.plans.results import ModelOutcome, Run
from tablewright.types import CLUSTERING, LIMITS, SEED, ConfigError, TaskConfig, grid_points

INVALID = (
    "No combination of parameters gave a valid clustering: it takes at least two clusters, fewer "
    "clusters than rows, and not only noise."
)
# K-Means restarts per k.
RESTARTS = 10
# Searches of one algorithm that run side by side.
PARALLELISM = 4


@dataclass(frozen=True)
class Fitted:
    """A clustering tried: labelled points (id, x, w, label), and what labels new rows.

    That is a model, or ``references``: points (x, label) of which the nearest one decides, if it is no further than
    ``reach`` (any distance, if that is None).
    """

    params: dict[str, Any]
    labelled: DataFrame
    model: object | None = None
    references: DataFrame | None = None
    reach: float | None = None


@dataclass(frozen=True)
class ClusterSpec:
    key: str
    display_name: str
    grid: dict[str, list[Any]]
    fit: Callable[[DataFrame, int, list[dict[str, Any]]], Iterator[Fitted | tuple[dict, Exception]]]

    def combinations(self) -> list[dict[str, Any]]:
        """Grid points in the order the grid is written, the last parameter varying fastest."""
        return grid_points(self.grid, list(self.grid))


def _fit_kmeans(points: DataFrame, n: int, combos: list[dict[str, Any]], restarts: int = RESTARTS):
    points = spread_out(points, n)
    best = best_runs(kmeans_runs(points, sorted({p["n_clusters"] for p in combos}), restarts))
    vectors = points.select("id", "x", "w", array_to_vector("x").alias(FEATURES))
    for params in combos:
        try:
            model = kmeans_model(points.sparkSession, best[params["n_clusters"]].centres)
            labels = model.transform(vectors).select("id", "x", "w", F.col("_p").cast("bigint").alias("label"))
            yield Fitted(params, labels, model)
        except PySparkException as exc:
            yield params, exc


def kmeans_model(spark: SparkSession, centres) -> KMeansModel:
    """Spark's own model with these centres: K-Means over the centres alone leaves them where they are."""
    rows = spark.createDataFrame([(Vectors.dense(c),) for c in centres], [FEATURES])
    return KMeans(k=len(centres), initMode="random", maxIter=1, seed=SEED, featuresCol=FEATURES, predictionCol="_p").fit(rows)


def _fit_hierarchy(points: DataFrame, n: int, combos: list[dict[str, Any]], micro_count: int = MICRO_CLUSTERS):
    micro = micro_clusters(points, n, micro_count)
    ks = sorted({p["n_clusters"] for p in combos})
    linkages = list(dict.fromkeys(p["linkage"] for p in combos))
    made = at_once(points.sparkSession, [lambda k=k: merge(micro, ks, k) for k in linkages], len(linkages))
    cuts = dict(zip(linkages, made, strict=True))
    for params in combos:
        clusters = cuts[params["linkage"]].get(params["n_clusters"])
        # How coarse the leaves of the tree are is part of the result.
        params = params | {"micro_clusters": micro.count}
        if clusters is None:
            yield params, ValueError("fewer points than clusters")
        else:
            centres = micro.summary.join(clusters, "label").select(F.col("centroid").alias("x"), F.col("cluster").alias("label"))
            yield Fitted(params, labels_for(micro, clusters), references=centres)


def _fit_dbscan(points: DataFrame, n: int, combos: list[dict[str, Any]], parallelism: int = PARALLELISM):
    """One grid of cells per eps, shared by its grid points; the searches of different eps run side by side."""

    def of_eps(eps: float) -> list[Fitted | tuple[dict, Exception]]:
        found, grid = [], None
        for params in (p for p in combos if p["eps"] == eps):
            try:
                grid = grid or build_grid(points, eps)
                labels = dbscan(points, eps, params["min_samples"], grid)
                labelled = cut_lineage(points.select("id", "x", "w").join(labels, "id"))
                core = labelled.where("is_core").select("x", "label")
                found.append(Fitted(params, labelled.drop("is_core"), references=core, reach=eps))
            except PySparkException as exc:
                found.append((params, exc))
        return found

    jobs = [lambda eps=eps: of_eps(eps) for eps in dict.fromkeys(p["eps"] for p in combos)]
    made = [f for found in at_once(points.sparkSession, jobs, parallelism) for f in found]
    place = {id(p): i for i, p in enumerate(combos)}
    yield from sorted(made, key=lambda f: place[id(f.params if isinstance(f, Fitted) else f[0])])


# The three algorithms and the parameter values each one tries.
CLUSTERERS = [
    ClusterSpec("kmeans", "K-Means", {"n_clusters": [2, 3, 4, 5]}, _fit_kmeans),
    ClusterSpec(
        "agglomerative_clustering",
        "Agglomerative Clustering",
        {"n_clusters": [2, 3, 4, 5], "linkage": ["ward", "average"]},
        _fit_hierarchy,
    ),
    ClusterSpec(
        "dbscan",
        "DBSCAN",
        {"eps": [0.5, 0.75, 1.0, 1.5, 2.0], "min_samples": [3, 5, 10]},
        _fit_dbscan,
    ),
]


def train(
    df: DataFrame,
    config: TaskConfig,
    models: list[ClusterSpec] | None = None,
    score: str = EUCLIDEAN,
) -> Run:
    """Cluster all clean rows with every algorithm; there is no split and no target.

    ``score`` is the metric that decides, the same at every size: ``silhouette`` or ``silhouette_sq``.
    """
    if config.task != CLUSTERING:
        raise ConfigError("Supervised tasks are trained by tablewright.plans.supervised.train.")
    check_config(df, config)
    cleaned = clean(df, config)
    prepared = fit_features(cleaned, config.features, config.scaler)
    points = cut_lineage(points_of(cleaned, config.features, prepared))
    totals = points.agg(F.coalesce(F.sum("w"), F.lit(0)).alias("rows"), F.count("id").alias("n")).first()
    if totals["rows"] < LIMITS.min_rows:
        raise ConfigError(few_rows_issue(totals["rows"]))
    plane = projection(points)
    outcomes = cluster_all(models or CLUSTERERS, points, totals["n"], prepared, plane, score)
    return Run(config, totals["rows"], 0, outcomes, df.sparkSession)


def cluster_one(
    spec: ClusterSpec,
    points: DataFrame,
    n: int,
    prepared: PipelineModel | None,
    plane: DataFrame | None = None,
    score: str = EUCLIDEAN,
) -> ModelOutcome:
    """Best valid grid point by silhouette; the earlier one on a tie, failed ones left out."""
    return cluster_all([spec], points, n, prepared, plane, score)[0]


@dataclass
class _Attempt:
    """What the grid points of one algorithm gave: a clustering each, or none; and why all of them failed, if so."""

    spec: ClusterSpec
    tried: list[tuple[dict[str, Any], Fitted | None]]
    seconds: float
    warning: str | None = None


def cluster_all(
    specs: list[ClusterSpec],
    points: DataFrame,
    n: int,
    prepared: PipelineModel | None,
    plane: DataFrame | None = None,
    score: str = EUCLIDEAN,
) -> list[ModelOutcome]:
    """The outcome of every algorithm. All their clusterings are scored together, over distances computed once.

    The algorithms are searched side by side, so their durations overlap.
    """
    # Their searches are mostly passes of few tasks, one after the other, so they run side by side.
    attempts = at_once(points.sparkSession, [lambda spec=spec: _attempt(spec, points, n) for spec in specs], PARALLELISM)
    fitted = [f for attempt in attempts for _, f in attempt.tried if f is not None]
    started = time.perf_counter()
    labelled = _side_by_side(points, fitted) if fitted else None
    metrics = score_labelings(labelled, n, score) if fitted else []
    each = (time.perf_counter() - started) / max(1, len(fitted))
    outcomes, at = [], 0
    for attempt in attempts:
        search, best = [], None
        for params, found in attempt.tried:
            value = None
            if found is not None:
                value = _silhouette(metrics[at])
                if value is not None and (best is None or value > _silhouette(metrics[best[0]])):
                    best = (at, found)
                at += 1
                attempt.seconds += each
            search.append((_text(params), value))
        outcomes.append(_outcome(attempt, search, best, metrics, labelled, prepared, plane))
    return outcomes


def _attempt(spec: ClusterSpec, points: DataFrame, n: int) -> _Attempt:
    started = time.perf_counter()
    tried: list[tuple[dict[str, Any], Fitted | None]] = []
    warning = None
    try:
        for found in spec.fit(points, n, spec.combinations()):
            tried.append((found.params, found) if isinstance(found, Fitted) else (found[0], None))
    except (PySparkException, ValueError) as exc:
        tried, warning = [(params, None) for params, _ in tried], str(exc)
    return _Attempt(spec, tried, time.perf_counter() - started, warning)


def _side_by_side(points: DataFrame, fitted: list[Fitted]) -> DataFrame:
    """The points with ``labels``: their label in each of the clusterings."""
    parts = [f.labelled.select("id", F.lit(i).alias("at"), F.col("label").cast("bigint").alias("label")) for i, f in enumerate(fitted)]
    listed = F.sort_array(F.collect_list(F.struct("at", "label")))
    labels = reduce(DataFrame.unionByName, parts).groupBy("id").agg(F.transform(listed, lambda s: s["label"]).alias("labels"))
    return cut_lineage(points.select("id", "x", "w").join(labels, "id"))


def _outcome(attempt, search, best, metrics, labelled, prepared, plane) -> ModelOutcome:
    spec = attempt.spec
    if best is None:
        warning = attempt.warning or INVALID
        return ModelOutcome(spec.key, spec.display_name, "failed", attempt.seconds, warning=warning, search=search)
    started = time.perf_counter()
    place, found = best
    mine = labelled.select("id", "x", "w", F.col("labels")[place].alias("label"))
    charts = {"cluster_sizes": cluster_sizes(mine)}
    if plane is not None:
        charts["pca_projection"] = plane.join(mine.select("id", "label"), "id").select(
            "x", "y", F.col("label").cast("string").alias("cluster")
        )
    stages = list(prepared.stages) if prepared else []
    if found.model is not None:
        stages.append(found.model.setPredictionCol("prediction"))
    return ModelOutcome(
        spec.key,
        spec.display_name,
        "success",
        attempt.seconds + time.perf_counter() - started,
        _text(found.params),
        metrics[place],
        pipeline=PipelineModel(stages=stages),
        charts=charts,
        search=search,
        assignments=mine.select("id", "w", "label"),
        references=found.references,
        reach=found.reach,
    )


def _silhouette(metrics: dict[str, float] | None) -> float | None:
    if metrics is None:
        return None
    return metrics.get("silhouette", metrics.get("silhouette_sq"))


def _text(params: dict[str, Any]) -> dict[str, str]:
    return {k: str(v) for k, v in params.items()}
