"""Validity, sizes and scores of a clustering. Noise carries the label -1.

Inputs are labelled points: (id, x, w, label).
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.functions.storage import cut_lineage, join_small
from tablewright.operators import far
from tablewright.operators.pairs import ClusterSums, block_count, combined, meet_blocks, product, run_sums, runs_of, tiles, vectors
from tablewright.operators.points import distances, over_block_pairs, running_sums, squared_distance
from tablewright.types import LIMITS

NOISE = -1
# The silhouette's distances: plain ones at every size, or the closed form over squared ones.
EUCLIDEAN, SQUARED = "silhouette", "silhouette_sq"
# Decimals of a score by which clusterings are compared.
DIGITS = 12


def cluster_counts(labelled: DataFrame) -> DataFrame:
    """One row: clusters, noise rows, all rows, and whether the clustering may be scored.

    Valid means at least two clusters and fewer clusters than rows.
    """
    real = F.when(F.col("label") != NOISE, F.col("label"))
    counts = labelled.agg(
        F.count_distinct(real).alias("n_clusters"),
        F.coalesce(F.sum(F.when(F.col("label") == NOISE, F.col("w"))), F.lit(0)).alias("noise_points"),
        F.coalesce(F.sum("w"), F.lit(0)).alias("row_count"),
    )
    valid = (F.col("n_clusters") >= 2) & (F.col("n_clusters") < F.col("row_count"))
    return counts.withColumn("is_valid", valid)


def cluster_sizes(labelled: DataFrame) -> DataFrame:
    """(label, size) without noise."""
    real = labelled.where(F.col("label") != NOISE)
    return real.groupBy("label").agg(F.sum("w").alias("size"))


def cluster_distance_sums(labelled: DataFrame, n: int) -> DataFrame:
    """(label, other, total): summed distance over all pairs of rows of two clusters.

    Blocks hold neighbours in the order of the labels, so a task meets its few labels with all others. Many points on a line
    or in a plane meet their neighbours only, and the rest through the nodes of boxes (``far``).
    """
    if far.applies(labelled, n):
        # No more than the clusters that a task sums apart, and one.
        named = [r["label"] for r in labelled.select("label").distinct().limit(far.GROUPS + 1).collect()]
        if len(named) <= far.GROUPS and None not in named:
            return _both_ways(_far_distance_sums(labelled, n, sorted(named)))
    counts = labelled.groupBy("label").agg(F.count(F.lit(1)).alias("_n"))
    blocks = block_count(n, labelled.select(F.size("x")).first()[0] + 4 if n else 1) // 2 * 2 + 1
    starts = running_sums(counts, "label", "_n", "_start")
    place = F.col("_start") + F.pmod(F.xxhash64("id"), F.col("_n"))
    block = F.least(F.floor(place / math.ceil(max(n, 1) / blocks)), F.lit(blocks - 1))

    def totals(own: pa.Table, others):
        mine = vectors(combined(own.column("x")))
        weights = own.column("w").to_numpy().astype(float)
        labels = own.column("label").to_numpy()
        heads, first = np.unique(labels, return_index=True)
        found: dict[int, np.ndarray] = {}

        def meet(piece, factor: float) -> None:
            theirs = combined(piece.column("label")).to_numpy(zero_copy_only=False)
            y, w = vectors(combined(piece.column("x"))), combined(piece.column("w")).to_numpy(zero_copy_only=False).astype(float)
            starts = runs_of(theirs)
            away = np.empty((len(mine), len(starts)))
            for rows, sums in run_sums(mine, y, w, starts):
                away[rows] = sums
            total = np.add.reduceat(away * weights[:, None], first, axis=0)
            for at, label in enumerate(theirs[starts].tolist()):
                found[label] = found.get(label, 0.0) + factor * total[:, at]

        # Inside a block both directions are met, between blocks one.
        for tile in tiles([own]):
            meet(tile, 1.0)
        inside, found = found, {}
        for tile in tiles(others):
            meet(tile, 2.0)
        for part in (inside, found):
            for label, total in part.items():
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.minimum(heads, label)), pa.array(np.maximum(heads, label)), pa.array(total)],
                    names=["label", "other", "total"],
                )

    placed = join_small(labelled.select("id", "x", "w", "label"), starts.select("label", "_n", "_start"), "label")
    met = meet_blocks(placed, block, blocks, True, "label", totals, "label bigint, other bigint, total double")
    return _both_ways(met)


def _far_distance_sums(labelled: DataFrame, n: int, named: list) -> DataFrame:
    """(label, other, total) in parts that add up to both directions of every pair of clusters, the lesser label first."""
    names = np.array(named)

    def totals(own: pa.Table, potential, given, pieces):
        x, weights = vectors(combined(own.column("x"))), own.column("w").to_numpy().astype(float)
        mine = own.column("group").to_numpy()
        order = np.argsort(mine, kind="stable")
        starts = runs_of(mine[order])
        total = np.add.reduceat((far.point_sums(own, potential, given, pieces) * weights[:, None])[order], starts, axis=0)
        every = np.arange(len(names))
        for group, sums in zip(mine[order][starts].tolist(), total):
            yield pa.RecordBatch.from_arrays(
                [pa.array(names[np.minimum(every, group)]), pa.array(names[np.maximum(every, group)]), pa.array(sums)],
                names=["label", "other", "total"],
            )

    grouped = _numbered(labelled.select("id", "x", "w", F.array("label").alias("labels")), [(v,) for v in named])
    return far.group_sums(grouped.drop("labels"), n, len(named), totals, "label bigint, other bigint, total double")


def _numbered(rows: DataFrame, tuples: list[tuple]) -> DataFrame:
    """Rows with ``group``: the place of their labels among ``tuples``, which are few."""
    kind = rows.schema["labels"].dataType.simpleString()
    places = rows.sparkSession.createDataFrame([(list(t), i) for i, t in enumerate(tuples)], f"labels {kind}, group int")
    return rows.join(F.broadcast(places), "labels")


def _both_ways(met: DataFrame) -> DataFrame:
    # Half of both directions: each pair of clusters has one sum, the same from both sides.
    sums = met.groupBy("label", "other").agg(F.sum("total").alias("total"))
    same = sums.where("label = other")
    half = cut_lineage(sums.where("label <> other").withColumn("total", F.col("total") / 2))
    return same.unionByName(half).unionByName(half.select(F.col("other").alias("label"), F.col("label").alias("other"), "total"))


def silhouette_points(labelled: DataFrame, n: int) -> DataFrame:
    """(id, label, w, silhouette) from all Euclidean distances; members of singletons get 0."""
    given = labelled.select("id", "x", "w", F.array(F.col("label").cast("bigint")).alias("labels"))
    return many_silhouette_points(given, n).drop("labeling")


def many_silhouette_points(labelled: DataFrame, n: int, clusters: int = 0) -> DataFrame:
    """(id, labeling, label, w, silhouette) for every labeling of points with ``labels``, noise left out.

    Every task meets all points and needs only sums per cluster, so a point's scores are finished where it is. ``clusters``
    is the number of clusters of all labelings, if known: a task holds so many numbers per point.
    """
    kind = labelled.schema["id"].dataType.simpleString()
    schema = f"id {kind}, labeling int, label bigint, w bigint, silhouette double"
    if far.applies(labelled, n):
        # Points with the same labels in all labelings are one group; no more groups than a task sums apart, and one.
        found = labelled.groupBy("labels").agg(F.sum("w").alias("size")).limit(far.GROUPS + 1).collect()
        if len(found) <= far.GROUPS and all(None not in r["labels"] for r in found):
            sizes = {tuple(r["labels"]): r["size"] for r in found}
            return _far_silhouette_points(labelled, n, sizes, schema)
    first = labelled.select(F.size("x"), F.size("labels")).first()
    blocks = block_count(n, sum(first) + clusters + 2 if first else 1)

    def codes(column) -> np.ndarray:
        """Labels, one column per labeling; NOISE for those of nobody."""
        flat = pc.fill_null(combined(column).flatten(), NOISE).to_numpy(zero_copy_only=False)
        return flat.reshape(len(column), -1)

    def scores(own: pa.Table, others):
        table = ClusterSums(vectors(combined(own.column("x"))), NOISE)
        for tile in itertools.chain(tiles([own]), tiles(others)):
            w = combined(tile.column("w")).to_numpy(zero_copy_only=False).astype(float)
            table.add(vectors(combined(tile.column("x"))), w, codes(tile.column("labels")))
        yield from _point_scores(own, table.places, table.sums, table.sizes)

    block = F.pmod(F.xxhash64("id"), F.lit(blocks))
    return meet_blocks(labelled.select("id", "x", "w", "labels"), block, blocks, False, "labels", scores, schema)


def _far_silhouette_points(labelled: DataFrame, n: int, sizes: dict[tuple, int], schema: str) -> DataFrame:
    """As many_silhouette_points, with sums over boxes; ``sizes`` has the rows of each tuple of labels."""
    tuples = sorted(sizes)
    places: dict[tuple[int, int], int] = {}
    at = [
        (group, places.setdefault((k, label), len(places)))
        for group, labels in enumerate(tuples) for k, label in enumerate(labels) if label != NOISE
    ]
    member = np.zeros((len(tuples), len(places)))
    for group, place in at:
        member[group, place] = 1.0
    rows_of = np.rint(np.array([float(sizes[t]) for t in tuples]) @ member).astype(np.int64)

    def scores(own: pa.Table, potential, given, pieces):
        sums = far.point_sums(own, potential, given, pieces)
        yield from _point_scores(own, places, product(sums, member, np.empty((len(sums), len(places)))), rows_of)

    grouped = _numbered(labelled.select("id", "x", "w", "labels"), tuples)
    return far.group_sums(grouped, n, len(tuples), scores, schema)


def _point_scores(own: pa.Table, places: dict[tuple[int, int], int], sums_of: np.ndarray, sizes: np.ndarray):
    """Silhouettes of rows with ``labels``, from their summed distances to the clusters (labeling, label) and these one's sizes."""
    given = np.stack(own.column("labels").to_pandas().to_numpy()).astype(float)
    ids, copies = own.column("id"), own.column("w").to_numpy()
    names = pd.factorize(ids.to_pandas(), use_na_sentinel=False)[0]
    for k in range(given.shape[1]):
        columns = {label: place for (labeling, label), place in places.items() if labeling == k}
        rows = np.flatnonzero(given[:, k] != NOISE)
        if not columns or not len(rows):
            continue
        mine = given[rows, k]
        # Rows with one id, label and weight count as one.
        key = np.stack([names[rows], np.where(np.isnan(mine), np.inf, mine), copies[rows]], 1)
        _, at, group = np.unique(key, axis=0, return_index=True, return_inverse=True)
        sums = sums_of[np.ix_(rows, list(columns.values()))]
        if len(at) < len(rows):
            sums = np.stack([np.bincount(group.ravel(), column, len(at)) for column in sums.T], 1)
        else:
            at = np.arange(len(rows))
        labels = mine[at]
        score = _silhouettes(labels, sums, np.array(list(columns), float), sizes[list(columns.values())])
        yield pa.RecordBatch.from_arrays(
            [
                combined(ids.take(pa.array(rows[at]))), pa.array(np.full(len(at), k, np.int32)),
                pa.array(np.nan_to_num(labels).astype(np.int64), mask=np.isnan(labels)), pa.array(copies[rows[at]]), pa.array(score),
            ],
            names=["id", "labeling", "label", "w", "silhouette"],
        )


def _silhouettes(labels: np.ndarray, sums: np.ndarray, clusters: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Scores of points with these labels and summed distances to clusters of these sizes; 0 without another cluster."""
    own = labels[:, None] == clusters[None, :]
    size = (own * sizes).sum(1)
    with np.errstate(divide="ignore", invalid="ignore"):
        inner = np.where(own, sums, 0.0).sum(1) / (size - 1)
        outer = np.fmin.reduce(np.where(own, np.nan, sums / sizes), axis=1)
        top = np.maximum(inner, outer)
        score = (outer - inner) / top
    # Without a second cluster, or with all points in one place, there is nothing to compare.
    alone = (size <= 1) | (own.sum(1) == len(clusters)) | (top == 0)
    return np.where(alone, 0.0, score)


def silhouette(labelled: DataFrame, n: int, score: str = EUCLIDEAN) -> tuple[str, float]:
    """(metric name, mean score) over all rows, noise left out; ``score`` says which distances count, whatever the size."""
    _check_score(score)
    if score == EUCLIDEAN:
        per_point = silhouette_points(labelled, n)
        row = per_point.agg((F.sum(F.col("silhouette") * F.col("w")) / F.sum("w")).alias("s")).first()
        return EUCLIDEAN, row["s"]
    real = labelled.where(F.col("label") != NOISE).select(
        array_to_vector("x").alias("features"),
        F.col("label").cast("double").alias("prediction"),
        F.col("w").cast("double").alias("weight"),
    )
    return SQUARED, ClusteringEvaluator(weightCol="weight").evaluate(real)


def _check_score(score: str) -> None:
    if score not in (EUCLIDEAN, SQUARED):
        raise ValueError(f"score must be {EUCLIDEAN} or {SQUARED}, not {score}")


def centroids(labelled: DataFrame) -> DataFrame:
    """(label, size, centroid, spread): spread is the mean distance of members to the centroid."""
    real = labelled.where(F.col("label") != NOISE)
    centre = Summarizer.mean(array_to_vector("x"), F.col("w").cast("double"))
    centres = real.groupBy("label").agg(
        vector_to_array(centre).alias("centroid"), F.sum("w").alias("size")
    )
    away = F.sqrt(squared_distance(F.col("x"), F.col("centroid")))
    return (
        join_small(real, centres, "label")
        .groupBy("label")
        .agg(
            F.first("size").alias("size"),
            F.first("centroid").alias("centroid"),
            (F.sum(away * F.col("w")) / F.first("size")).alias("spread"),
        )
    )


def davies_bouldin(labelled: DataFrame, n_clusters: int) -> DataFrame:
    """One row: mean over clusters of the worst (spread + spread) / distance of centroids.

    Clusters whose centroids coincide do not count against each other.
    """
    found = centroids(labelled).withColumn("labeling", F.lit(0))
    return _davies_bouldin(found, n_clusters).select("davies_bouldin")


def _davies_bouldin(clusters: DataFrame, total: int) -> DataFrame:
    """(labeling, davies_bouldin) from the (labeling, label, centroid, spread) of ``total`` clusters in all."""

    def worst(a: pd.DataFrame, b: pd.DataFrame, dist: np.ndarray) -> pd.DataFrame:
        spread = a["spread"].to_numpy()[:, None] + b["spread"].to_numpy()[None, :]
        same = a["labeling"].to_numpy()[:, None] == b["labeling"].to_numpy()[None, :]
        ratios = np.divide(spread, dist, out=np.zeros_like(dist), where=(dist > 0) & same)
        return pd.DataFrame(
            {"labeling": a["labeling"].to_numpy(), "label": a["label"].to_numpy(), "worst": ratios.max(axis=1)}
        )

    def compare(a: pd.DataFrame, b: pd.DataFrame):
        dist = distances(np.stack(a["centroid"].to_numpy()), np.stack(b["centroid"].to_numpy()))
        yield worst(a, b, dist)
        yield worst(b, a, dist.T)

    given = clusters.select("labeling", F.col("label").cast("bigint").alias("label"), "centroid", "spread")
    keyed = given.withColumn("key", F.concat_ws(" ", "labeling", "label"))
    shape = "labeling int, label bigint, worst double"
    parts = over_block_pairs(keyed, "key", total, compare, shape)
    per_cluster = parts.groupBy("labeling", "label").agg(F.max("worst").alias("worst"))
    return per_cluster.groupBy("labeling").agg(F.avg("worst").alias("davies_bouldin"))


def score_clustering(labelled: DataFrame, n: int, score: str = EUCLIDEAN) -> dict[str, float] | None:
    """The metrics of a clustering, or None if it is not a valid one."""
    given = labelled.select("id", "x", "w", F.array(F.col("label").cast("bigint")).alias("labels"))
    return score_labelings(given, n, score)[0]


def score_labelings(labelled: DataFrame, n: int, score: str = EUCLIDEAN) -> list[dict[str, float] | None]:
    """The metrics of every labeling of points with ``labels``, in order; None for those that are not valid.

    Distances between points are computed once for all of them, and so are the distances to the centroids.
    """
    _check_score(score)
    rows = labelled.agg(F.coalesce(F.sum("w"), F.lit(0)).alias("rows"), F.max(F.size("labels")).alias("labelings")).first()
    each = labelled.select("x", F.col("w"), F.posexplode("labels").alias("labeling", "label")).where(F.col("label") != NOISE)
    centre = Summarizer.mean(array_to_vector("x"), F.col("w").cast("double"))
    centres = cut_lineage(
        each.groupBy("labeling", "label").agg(vector_to_array(centre).alias("centroid"), F.sum("w").alias("size"))
    )
    # One row per labeling.
    counts = {
        r["labeling"]: (r["clusters"], r["size"])
        for r in centres.groupBy("labeling").agg(F.count(F.lit(1)).alias("clusters"), F.sum("size").alias("size")).collect()
    }
    valid = [k for k in range(rows["labelings"] or 0) if 2 <= counts.get(k, (0, 0))[0] < rows["rows"]]
    if not valid:
        return [None] * (rows["labelings"] or 0)
    kept = F.col("labeling").isin(valid)
    # Sent to all tasks only where Spark finds it small.
    away = F.sqrt(squared_distance(F.col("x"), F.col("centroid")))
    spreads = each.where(kept).join(centres, ["labeling", "label"]).groupBy("labeling", "label").agg(
        F.first("centroid").alias("centroid"), (F.sum(away * F.col("w")) / F.sum("w")).alias("spread")
    )
    total = sum(counts[k][0] for k in valid)
    scatter = {r["labeling"]: r["davies_bouldin"] for r in _davies_bouldin(spreads, total).collect()}
    if score == EUCLIDEAN:
        mine = labelled.select("id", "x", "w", F.array(*[F.col("labels")[k] for k in valid]).alias("labels"))
        means = many_silhouette_points(mine, n, total).groupBy("labeling").agg(
            (F.sum(F.col("silhouette") * F.col("w")) / F.sum("w")).alias("s")
        )
        values = {valid[r["labeling"]]: r["s"] for r in means.collect()}
    else:
        values = {
            k: silhouette(labelled.select("id", "x", "w", F.col("labels")[k].alias("label")), n, score)[1] for k in valid
        }
    # The same clustering under other labels adds up in another order: what that changes does not count.
    return [
        {
            score: round(values[k], DIGITS),
            "davies_bouldin": round(scatter[k], DIGITS),
            "n_clusters": float(counts[k][0]),
            "noise_points": float(rows["rows"] - counts[k][1]),
        }
        if k in valid
        else None
        for k in range(rows["labelings"])
    ]


def projection(points: DataFrame, limit: int = LIMITS.chart_points) -> DataFrame:
    """(id, x, y): the first ``limit`` points, in id order, on the two main components.

    Components are fitted on all rows, centred, and signed so that their largest loading is
    positive. A single feature gives y = 0.
    """
    row = points.agg(
        F.max(F.size("x")).alias("d"),
        Summarizer.mean(array_to_vector("x"), F.col("w").cast("double")).alias("mean"),
    ).first()
    mean = row["mean"].toArray()

    def products(batches):
        """Weighted products of all pairs of centred columns, one matrix per task."""
        total = np.zeros((len(mean), len(mean)))
        for batch in batches:
            if batch.num_rows:
                x = np.array(batch.column("x").to_pylist()) - mean
                total += (x * batch.column("w").to_numpy()[:, None]).T @ x
        i, j = np.triu_indices(len(mean))
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(total[i, j])], names=["i", "j", "v"])

    # Copies weigh in on the components as often as they occur. At most d x d rows come back.
    spread = np.zeros((len(mean), len(mean)))
    sums = points.select("x", "w").mapInArrow(products, "i bigint, j bigint, v double").groupBy("i", "j")
    for r in sums.agg(F.sum("v").alias("v")).collect():
        spread[r["i"], r["j"]] = spread[r["j"], r["i"]] = r["v"]
    # Eigenvalues ascend.
    axes = np.linalg.eigh(spread)[1][:, ::-1][:, : min(2, row["d"])]
    axes = axes * np.where(axes[np.abs(axes).argmax(axis=0), range(axes.shape[1])] < 0, -1.0, 1.0)
    first = points.select("id", "x").orderBy("id").limit(limit)

    def along(k: int):
        if k >= axes.shape[1]:
            return F.lit(0.0)
        loadings = F.array(*[F.lit(float(v)) for v in axes[:, k]])
        shift = float(mean @ axes[:, k])
        products = F.zip_with("x", loadings, lambda a, b: a * b)
        return F.aggregate(products, F.lit(0.0), lambda s, v: s + v) - shift

    return first.select("id", along(0).alias("x"), along(1).alias("y"))
