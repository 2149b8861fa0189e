"""Agglomerative clustering in rounds of mutual nearest neighbours.

The table is first cut into a number of micro-clusters that the caller names (each distinct point its own one if there
are no more). What the linkages need of them is one row per pair: the sum of the distances, or squared distances, of
their members, which add up when clusters merge. A round finds every cluster's nearest one and merges all pairs that
name each other. Both linkages are reducible: a merge brings nobody nearer to the merged pair than it was to one of
them, so these are the merges that taking the nearest pair at a time would make, only in another order. Sorted
by height they are the tree, and a cut leaves out the last ones. The last few clusters, a bounded number, are merged on
the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.functions.storage import cut_lineage
from tablewright.operators.clusters import centroids, cluster_distance_sums
from tablewright.operators.points import distances, over_block_pairs, spread_out
from tablewright.types import SEED

# Micro-clusters, unless the caller names another number.
MICRO_CLUSTERS = 1024
# Clusters that are few enough to be merged on the driver, one pair at a time.
LAST = 64
LINKAGES = ("ward", "average")


@dataclass
class MicroClusters:
    """Points with their micro-cluster (column ``label``), and (label, size, centroid) of those."""

    labelled: DataFrame
    summary: DataFrame
    count: int
    n: int


def micro_clusters(points: DataFrame, n: int, m: int = MICRO_CLUSTERS) -> MicroClusters:
    """At most ``m`` micro-clusters of ``n`` distinct points."""
    if n <= m:
        # At most m rows: their positions in id order are the micro-clusters.
        ids = [r["id"] for r in points.select("id").orderBy("id").collect()]
        index = points.sparkSession.createDataFrame(
            list(enumerate(ids)), f"label bigint, id {points.schema['id'].dataType.simpleString()}"
        )
        labelled = points.join(F.broadcast(index), "id").select("id", "x", "w", "label")
    else:
        vectors = spread_out(points, n).select("*", array_to_vector("x").alias("_v"), F.col("w").cast("double").alias("_w"))
        model = KMeans(k=m, seed=SEED, featuresCol="_v", weightCol="_w", predictionCol="_p").fit(vectors)
        labelled = model.transform(vectors).select(
            "id", "x", "w", F.col("_p").cast("bigint").alias("label")
        )
    labelled = cut_lineage(labelled)
    summary = cut_lineage(centroids(labelled).select("label", "size", "centroid"))
    return MicroClusters(labelled, summary, summary.count(), n)


def pair_sums(micro: MicroClusters, linkage: str) -> DataFrame:
    """(a, b, total), both ways for every pair of micro-clusters: what adds up when clusters merge.

    For average linkage, the sum of all distances between members; for Ward's, the product of the sizes and the squared
    distance of the centroids.
    """
    if linkage == "average":
        sums = cluster_distance_sums(micro.labelled, micro.n)
        return sums.where("label <> other").select(F.col("label").alias("a"), F.col("other").alias("b"), "total")

    def compare(a: pd.DataFrame, b: pd.DataFrame):
        gaps = distances(np.stack(a["centroid"].to_numpy()), np.stack(b["centroid"].to_numpy())) ** 2
        total = gaps * a["size"].to_numpy()[:, None] * b["size"].to_numpy()[None, :]
        first, second = np.meshgrid(a["label"].to_numpy(), b["label"].to_numpy(), indexing="ij")
        yield pd.DataFrame({"a": first.ravel(), "b": second.ravel(), "total": total.ravel()})
        yield pd.DataFrame({"a": second.ravel(), "b": first.ravel(), "total": total.ravel()})

    shape = "a bigint, b bigint, total double"
    return over_block_pairs(micro.summary, "label", micro.count, compare, shape).where("a <> b")


def merge(micro: MicroClusters, ks: list[int], linkage: str, last: int = LAST) -> dict[int, DataFrame]:
    """{k: (label, cluster)} of the micro-clusters after merging the closest two until k are left, for each k there can be.

    The pairs stay in Spark; the driver keeps a size and a number or two per micro-cluster.
    """
    spark = micro.labelled.sparkSession
    pairs = cut_lineage(pair_sums(micro, linkage))
    # Size, and the sum over all pairs of members that ``pairs`` no longer holds.
    state = {r["label"]: (float(r["size"]), 0.0) for r in micro.summary.collect()}
    labels, merges = sorted(state), []
    while len(state) > max(last, 1):
        sizes = spark.createDataFrame([(v, *s) for v, s in state.items()], "label bigint, size double, inner double")
        near = pairs.join(F.broadcast(sizes.toDF("a", "na", "ia")), "a").join(F.broadcast(sizes.toDF("b", "nb", "ib")), "b")
        # A tie goes to the pair with the least labels, so that both sides see the same one.
        order = F.struct(_height(linkage).alias("height"), F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi"))
        best = near.groupBy("a").agg(F.min(F.struct(order.alias("order"), "total", "b")).alias("best"))
        nearest = {r["a"]: r["best"] for r in best.collect()}
        mutual = [(a, n["b"], n) for a, n in nearest.items() if a < n["b"] and nearest[n["b"]]["b"] == a]
        for kept, gone, n in mutual:
            (size, inner), (other, own) = state[kept], state.pop(gone)
            state[kept] = (size + other, inner + own + n["total"])
            merges.append((n["order"]["height"], kept, gone))
        names = spark.createDataFrame([(gone, kept) for kept, gone, _ in mutual], "gone bigint, kept bigint")
        renamed = pairs.join(F.broadcast(names.toDF("a", "x")), "a", "left").join(F.broadcast(names.toDF("b", "y")), "b", "left")
        renamed = renamed.select(F.coalesce("x", "a").alias("a"), F.coalesce("y", "b").alias("b"), "total").where("a <> b")
        pairs = cut_lineage(renamed.groupBy("a", "b").agg(F.sum("total").alias("total")))
    merges += _last_merges(pairs, state, linkage)
    found = {}
    for k in ks:
        if k <= micro.count:
            of = _cut(labels, merges, k)
            found[k] = spark.createDataFrame(list(of.items()), "label bigint, cluster bigint")
    return found


def _height(linkage: str):
    """What merging costs: the mean distance, or the growth of the squared errors.

    The squared distance of two centroids is the mean squared distance between members, less that inside each.
    """
    mean = F.col("total") / (F.col("na") * F.col("nb"))
    if linkage == "average":
        return mean
    # The same number from both sides, to the last bit.
    spread = F.col("ia") / (F.col("na") * F.col("na")) + F.col("ib") / (F.col("nb") * F.col("nb"))
    return F.col("na") * F.col("nb") / (F.col("na") + F.col("nb")) * (mean - spread)


def _last_merges(pairs: DataFrame, state: dict[int, tuple[float, float]], linkage: str) -> list[tuple[float, int, int]]:
    """(height, kept, gone) of merging all that is left, at most LAST clusters, nearest pair first."""
    names = sorted(state)
    at = {label: i for i, label in enumerate(names)}
    size, inner = (np.array([state[v][k] for v in names]) for k in (0, 1))
    total = np.zeros((len(names), len(names)))
    for r in pairs.collect():
        total[at[r["a"]], at[r["b"]]] = r["total"]
    alive, merges = list(range(len(names))), []
    while len(alive) > 1:
        here = np.ix_(alive, alive)
        n = size[alive]
        height = total[here] / np.outer(n, n)
        if linkage == "ward":
            spread = inner[alive] / n**2
            height = (height - np.add.outer(spread, spread)) * np.outer(n, n) / np.add.outer(n, n)
        np.fill_diagonal(height, np.inf)
        i, j = sorted(divmod(int(height.argmin()), len(alive)))
        a, b = alive[i], alive[j]
        merges.append((float(height[i, j]), names[a], names[b]))
        inner[a] += inner[b] + total[a, b]
        size[a] += size[b]
        total[a] += total[b]
        total[:, a] += total[:, b]
        total[a, a] = 0.0
        alive.pop(j)
    return merges


def _cut(labels: list[int], merges: list[tuple[float, int, int]], k: int) -> dict[int, int]:
    """{label: cluster}, numbered by their least labels, after all but the k - 1 highest merges.

    A merge is listed behind those that made its two sides, so a stable order by height keeps it behind them.
    """
    parent = {v: v for v in labels}

    def root(v):
        while parent[v] != v:
            parent[v] = parent[parent[v]]
            v = parent[v]
        return v

    # Rounding can put a merge below one of its parts by a trifle: it is no lower than the higher of them.
    top: dict[int, float] = {}
    ordered = []
    for height, kept, gone in merges:
        raised = max(height, top.get(kept, height), top.get(gone, height))
        top[kept] = raised
        ordered.append((raised, len(ordered), kept, gone))
    for _, _, kept, gone in sorted(ordered)[: len(labels) - k]:
        parent[root(gone)] = root(kept)
    numbers: dict[int, int] = {}
    return {v: numbers.setdefault(root(v), len(numbers)) for v in labels}


def labels_for(micro: MicroClusters, clusters: DataFrame) -> DataFrame:
    """(id, x, w, label) with each micro-cluster replaced by its cluster."""
    joined = micro.labelled.join(clusters, "label")
    return joined.select("id", "x", "w", F.col("cluster").alias("label"))
