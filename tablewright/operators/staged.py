"""Predictions of parts of a tree ensemble: its first trees, cut at a depth.

One large ensemble holds the smaller ones of a grid: boosting with fewer rounds is its first trees, a forest with
fewer trees is some of its trees, a lower depth limit is the same tree cut off. So a fold is fitted once, at the
largest values, and every smaller grid point is read off the nodes, all points in one scan.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.functions.storage import scratch_path
from tablewright.operators.pairs import combined, vectors

#: Feature values that a step of the walk holds at once.
CELLS = 4_000_000
#: Places (row and tree) that a step of the walk holds at once.
PLACES = 2_000_000


@dataclass(frozen=True)
class Part:
    """The first ``trees`` trees, cut at ``depth`` (None: as they are)."""

    trees: int
    depth: int | None = None


@dataclass(frozen=True)
class Nodes:
    """All nodes of an ensemble, tree after tree.

    ``threshold`` decides a split on a number; a split on a category looks into ``goes_left`` from ``first`` on, which is -1
    for numbers. ``feature`` is -1 for leaves. ``values`` has one row of outputs per node.
    """

    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    first: np.ndarray
    goes_left: np.ndarray
    left: np.ndarray
    right: np.ndarray
    values: np.ndarray

    def walk(self, x: np.ndarray, depths: Sequence[int | None]) -> dict[int | None, np.ndarray]:
        """For each depth limit, the node of every row (first axis) in every tree."""
        at = np.repeat(self.roots[None, :], len(x), axis=0)
        rows = np.arange(len(x))[:, None]
        found, level = {}, 0
        while True:
            if level in depths:
                found[level] = at
            feature = self.feature[at]
            inner = feature >= 0
            if not inner.any() or len(found) == len(set(depths)):
                return {d: found.get(d, at) for d in depths}
            value = x[rows, np.maximum(feature, 0)]
            first = self.first[at]
            goes = value <= self.threshold[at]
            listed = first >= 0
            if listed.any():
                goes = np.where(listed, self.goes_left[np.where(listed, first + value.astype(np.int64), 0)], goes)
            at = np.where(inner, np.where(goes, self.left[at], self.right[at]), at)
            level += 1


def read_nodes(spark: SparkSession, model, votes: bool) -> Nodes:
    """The nodes of a fitted ensemble, from its saved form; ``votes`` asks for class shares instead of predictions."""
    path = scratch_path(spark, "trees")
    model.write().save(path)
    node = F.col("nodeData")
    given = (node.impurityStats if votes else node.prediction).alias("value")
    rows = spark.read.parquet(f"{path}/data").select(
        "treeID", node.id.alias("id"), given, node.leftChild.alias("left"), node.rightChild.alias("right"),
        node.split.featureIndex.alias("feature"), node.split.leftCategoriesOrThreshold.alias("split"),
        node.split.numCategories.alias("categories"),
    )
    # No larger than the fitted model, which the driver holds anyway; columns, as there are millions of nodes.
    table = rows.toArrow().sort_by([("treeID", "ascending"), ("id", "ascending")])
    column = lambda name: table.column(name).to_numpy()
    tree = column("treeID")
    # Ids count from 0 in every tree, so they are offsets from its root.
    starts = np.searchsorted(tree, np.arange(tree.max() + 1))
    base = starts[tree]
    inner = column("left") >= 0
    categories = np.where(inner, column("categories"), -1)
    splits = combined(table.column("split"))
    threshold = np.zeros(len(tree))
    numbers = np.flatnonzero(inner & (categories < 0))
    threshold[numbers] = splits.take(pa.array(numbers)).flatten().to_numpy()
    # One flag per category of each split on one, node after node.
    first = np.full(len(tree), -1, np.int64)
    listed = np.flatnonzero(categories >= 0)
    ends = np.cumsum(categories[listed], dtype=np.int64)
    first[listed] = ends - categories[listed]
    goes_left = np.zeros(int(ends[-1]) if len(ends) else 1, bool)
    lefts = splits.take(pa.array(listed))
    at = np.repeat(first[listed], pc.list_value_length(lefts).to_numpy())
    goes_left[at + lefts.flatten().to_numpy().astype(np.int64)] = True
    if votes:
        values = vectors(combined(table.column("value")))
        values = values / np.maximum(values.sum(1, keepdims=True), 1e-300)
    else:
        values = column("value")[:, None]
    return Nodes(
        starts, np.where(inner, column("feature"), -1), threshold, first, goes_left,
        np.where(inner, base + column("left"), 0), np.where(inner, base + column("right"), 0), values,
    )


def _mean(outputs: np.ndarray) -> np.ndarray:
    return outputs[:, :, 0].mean(1)


def _most(outputs: np.ndarray) -> np.ndarray:
    return outputs.sum(1).argmax(1).astype(float)


@dataclass(frozen=True)
class Ensemble:
    """Nodes, one weight per tree, and how the outputs (rows x trees x values) of some trees make predictions."""

    nodes: list[Nodes]
    weights: list[np.ndarray]
    join: Callable[[list[np.ndarray]], np.ndarray]

    def predict(self, x: np.ndarray, parts: Sequence[Part]) -> list[np.ndarray]:
        depths = [p.depth for p in parts]
        walks = [nodes.walk(x, depths) for nodes in self.nodes]
        made = []
        for part in parts:
            outputs = []
            for nodes, weights, walk in zip(self.nodes, self.weights, walks):
                at = walk[part.depth][:, : part.trees]
                outputs.append(nodes.values[at] * weights[None, : part.trees, None])
            made.append(self.join(outputs))
        return made


def ensemble(spark: SparkSession, model, classes: int = 0) -> Ensemble:
    """A fitted forest or boosted model of Spark, or one boosted model per class; ``classes`` is 0 for regression."""
    if hasattr(model, "models"):
        members = list(model.models)
        return Ensemble(
            [read_nodes(spark, m, False) for m in members], [np.array(m.treeWeights) for m in members],
            lambda outputs: np.stack([o[:, :, 0].sum(1) for o in outputs], 1).argmax(1).astype(float),
        )
    forest = "RandomForest" in type(model).__name__
    nodes, weights = [read_nodes(spark, model, bool(forest and classes))], [np.array(model.treeWeights)]
    if forest:
        return Ensemble(nodes, weights, lambda outputs: (_most if classes else _mean)(outputs[0]))
    if classes:
        return Ensemble(nodes, weights, lambda outputs: (outputs[0][:, :, 0].sum(1) > 0).astype(float))
    return Ensemble(nodes, weights, lambda outputs: outputs[0][:, :, 0].sum(1))


def staged_predictions(
    rows: DataFrame, whole: Ensemble, parts: Sequence[Part], features: str, label: str
) -> DataFrame:
    """(label, predictions): per row one prediction for each of ``parts``."""
    trees = sum(len(n.roots) for n in whole.nodes)

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            flat = batch.column("x")
            width = len(flat[0])
            x = flat.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, width)
            step = max(1, min(CELLS // max(1, width), PLACES // max(1, trees)))
            for start in range(0, len(x), step):
                made = np.stack(whole.predict(x[start : start + step], parts), 1)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("y").slice(start, step), pa.array(list(made), pa.list_(pa.float64()))],
                    names=["label", "predictions"],
                )

    given = rows.select(vector_to_array(features).alias("x"), F.col(label).alias("y"))
    return given.mapInArrow(run, "label double, predictions array<double>")


def rmse_of_parts(predicted: DataFrame, parts: int) -> list[float]:
    errors = [F.sqrt(F.avg(F.pow(F.col("predictions")[k] - F.col("label"), 2))) for k in range(parts)]
    return list(predicted.agg(*[e.alias(f"e{k}") for k, e in enumerate(errors)]).first())


def f1_of_parts(predicted: DataFrame, parts: int) -> list[float]:
    """F1 per class, weighted by the rows that truly belong to it."""
    each = predicted.select("label", F.posexplode("predictions").alias("part", "guess"))
    # At most parts x classes x classes rows.
    counts = each.groupBy("part", "label", "guess").count().collect()
    found = []
    for k in range(parts):
        mine = [r for r in counts if r["part"] == k]
        total = sum(r["count"] for r in mine)
        score = 0.0
        for label in {r["label"] for r in mine}:
            support = sum(r["count"] for r in mine if r["label"] == label)
            claimed = sum(r["count"] for r in mine if r["guess"] == label)
            hits = sum(r["count"] for r in mine if r["label"] == label and r["guess"] == label)
            score += 2 * hits / (support + claimed) * support / total
        found.append(score)
    return found
