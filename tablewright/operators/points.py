"""Points: one row per distinct position, (id, x array<double>, w bigint copies)."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewright.functions.expressions import col, order_key
from tablewright.functions.storage import cut_lineage
from tablewright.operators.prepare import FEATURES

# Columns beside the caller's own, under names that those do not have.
_KEY, _COPIES = "__id__", "__copies__"
# Rows of one block; a task holds the distances between two blocks.
BLOCK_ROWS = 2048
# Points that stay as they were read, and those of one task of a search over more.
FEW_POINTS, TASK_POINTS = 50_000, 25_000
# Dimensions whose distances are written out one by one.
WRITTEN_OUT = 8


def points_of(rows: DataFrame, names: list[str], prepared: PipelineModel | None = None) -> DataFrame:
    """Collapse equal rows and number them by content, so copies never make a group hot.

    ``prepared`` scales them; if it also predicts, the prediction comes along. The columns may have any names.
    """
    grouped = rows.groupBy(*[col(n) for n in names]).agg(F.count(F.lit(1)).alias(_COPIES))
    keyed = grouped.withColumn(_KEY, order_key(names))
    named = [F.col(_KEY).alias("id"), F.col(_COPIES).alias("w")]
    if prepared is None:
        x = F.array(*[col(n).cast("double") for n in names])
        return keyed.select(named[0], x.alias("x"), named[1])
    vectors = prepared.transform(keyed)
    labels = ["prediction"] if "prediction" in vectors.columns and "prediction" not in names else []
    return vectors.select(named[0], vector_to_array(FEATURES).alias("x"), named[1], *labels)


def dealt(rows: DataFrame) -> DataFrame:
    """The rows with ``id``, spread by it over as many tasks as an exchange has, whatever files they come from."""
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(tasks, F.xxhash64("id"))


def spread_out(points: DataFrame, n: int) -> DataFrame:
    """Many points, written once and in as many tasks as they are worth: a search reads them again and again."""
    if n <= FEW_POINTS:
        return points
    most = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cut_lineage(points.repartition(max(1, min(most, math.ceil(n / TASK_POINTS))), F.xxhash64("id")))


def squared_distance(a: Column, b: Column, d: int | None = None) -> Column:
    """``d`` is the number of dimensions, if known: few of them are written out, as Spark compiles no loops over arrays."""
    if d is not None and 0 < d <= WRITTEN_OUT:
        gaps = [F.get(a, F.lit(j)) - F.get(b, F.lit(j)) for j in range(d)]
        return reduce(lambda s, v: s + v * v, gaps, F.lit(0.0))
    parts = F.zip_with(a, b, lambda p, q: (p - q) * (p - q))
    return F.aggregate(parts, F.lit(0.0), lambda s, v: s + v)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of two blocks, summed one dimension at a time."""
    total = np.zeros((len(a), len(b)))
    for j in range(a.shape[1]):
        total += (a[:, j, None] - b[None, :, j]) ** 2
    return np.sqrt(total)


def over_block_pairs(
    rows: DataFrame,
    id_column: str,
    n: int,
    compare: Callable[[pd.DataFrame, pd.DataFrame], Iterator[pd.DataFrame]],
    schema: str,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Run ``compare`` once for every unordered pair of row blocks, a block with itself included.

    For work that needs every distance: each task sees two bounded blocks and returns sums, so
    pairs of rows are never written out and no task grows with the table.
    """
    blocks = max(1, math.ceil(n / block_rows))
    block = F.pmod(F.xxhash64(id_column), F.lit(blocks)).cast("int")
    spread = rows.withColumn("_block", block).withColumn(
        "_other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    )
    paired = spread.select(
        "*",
        F.least("_block", "_other").alias("_i"),
        F.greatest("_block", "_other").alias("_j"),
    )

    names = [part.split()[0] for part in schema.split(",")]

    def run(key, group):
        first = group[group["_block"] == key[0]]
        if key[0] == key[1]:
            parts = list(compare(first, first))[:1]
        else:
            second = group[group["_block"] == key[1]]
            parts = list(compare(first, second)) if len(first) and len(second) else []
        return pd.concat(parts, ignore_index=True) if parts else pd.DataFrame(columns=names)

    return paired.groupBy("_i", "_j").applyInPandas(run, schema)


def dense_numbers(df: DataFrame, name: str, out: str) -> DataFrame:
    """Add 0-based positions in the order of a unique column, without one task sorting it all."""
    return running_sums(df.withColumn("_one", F.lit(1).cast("bigint")), name, "_one", out).drop("_one")


def running_sums(df: DataFrame, name: str, value: str, out: str) -> DataFrame:
    """Add the sum of ``value`` over all rows before, in the order of a unique column, without one task sorting it all."""
    placed = cut_lineage(
        df.repartitionByRange(F.col(name)).withColumn("_part", F.spark_partition_id())
    )
    sums = placed.groupBy("_part").agg(F.sum(value).alias("_n"))
    # One row per partition.
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    earlier = Window.partitionBy("_part").orderBy(name).rowsBetween(Window.unboundedPreceding, -1)
    inside = F.coalesce(F.sum(value).over(earlier), F.lit(0))
    return (
        placed.withColumn("_inside", inside)
        .join(F.broadcast(offsets), "_part")
        .withColumn(out, (F.col("_before") + F.col("_inside")).cast("bigint"))
        .drop("_part", "_inside", "_before")
    )
