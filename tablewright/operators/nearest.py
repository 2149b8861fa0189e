"""Labels of rows that a clustering was not fitted on, from reference points that carry its labels.

Given points are (id, x); references are (x, label).
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.functions.storage import cut_lineage
from tablewright.operators.clusters import NOISE
from tablewright.operators.crowds import CROWDED, nearest_values
from tablewright.operators.points import dealt, squared_distance

# Dimensions whose cells are looked up: 3 to this power look-ups per point.
LOOKUP_DIMENSIONS = 3
# References of one cell that a task holds.
SALT_ROWS = 500_000
# Crowded cells up to which their table is broadcast.
FEW_CELLS = 100_000
# Distances that a task holds at once.
CELLS = 4_000_000


def nearest_reference(points: DataFrame, references: DataFrame) -> DataFrame:
    """(id, label) of the nearest reference, the least label on a tie.

    For references of a bounded number, such as the centroids of micro-clusters: every task gets all of them.
    """
    rows = references.select("x", "label").orderBy("label").collect()
    centres, labels = np.array([r["x"] for r in rows], float), np.array([r["label"] for r in rows], np.int64)

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            step, found = max(1, CELLS // max(1, len(centres))), []
            for at in range(0, len(x), step):
                total = np.zeros((len(x[at : at + step]), len(centres)))
                for j in range(x.shape[1]):
                    total += (x[at : at + step, j, None] - centres[None, :, j]) ** 2
                found.append(labels[total.argmin(1)])
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(np.concatenate(found))], names=["id", "label"])

    if not rows:
        return points.select("id", F.lit(NOISE).cast("bigint").alias("label"))
    kind = points.schema["id"].dataType.simpleString()
    return points.select("id", "x").mapInArrow(run, f"id {kind}, label bigint")


def nearest_within(points: DataFrame, references: DataFrame, eps: float) -> DataFrame:
    """(id, label) of the nearest reference at most ``eps`` away, the least label on a tie; noise without one.

    Both sides meet by cells as wide as ``eps`` on the first dimensions. ``id`` is unique.
    """
    width = references.select(F.max(F.size("x")).alias("d")).first()["d"]
    if not width:
        return points.select("id", F.lit(NOISE).cast("bigint").alias("label"))
    lookup = range(min(width, LOOKUP_DIMENSIONS))
    cell = lambda j: F.floor(F.col("x")[j] / eps)
    around = [
        F.array(*[cell(j) + o for j, o in zip(lookup, step, strict=True)])
        for step in itertools.product((-1, 0, 1), repeat=len(lookup))
    ]
    # Dealt out before they multiply: a file of one row group is one task.
    asked = dealt(points.select("id", "x")).select("id", "x", F.explode(F.array(*around)).alias("cell"))
    known = cut_lineage(references.select("x", "label", F.array(*[cell(j) for j in lookup]).alias("cell")))
    sizes = known.groupBy("cell").agg(F.count(F.lit(1)).alias("size"))
    sizes = cut_lineage(sizes.withColumn("salts", F.ceil(F.col("size") / SALT_ROWS).cast("int")))
    crowded = sizes.where((F.col("size") > CROWDED) & ~F.exists("cell", F.isnull)).select("cell", "salts")
    # Only this table may be sent to every task. Points are merged: what they take when written, by which Spark would
    # choose, says little about their number, as copies compress to almost nothing.
    crowded = F.broadcast(crowded) if crowded.count() <= FEW_CELLS else crowded.hint("merge")
    gap = squared_distance(F.col("x"), F.col("y"))
    few = asked.join(known.join(crowded, "cell", "left_anti").withColumnRenamed("x", "y").hint("merge"), "cell")
    near = few.select("id", F.col("label").cast("bigint").alias("label"), gap.alias("gap")).where(F.col("gap") <= eps * eps)
    # The rows of a crowded cell are not compared one by one.
    salts = F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt")
    many = asked.join(crowded, "cell").select("cell", salts, "id", "x")
    salt = F.pmod(F.xxhash64("x"), F.col("salts")).cast("int").alias("salt")
    members = known.join(crowded, "cell").select("cell", salt, "x", F.col("label").cast("bigint").alias("v"))
    near = near.unionByName(nearest_values(many, members, eps * eps))
    best = near.groupBy("id").agg(F.min(F.struct("gap", "label")).alias("best"))
    joined = points.select("id").join(best.hint("merge"), "id", "left")
    return joined.select("id", F.coalesce("best.label", F.lit(NOISE)).cast("bigint").alias("label"))
