"""Connected components of an edge table by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.functions.storage import cut_lineage


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    moved = both.where(F.col("v") > F.col("u")).join(least, "u")
    return moved.select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u")
    leaves = moved.where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    hubs = least.select("u", F.col("m").alias("v"))
    return leaves.unionByName(hubs).distinct()


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(
        F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("h")
    ).first()
    return row["n"], row["h"]


def connected_components(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(v, root) for every vertex; the root is the least vertex of its component.

    ``vertices`` has a column v, ``edges`` columns u and v. Rounds grow with the logarithm of the
    longest path; each one is written to the shared folder before the next.
    """
    current = cut_lineage(edges.where(F.col("u") != F.col("v")).select("u", "v").distinct())
    state = _state(current)
    while state[0]:
        current = cut_lineage(_small_star(_large_star(current)))
        following = _state(current)
        if following == state:
            break
        state = following
    roots = current.select(F.col("u").alias("v"), F.col("v").alias("root"))
    return vertices.select("v").join(roots, "v", "left").select(
        "v", F.coalesce("root", "v").alias("root")
    )
