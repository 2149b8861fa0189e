"""Packing into optimal length buckets.

Documents are cut into sequences of at most ``max_len`` tokens. The histogram of sequence lengths over the
whole table (at most ``max_len`` rows) goes to the driver, where dynamic programming chooses the bucket
boundaries that waste the least padding. Inside each bucket, sequences in order of document form batches of a
fixed token budget.

Ranks inside a bucket need no task that sees a whole bucket: documents fall into ranges of ids, the ranges are
counted per bucket, and a rank is the count of all earlier ranges plus the rank inside its own.
"""

from __future__ import annotations

from collections.abc import Mapping

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewright.llm.common import column, written

#: Sequences that one range of ids holds, about.
RANGE_ROWS = 100_000


def word_count(text: Column) -> Column:
    """Number of words, maximal runs without white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def optimal_boundaries(histogram: Mapping[int, int], buckets: int) -> list[int]:
    """Upper lengths of at most ``buckets`` buckets with the least total padding.

    A bucket pads its sequences to its longest one. Of equal sums, the lexicographically least boundaries win.
    """
    lengths = np.array(sorted(n for n, c in histogram.items() if c > 0), dtype=np.int64)
    if not len(lengths):
        return []
    counts = np.array([histogram[n] for n in lengths.tolist()], dtype=np.int64)
    upto = np.concatenate([[0], np.cumsum(counts)])
    # Padded tokens of a bucket with lengths i..j-1 are lengths[j-1] * (upto[j] - upto[i]); the tokens
    # themselves are the same for all choices.
    size = len(lengths)
    never = np.iinfo(np.int64).max // 4
    cost = np.full(size + 1, never)
    cost[0] = 0
    choices = []
    for _ in range(min(buckets, size)):
        following, choice = np.full(size + 1, never), np.zeros(size + 1, np.int64)
        for j in range(1, size + 1):
            total = cost[:j] + lengths[j - 1] * (upto[j] - upto[:j])
            choice[j] = total.argmin()
            following[j] = total[choice[j]]
        cost = following
        choices.append(choice)
    found, j = [], size
    for choice in reversed(choices):
        found.append(int(lengths[j - 1]))
        j = int(choice[j])
    return found[::-1]


def pack(
    df: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    length: Column | None = None,
    max_len: int = 2048,
    buckets: int = 16,
    batch_tokens: int = 65_536,
) -> DataFrame:
    """One row per sequence: doc_id, piece, first (token in the document), n_tokens, bucket (padded length),
    batch (number inside the bucket), place (inside the batch).

    ``length`` says how many tokens a row has; by default its words plus one end token. A batch of a bucket
    holds max(1, batch_tokens // bucket) sequences, in order of doc_id, number of tokens and piece.

    A null or empty text has one sequence with the end token. Rows with a length of 0 (own ``length``) have
    none. Null ids come first. Repeated rows are packed each; an empty table gives an empty result. Other
    columns are not looked at.
    """
    size = word_count(column(text).cast("string")) + 1 if length is None else length.cast("bigint")
    docs = written(df.select(column(doc_id).alias("doc_id"), size.alias("n")), "pack-lengths")
    cuts = F.sequence(F.lit(0).cast("bigint"), F.expr(f"(n - 1) div {max_len}"))
    pieces = docs.where("n > 0").select("doc_id", "n", F.explode(cuts).alias("piece"))
    pieces = pieces.select(
        "doc_id",
        "n",
        "piece",
        (F.col("piece") * max_len).alias("first"),
        F.least(F.lit(max_len).cast("bigint"), F.col("n") - F.col("piece") * max_len).alias("n_tokens"),
    )
    # At most max_len rows, whatever the size of the table.
    histogram = {r["n_tokens"]: r["count"] for r in pieces.groupBy("n_tokens").count().collect()}
    bounds = optimal_boundaries(histogram, buckets)
    bucket = F.lit(bounds[-1] if bounds else 0)
    for bound in reversed(bounds[:-1]):
        bucket = F.when(F.col("n_tokens") <= bound, F.lit(bound)).otherwise(bucket)
    pieces = pieces.withColumn("bucket", bucket.cast("bigint"))

    total = sum(histogram.values())
    ranges = max(1, total // RANGE_ROWS)
    spread = pieces.repartitionByRange(ranges, "doc_id", "n", "piece").withColumn("part", F.spark_partition_id())
    spread = written(spread, "pack-ranges")
    counted = spread.groupBy("bucket", "part").count()
    # One row per bucket and range of ids.
    earlier = Window.partitionBy("bucket").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = counted.select("bucket", "part", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("before"))
    inside = Window.partitionBy("bucket", "part").orderBy("doc_id", "n", "piece")
    ranked = spread.withColumn("own", F.row_number().over(inside) - 1).join(before, ["bucket", "part"])
    rank = F.col("own") + F.col("before")
    capacity = F.greatest(F.lit(1).cast("bigint"), F.expr(f"{batch_tokens} div bucket"))
    return ranked.select(
        "doc_id",
        "piece",
        "first",
        "n_tokens",
        "bucket",
        F.floor(rank / capacity).cast("bigint").alias("batch"),
        (rank % capacity).cast("bigint").alias("place"),
    )
