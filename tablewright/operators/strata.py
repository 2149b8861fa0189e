"""Hold-out splits and folds in proportion to the classes, for any number of them.

Sizes, quotas and boundaries are tables with one row per class. A class's place in the order of remainders, and the sum over
all classes before it, come from ranges that are sorted and counted; a boundary is the digest of one row of its class.
The driver sees three numbers, and the boundaries of classes too large to be ranked in one task.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewright.functions.expressions import col, order_key, row_digest
from tablewright.functions.storage import cut_lineage, join_small
from tablewright.operators import splits
from tablewright.operators.points import dense_numbers, running_sums


def class_text(by: str) -> Column:
    """One text per class; missing values are a class of their own."""
    return F.when(col(by).isNull(), "-").otherwise(F.concat(F.lit("="), col(by).cast("string")))


def class_sizes(df: DataFrame, by: str) -> DataFrame:
    """(g, o, n): class, its value, its rows."""
    sizes = df.groupBy(col(by).alias("o")).agg(F.count(F.lit(1)).alias("n"))
    return cut_lineage(sizes.select(class_text("o").alias("g"), "o", "n"))


def quotas(sizes: DataFrame, fraction: float) -> DataFrame:
    """(g, n, quota): rows of the lower side, in proportion, ceil(fraction * all) in total.

    What the rounding down leaves over goes to the largest remainders, of equal ones to the first class.
    """
    rows = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    total = math.ceil(round(fraction * rows, 9))
    # Products of two row counts can pass 64 bits.
    share = F.lit(total).cast("decimal(19,0)") * F.col("n").cast("decimal(19,0)")
    whole = F.floor(share / F.lit(max(rows, 1)).cast("decimal(19,0)")).cast("bigint")
    shared = sizes.select("g", "o", "n", whole.alias("floor")).withColumn(
        "rest", share - F.col("floor").cast("decimal(19,0)") * F.lit(rows).cast("decimal(19,0)")
    )
    shared = cut_lineage(shared.withColumn("turn", F.struct((-F.col("rest")).alias("r"), "o")))
    left = total - (shared.agg(F.sum("floor").alias("s")).first()["s"] or 0)
    placed = dense_numbers(shared, "turn", "place")
    more = F.when(F.col("place") < left, 1).otherwise(0)
    return placed.select("g", "n", (F.col("floor") + more).alias("quota"))


def fold_ends(sizes: DataFrame, folds: int) -> DataFrame:
    """(g, n, ends): the last rank of every fold but the last one.

    The rows left over by the division go to consecutive folds across classes, so that the whole folds differ by at
    most one row too.
    """
    extra = (F.col("n") % folds).cast("bigint")
    turned = running_sums(sizes.withColumn("extra", extra), "o", "extra", "before")
    turn = F.col("before") % folds
    ends, upto = [], F.lit(0).cast("bigint")
    for fold in range(folds - 1):
        longer = F.when((F.lit(fold + folds) - turn) % folds < F.col("extra"), 1).otherwise(0)
        upto = upto + F.floor(F.col("n") / folds).cast("bigint") + longer
        ends.append(upto)
    return turned.select("g", "n", F.array(*ends).alias("ends"))


def assign(
    df: DataFrame, bounds: DataFrame, key: list[str] | None, seed: int, by: str, name: str
) -> DataFrame:
    """Add ``name``: how many of its class's ``ends`` (rows of (g, n, ends)) lie before the row in digest order.

    Rows that share a key are told apart by their content; copies of one row on a boundary are counted off.
    """
    names = list(df.columns)
    digest = F.concat(order_key(key or names, seed), F.lower(F.hex(row_digest(df, names))))
    keyed = df.select(class_text(by).alias("g"), digest.alias("d"))
    wanted = cut_lineage(
        bounds.select("g", "n", F.explode(F.array_distinct("ends")).alias("rank")).where("rank > 0")
    )
    cuts = cut_lineage(_ranked(keyed, wanted).unionByName(_narrowed(df, digest, by, wanted)))
    listed = cuts.groupBy("g").agg(F.collect_list(F.struct("rank", "d", "take", "ties")).alias("cuts"))
    none = F.array().cast(listed.schema["cuts"].dataType)
    known = bounds.join(listed, "g", "left").select(F.col("g").alias("_g"), "ends", F.coalesce("cuts", none).alias("cuts"))
    # A boundary for every end, also for those that coincide; ends at 0 lie before every row.
    known = cut_lineage(
        known.select(
            "_g",
            F.size(F.filter("ends", lambda e: e <= 0)).alias("_zero"),
            F.flatten(
                F.transform("ends", lambda e: F.filter("cuts", lambda c: c["rank"] == e))
            ).alias("_cuts"),
        )
    )
    rows = join_small(df.withColumn("_g", class_text(by)).withColumn("_d", digest), known, "_g")
    torn = F.exists("_cuts", lambda c: (c["d"] == F.col("_d")) & (c["take"] < c["ties"]))
    after = F.size(F.filter("_cuts", lambda c: F.col("_d") > c["d"]))
    whole = rows.where(~torn).withColumn(name, (F.col("_zero") + after).cast("int"))
    whole = whole.select(*[col(n) for n in names], name)
    if cuts.where("take < ties").isEmpty():
        return whole
    copies = rows.where(torn).groupBy(*[col(n) for n in names], "_g", "_d").agg(
        F.first("_zero").alias("_zero"), F.first("_cuts").alias("_cuts"), F.count(F.lit(1)).alias("_n")
    )
    chunk = F.lit(splits._COPIES_PER_TASK_ROW).cast("bigint")
    starts = F.sequence(F.lit(0).cast("bigint"), F.col("_n") - 1, chunk)
    dealt = copies.withColumn("_at", F.explode(starts)).repartition("_g", "_d", "_at")
    last = F.least(F.col("_n"), F.col("_at") + chunk)
    numbered = dealt.withColumn("_i", F.explode(F.sequence(F.col("_at") + 1, last)))
    beyond = F.filter("_cuts", lambda c: (F.col("_d") > c["d"]) | ((F.col("_d") == c["d"]) & (F.col("_i") > c["take"])))
    numbered = numbered.withColumn(name, (F.col("_zero") + F.size(beyond)).cast("int"))
    return whole.unionByName(numbered.select(*[col(n) for n in names], name))


def _ranked(keyed: DataFrame, wanted: DataFrame) -> DataFrame:
    """(g, rank, d, take, ties) for classes of which one task can rank the digests."""
    small = wanted.where(F.col("n") <= splits._RANK_ROWS)
    equal = keyed.join(small.select("g").distinct(), "g", "left_semi").groupBy("g", "d").agg(F.count(F.lit(1)).alias("ties"))
    order = Window.partitionBy("g").orderBy("d").rowsBetween(Window.unboundedPreceding, 0)
    running = equal.withColumn("upto", F.sum("ties").over(order))
    found = running.join(small.select("g", "rank"), "g").where(
        (F.col("rank") <= F.col("upto")) & (F.col("rank") > F.col("upto") - F.col("ties"))
    )
    return found.select("g", "rank", "d", (F.col("rank") - F.col("upto") + F.col("ties")).alias("take"), "ties")


def _narrowed(df: DataFrame, digest: Column, by: str, wanted: DataFrame) -> DataFrame:
    """The same for larger classes, by counting prefixes of digests."""
    shape = "g string, rank bigint, d string, take bigint, ties bigint"
    ranks: dict[str, list[int]] = {}
    # At most (rows / _RANK_ROWS) classes.
    for r in wanted.where(F.col("n") > splits._RANK_ROWS).collect():
        ranks.setdefault(r["g"], []).append(r["rank"])
    if not ranks:
        return df.sparkSession.createDataFrame([], shape)
    found = splits.find_cuts(df, digest, ranks, class_text(by))
    return df.sparkSession.createDataFrame([(c.group, c.rank, c.digest, c.take, c.ties) for c in found], shape)
