"""Hold-out splits and folds of exact size, without moving a row.

Rows are ordered by a seeded digest of their key. A part of the table is a range of that order, so
it is enough to know the digest at each boundary: a few counting passes over digest prefixes find
it, and the assignment itself is a comparison in the scan.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewright.functions.expressions import col, order_key, row_digest
from tablewright.types import LIMITS, SEED

# A prefix group with at most this many rows is ranked by whole digests.
_RANK_ROWS = 200_000
_PREFIX_STEP = 3
# More characters than any digest has.
_WHOLE = 128
# Copies of one row that a single task writes out.
_COPIES_PER_TASK_ROW = 10_000


@dataclass(frozen=True)
class Cut:
    """The ``rank``-th row of a group in digest order.

    ``take`` of the ``ties`` rows with this digest belong to the lower side. If that is not all
    of them, ``inner`` cuts among those rows by their whole content, and finally ``take`` counts
    identical copies.
    """

    group: str
    rank: int
    digest: str
    take: int
    ties: int
    inner: Cut | None = None


def find_cuts(df: DataFrame, digest: Column, ranks: dict[str, list[int]], group: Column) -> list[Cut]:
    """Locate 1-based ranks within each group; ``ranks`` maps group text to ranks."""
    spark = df.sparkSession
    keyed = df.select(group.cast("string").alias("g"), digest.alias("d"))
    active = [(g, r, "", r) for g, rs in ranks.items() for r in sorted(set(rs)) if r > 0]
    width, done = 0, []
    sizes: dict[tuple[str, str], int] = {}
    if active:
        sizes = {(r["g"], ""): r["n"] for r in keyed.groupBy("g").agg(
            F.count(F.lit(1)).alias("n")
        ).where(F.col("g").isin([g for g in ranks])).collect()}
    while active:
        whole = width >= 30 or max(sizes[(g, p)] for g, _, p, _ in active) <= _RANK_ROWS
        step = _WHOLE if whole else width + _PREFIX_STEP
        parents = spark.createDataFrame(
            sorted({(g, p) for g, _, p, _ in active}), "g string, parent string"
        )
        # The wanted prefixes are at most classes x boundaries rows.
        inside = keyed.withColumn("parent", F.substring("d", 1, width)).join(
            F.broadcast(parents), ["g", "parent"]
        )
        counts = inside.groupBy("g", "parent", F.substring("d", 1, step).alias("p")).agg(
            F.count(F.lit(1)).alias("n")
        )
        order = Window.partitionBy("g", "parent").orderBy("p")
        running = counts.withColumn(
            "upto", F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0))
        )
        wanted = spark.createDataFrame(active, "g string, rank bigint, parent string, rest bigint")
        found = running.join(F.broadcast(wanted), ["g", "parent"]).where(
            (F.col("upto") >= F.col("rest")) & (F.col("upto") - F.col("n") < F.col("rest"))
        ).collect()
        active, sizes = [], {}
        for r in found:
            rest = r["rest"] - (r["upto"] - r["n"])
            if whole:
                done.append(Cut(r["g"], r["rank"], r["p"], rest, r["n"]))
            else:
                active.append((r["g"], r["rank"], r["p"], rest))
                sizes[(r["g"], r["p"])] = r["n"]
        width = step
    return done


def assign_segments(
    df: DataFrame,
    ranks: dict[str, list[int]],
    key: list[str] | None = None,
    seed: int = SEED,
    by: str | None = None,
    name: str = "segment",
) -> DataFrame:
    """Add ``name``: how many of the group's boundaries lie before the row.

    Rows with ranks 1..r1 get 0, those up to r2 get 1, and so on. ``key`` should be unique; rows
    sharing a key are told apart by their content, and identical rows are counted off.
    """
    names = list(df.columns)
    digest = order_key(key or names, seed)
    content = F.lower(F.hex(row_digest(df, names)))
    group = col(by).cast("string") if by else F.lit("all")
    cuts = find_cuts(df, digest, ranks, group)
    cuts = [_refine(df, cut, digest, content, group) for cut in cuts]
    segment = F.lit(0)
    for cut in cuts:
        segment = segment + F.when(
            (group == cut.group) & _after(cut, digest, content), 1
        ).otherwise(0)
    split = [c for c in map(_innermost, cuts) if c.take < c.ties]
    if not split:
        return df.withColumn(name, segment)
    torn = F.lit(False)
    for cut in cuts:
        last = _innermost(cut)
        if last.take < last.ties:
            at = (group == cut.group) & (digest == cut.digest)
            torn = torn | (at & (content == last.digest) if cut.inner else at)
    whole = df.where(~torn).withColumn(name, segment)
    return whole.unionByName(_count_off(df.where(torn), names, cuts, digest, content, group, name))


def _refine(df: DataFrame, cut: Cut, digest: Column, content: Column, group: Column) -> Cut:
    if cut.take == cut.ties:
        return cut
    tied = df.where((group == cut.group) & (digest == cut.digest))
    inner = find_cuts(tied, content, {cut.group: [cut.take]}, group)[0]
    return Cut(cut.group, cut.rank, cut.digest, cut.take, cut.ties, inner)


def _innermost(cut: Cut) -> Cut:
    return cut.inner or cut


def _after(cut: Cut, digest: Column, content: Column) -> Column:
    if cut.inner is None:
        return digest > cut.digest
    return (digest > cut.digest) | ((digest == cut.digest) & (content > cut.inner.digest))


def _count_off(df, names, cuts, digest, content, group, name) -> DataFrame:
    """Copies of a row on a boundary: collapsed, numbered by arithmetic, spread out again."""
    copies = df.groupBy(*[col(n) for n in names]).agg(F.count(F.lit(1)).alias("_n"))
    chunk = F.lit(_COPIES_PER_TASK_ROW)
    chunks = copies.withColumn(
        "_chunk", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("_n") - 1) / chunk)))
    ).repartition(F.col("_chunk"), *[col(n) for n in names])
    numbered = chunks.withColumn(
        "_i",
        F.explode(
            F.sequence(
                F.col("_chunk") * chunk + 1, F.least(F.col("_n"), (F.col("_chunk") + 1) * chunk)
            )
        ),
    )
    segment = F.lit(0)
    for cut in cuts:
        last = _innermost(cut)
        at = (group == cut.group) & (digest == cut.digest)
        if cut.inner:
            at = at & (content == last.digest)
        beyond = F.when(at, F.col("_i") > last.take).otherwise(_after(cut, digest, content))
        segment = segment + F.when((group == cut.group) & beyond, 1).otherwise(0)
    return numbered.withColumn(name, segment).select(*[col(n) for n in names], name)


def test_quotas(sizes: dict[str, int], fraction: float = LIMITS.test_fraction) -> dict[str, int]:
    """Test rows per class: proportional, largest remainders first, ceil(fraction * n) in all."""
    n = sum(sizes.values())
    total = math.ceil(round(fraction * n, 9))
    quota = {g: total * size // n for g, size in sizes.items()}
    remainder = {g: total * size % n for g, size in sizes.items()}
    left = total - sum(quota.values())
    for g in sorted(sizes, key=lambda g: (-remainder[g], list(sizes).index(g)))[:left]:
        quota[g] += 1
    return quota


def fold_ends(rows: int, n_folds: int) -> list[int]:
    """The last rank of every fold but the last; sizes differ by at most one row, the first ones are longer."""
    base, extra = divmod(rows, n_folds)
    return [base * (f + 1) + min(f + 1, extra) for f in range(n_folds - 1)]


def holdout(
    df: DataFrame,
    key: list[str] | None = None,
    by: str | None = None,
    fraction: float = LIMITS.test_fraction,
    seed: int = SEED,
) -> DataFrame:
    """Add ``is_test``: exactly ceil(fraction * n) rows, per class in proportion if ``by``, however many classes."""
    if by:
        from tablewright.operators import strata

        bounds = strata.quotas(strata.class_sizes(df, by), fraction)
        bounds = bounds.select("g", "n", F.array("quota").alias("ends"))
        split = strata.assign(df, bounds, key, seed, by, "_segment")
        return split.withColumn("is_test", F.col("_segment") == 0).drop("_segment")
    quota = math.ceil(round(fraction * df.count(), 9))
    split = assign_segments(df, {"all": [quota]} if quota else {}, key, seed, None, "_segment")
    return split.withColumn("is_test", (F.col("_segment") == 0) & F.lit(quota > 0)).drop("_segment")


def holdout_by_threshold(
    df: DataFrame, key: list[str], fraction: float = LIMITS.test_fraction, seed: int = SEED
) -> DataFrame:
    """Add ``is_test`` from the digest alone: no job at all, the size right only on average."""
    bucket = F.conv(F.substring(order_key(key, seed), 1, 8), 16, 10).cast("double")
    return df.withColumn("is_test", bucket < fraction * 16**8)


def folds(
    df: DataFrame,
    key: list[str] | None = None,
    by: str | None = None,
    n_folds: int = LIMITS.folds,
    seed: int = SEED,
) -> DataFrame:
    """Add ``fold`` 0..n-1: consecutive ranges of the order, sizes within one row of each other."""
    if by:
        from tablewright.operators import strata

        bounds = strata.fold_ends(strata.class_sizes(df, by), n_folds)
        return strata.assign(df, bounds, key, seed, by, "fold")
    ends = fold_ends(df.count(), n_folds)
    # Ends at 0 lie before every row; ends that coincide leave a fold between them empty.
    ranks = sorted({e for e in ends if e > 0})
    split = assign_segments(df, {"all": ranks}, key, seed, None, "_segment")
    passed = F.array(*[F.lit(sum(e <= (ranks[i - 1] if i else 0) for e in ends)) for i in range(len(ranks) + 1)])
    return split.withColumn("fold", F.element_at(passed, F.col("_segment") + 1).cast("int")).drop("_segment")
