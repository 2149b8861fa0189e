"""Column profile, summaries, histograms, frequencies, duplicates and correlation."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewright.functions.expressions import (
    all_present,
    col,
    finite,
    grouping_key,
    percentage,
    ratio,
)
from tablewright.operators.quantiles import exact_quantiles, sketch_points, start_brackets
from tablewright.operators.values import columns_frame, is_missing, numeric_value, value_counts
from tablewright.types import CATEGORICAL, LIMITS, NUMERIC, categorical_columns, numeric_columns

QUARTILES = [0.25, 0.5, 0.75]
# Linear-counting estimate that a column with `discrete_max` values cannot exceed.
_DISCRETE_ESTIMATE = LIMITS.discrete_max + 1
# More numeric columns than this are correlated through per-task matrix products: the number of
# aggregates grows with its square, and generated code stops compiling well.
_WIDE = 5


def column_profile(df: DataFrame, approx: bool = False, counts: DataFrame | None = None) -> DataFrame:
    """Per column: kind, type, missing count and percentage, distinct values.

    ``approx`` replaces the exact distinct counts (one shuffle) by sketches (none).
    """
    columns = columns_frame(df)
    if approx:
        stats = _approx_stats(df)
    else:
        counts = value_counts(df, identity_only=True) if counts is None else counts
        stats = counts.groupBy("ordinal").agg(
            F.sum(F.when(is_missing(), F.col("n")).otherwise(0)).alias("missing"),
            F.count_if(~is_missing()).alias("uniques"),
            F.sum("n").alias("rows"),
        )
    joined = columns.join(stats, "ordinal", "left")
    missing, rows = F.coalesce("missing", F.lit(0)), F.coalesce("rows", F.lit(0))
    return joined.select(
        "ordinal",
        "column",
        "kind",
        "physical_type",
        rows.cast("bigint").alias("row_count"),
        missing.cast("bigint").alias("missing_count"),
        percentage(missing, rows).alias("missing_percentage"),
        F.coalesce("uniques", F.lit(0)).cast("bigint").alias("unique_count"),
    )


def _approx_stats(df: DataFrame) -> DataFrame:
    aggs = [F.count(F.lit(1)).alias("rows")]
    cells: list[Column] = []
    for i, name in enumerate(df.columns):
        aggs += [
            F.count_if(col(name).isNull()).alias(f"m{i}"),
            F.approx_count_distinct(col(name)).alias(f"u{i}"),
        ]
        cells += [F.lit(i), F.col(f"m{i}"), F.col(f"u{i}"), F.col("rows")]
    wide = df.agg(*aggs)
    return wide.select(
        F.stack(F.lit(len(df.columns)), *cells).alias("ordinal", "missing", "uniques", "rows")
    )


def duplicate_rows(df: DataFrame, names: list[str] | None = None) -> DataFrame:
    """One row: total rows, distinct rows and rows that repeat an earlier one."""
    groups = df.groupBy(*grouping_key(df, names or df.columns)).agg(F.count(F.lit(1)).alias("n"))
    return groups.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("row_count"),
        F.count(F.lit(1)).alias("distinct_rows"),
        (F.coalesce(F.sum("n"), F.lit(0)) - F.count(F.lit(1))).alias("duplicate_row_count"),
    )


def dataset_dims(df: DataFrame) -> DataFrame:
    """One row: rows, columns and missing cells. A single scan, no shuffle of rows."""
    missing = sum((F.count_if(col(n).isNull()) for n in df.columns), F.lit(0))
    return df.agg(
        F.count(F.lit(1)).alias("row_count"),
        F.lit(len(df.columns)).cast("bigint").alias("column_count"),
        missing.cast("bigint").alias("missing_cells"),
    )


def numeric_summary(df: DataFrame, approx: bool = False) -> DataFrame:
    """count, mean, sample deviation, min, quartiles, max of each non-empty numeric column."""
    names = numeric_columns(df)
    points = QUARTILES if approx else sketch_points(QUARTILES)
    aggs = []
    for i, name in enumerate(names):
        value = col(name).cast("double")
        aggs += [
            F.count(value).alias(f"n{i}"),
            F.avg(value).alias(f"mean{i}"),
            F.when(F.count(value) > 1, F.stddev_samp(value)).alias(f"std{i}"),
            F.min(value).alias(f"min{i}"),
            F.max(value).alias(f"max{i}"),
            F.percentile_approx(value, points, 10_000).alias(f"p{i}"),
        ]
    row = df.agg(*aggs).first() if names else {}
    filled = [(i, name) for i, name in enumerate(names) if row[f"n{i}"]]
    if approx:
        quartiles = {(n, q): row[f"p{i}"][j] for i, n in filled for j, q in enumerate(QUARTILES)}
    else:
        brackets, extremes = [], {}
        for i, name in filled:
            lowest, highest = row[f"min{i}"], row[f"max{i}"]
            extremes[name] = (lowest, highest)
            brackets += start_brackets(name, row[f"n{i}"], lowest, highest, QUARTILES, row[f"p{i}"])
        quartiles = exact_quantiles(df, brackets, extremes)
    rows = []
    for i, name in filled:
        std = row[f"std{i}"]
        rows.append(
            (
                name,
                row[f"n{i}"],
                row[f"mean{i}"],
                std if std is not None and np.isfinite(std) else None,
                row[f"min{i}"],
                *[quartiles[(name, q)] for q in QUARTILES],
                row[f"max{i}"],
            )
        )
    schema = (
        "column string, count bigint, mean double, std double, min double, "
        "q25 double, median double, q75 double, max double"
    )
    return df.sparkSession.createDataFrame(rows, schema)


def histograms(df: DataFrame, bins: int = LIMITS.histogram_bins) -> DataFrame:
    """Bins of every numeric column worth charting, empty bins included.

    Up to twelve distinct values give one bin each; otherwise the range is cut into equal widths.
    Columns with fewer than two values, or values all close to each other, give nothing.
    """
    names = numeric_columns(df)
    aggs = []
    for i, name in enumerate(names):
        value = col(name).cast("double")
        aggs += [
            F.count(value).alias(f"n{i}"),
            F.min(value).alias(f"lo{i}"),
            F.max(value).alias(f"hi{i}"),
            F.approx_count_distinct(value).alias(f"u{i}"),
        ]
    row = df.agg(*aggs).first() if names else {}
    ranges, few = {}, []
    for i, name in enumerate(names):
        n, lo, hi = row[f"n{i}"], row[f"lo{i}"], row[f"hi{i}"]
        if n < 2 or abs(hi - lo) <= 1e-8 + 1e-5 * abs(lo):
            continue
        ranges[name] = (lo, hi)
        if row[f"u{i}"] <= _DISCRETE_ESTIMATE:
            few.append(name)
    discrete = discrete_bins(df, few)
    uncut = {r["column"] for r in discrete.select("column").distinct().collect()} if few else set()
    widths = {n: r for n, r in ranges.items() if n not in uncut}
    return discrete.unionByName(equal_width_bins(df, widths, bins))


def discrete_bins(df: DataFrame, names: list[str]) -> DataFrame:
    """One bin per value for those named columns that have at most twelve values."""
    counts = value_counts(df, names).where(~is_missing())
    values = counts.groupBy("ordinal", numeric_value().alias("v")).agg(F.sum("n").alias("n"))
    # One value more than allowed is enough to see that a column does not qualify.
    place = F.row_number().over(Window.partitionBy("ordinal").orderBy("v"))
    first = values.withColumn("place", place).where(F.col("place") <= LIMITS.discrete_max + 1)
    size = F.max("place").over(Window.partitionBy("ordinal"))
    kept = first.withColumn("size", size).where(F.col("size") <= LIMITS.discrete_max)
    return kept.join(F.broadcast(columns_frame(df, names)), "ordinal").select(
        "column",
        F.col("place").cast("int").alias("bin"),
        F.col("v").alias("bin_start"),
        F.col("v").alias("bin_end"),
        F.col("n").cast("bigint").alias("count"),
    )


def equal_width_bins(
    df: DataFrame, ranges: dict[str, tuple[float, float]], bins: int = LIMITS.histogram_bins
) -> DataFrame:
    """``bins`` bins per column over its given range; the last one includes its upper edge."""
    spark = df.sparkSession
    names = list(ranges)
    edges = []
    for name in names:
        lo, hi = ranges[name]
        step = (hi - lo) / bins
        cuts = [lo + i * step for i in range(bins)] + [hi]
        edges += [(name, b + 1, cuts[b], cuts[b + 1]) for b in range(bins)]
    grid = spark.createDataFrame(edges, "column string, bin int, bin_start double, bin_end double")
    if not names:
        return grid.withColumn("count", F.lit(0).cast("bigint"))
    cells: list[Column] = []
    for name in names:
        lo, hi = ranges[name]
        cells += [F.lit(name), _bin_of(col(name).cast("double"), lo, (hi - lo) / bins, bins)]
    placed = df.select(F.stack(F.lit(len(names)), *cells).alias("column", "bin"))
    counts = placed.where(F.col("bin").isNotNull()).groupBy("column", "bin").count()
    # The counts are at most bins x columns rows.
    return grid.join(counts, ["column", "bin"], "left").select(
        "column", "bin", "bin_start", "bin_end", F.coalesce("count", F.lit(0)).alias("count")
    )


def _bin_of(value: Column, lo: float, step: float, bins: int) -> Column:
    """1-based bin: guessed by division, then put right against the computed edges."""
    low, width = F.lit(lo), F.lit(step)
    guess = F.least(F.floor((value - low) / width), F.lit(bins - 1)).cast("int")
    down = F.when(value < low + guess * width, guess - 1).otherwise(guess)
    up = F.when((down < bins - 1) & (value >= low + (down + 1) * width), down + 1).otherwise(down)
    # least() passes over NULL, so a missing value has to be left out by hand.
    return F.when(value.isNotNull(), up + 1)


def identifier_columns(profile: DataFrame) -> DataFrame:
    """Categorical columns with more distinct values than half the rows."""
    return profile.where(is_identifier())


def is_identifier() -> Column:
    share = ratio(F.col("unique_count"), F.col("row_count"), 0.0)
    return (F.col("kind") == CATEGORICAL) & (share > LIMITS.identifier_ratio)


def default_features(profile: DataFrame, task: str, target: str | None) -> DataFrame:
    """(ordinal, column) of the features chosen unless the user says otherwise."""
    keep = ~is_identifier()
    if target is not None:
        keep = keep & (F.col("column") != target)
    if task == "clustering":
        keep = keep & (F.col("kind") == NUMERIC)
    return profile.where(keep).select("ordinal", "column")


def category_frequencies(
    df: DataFrame, profile: DataFrame | None = None, top: int = LIMITS.top_categories
) -> DataFrame:
    """The ``top`` most frequent values of each chartable column, the rest as one ``Other`` row.

    ``is_other`` tells the rest apart from a real value spelled "Other". Ties go by value.
    """
    names = categorical_columns(df)
    if profile is None:
        profile = column_profile(df.select(*[col(n) for n in names]))
    chartable = profile.where(
        (F.col("kind") == CATEGORICAL) & ~is_identifier() & (F.col("unique_count") > 0)
    )
    kept = [
        (df.columns.index(r["column"]), r["column"], r["row_count"] - r["missing_count"])
        for r in chartable.select("column", "row_count", "missing_count").collect()
    ]
    totals = df.sparkSession.createDataFrame(kept, "ordinal int, column string, total bigint")
    counts = value_counts(df, [name for _, name, _ in kept]).where(~is_missing())
    by_size = Window.partitionBy("ordinal").orderBy(F.col("n").desc(), "as_text")
    # One value past the limit is kept: its row becomes the rest.
    best = counts.withColumn("rank", F.row_number().over(by_size)).where(F.col("rank") <= top + 1)
    whole = Window.partitionBy("ordinal")
    is_other = F.col("rank") > top
    covered = F.sum(F.when(~is_other, F.col("n"))).over(whole)
    truncated = F.max("rank").over(whole) > top
    rows = best.withColumn("covered", covered).withColumn("truncated", truncated)
    return rows.join(F.broadcast(totals), "ordinal").select(
        "column",
        F.col("rank").cast("int").alias("rank"),
        F.when(is_other, F.lit("Other")).otherwise(F.col("as_text")).alias("value"),
        F.when(is_other, F.col("total") - F.col("covered")).otherwise(F.col("n")).alias("count"),
        is_other.alias("is_other"),
        "truncated",
    )


def correlation(df: DataFrame, wide: bool | None = None) -> DataFrame:
    """Pairwise-complete Pearson matrix of the numeric columns in long form.

    ``r`` is NULL where it is undefined. Fewer than two numeric columns give no rows.
    """
    names = numeric_columns(df)
    spark = df.sparkSession
    if len(names) < 2:
        return spark.createDataFrame([], "column_x string, column_y string, r double")
    if len(names) > _WIDE if wide is None else wide:
        return _wide_correlation(df, names)
    aggs, cells = [], []
    for i, a in enumerate(names):
        for j, b in enumerate(names[: i + 1]):
            x, y = col(a).cast("double"), col(b).cast("double")
            aggs += [
                F.regr_sxy(x, y).alias(f"xy{i}_{j}"),
                F.regr_sxx(x, y).alias(f"xx{i}_{j}"),
                F.regr_syy(x, y).alias(f"yy{i}_{j}"),
            ]
            r = finite(
                F.try_divide(
                    F.col(f"xy{i}_{j}"), F.sqrt(F.col(f"xx{i}_{j}")) * F.sqrt(F.col(f"yy{i}_{j}"))
                )
            )
            cells += [F.lit(a), F.lit(b), r]
            if i != j:
                cells += [F.lit(b), F.lit(a), r]
    return df.agg(*aggs).select(
        F.stack(F.lit(len(names) ** 2), *cells).alias("column_x", "column_y", "r")
    )


def _wide_correlation(df: DataFrame, names: list[str]) -> DataFrame:
    """Same numbers for many columns: each task multiplies its own batches of rows.

    Per task one matrix of sums over pairs leaves; those add up by cell across tasks.
    """
    spark, d = df.sparkSession, len(names)
    doubles = df.select(*[col(n).cast("double").alias(f"c{i}") for i, n in enumerate(names)])
    means = doubles.agg(*[F.coalesce(F.avg(finite(F.col(c))), F.lit(0.0)).alias(c) for c in doubles.columns]).first()
    shift = np.array([means[c] for c in doubles.columns])
    # Missing cells reach the workers as NaN, so cells that are no finite number go as infinity.
    endless = F.lit(float("inf"))
    doubles = doubles.select(
        *[F.when(F.col(c).isNotNull(), F.coalesce(finite(F.col(c)), endless)).alias(c) for c in doubles.columns]
    )

    def partial(batches):
        total = np.zeros((4 * d, 4 * d))
        for batch in batches:
            x = batch.to_numpy(dtype=float)
            seen, endless = ~np.isnan(x), np.isinf(x)
            x = np.where(seen & ~endless, x - shift, 0.0)
            z = np.hstack([seen.astype(float), x, x * x, endless.astype(float)])
            total += z.T @ z
        i, j = np.meshgrid(np.arange(d), np.arange(d), indexing="ij")
        yield pd.DataFrame(
            {
                "i": i.ravel(),
                "j": j.ravel(),
                "n": total[:d, :d].ravel(),
                "sx": total[d : 2 * d, :d].ravel(),
                "sy": total[:d, d : 2 * d].ravel(),
                "sxx": total[2 * d : 3 * d, :d].ravel(),
                "syy": total[:d, 2 * d : 3 * d].ravel(),
                "sxy": total[d : 2 * d, d : 2 * d].ravel(),
                "endless": (total[3 * d :, :d] + total[:d, 3 * d :]).ravel(),
            }
        )

    parts = doubles.mapInPandas(
        partial,
        "i int, j int, n double, sx double, sy double, sxx double, syy double, sxy double, endless double",
    )
    sums = parts.groupBy("i", "j").agg(
        *[F.sum(c).alias(c) for c in ("n", "sx", "sy", "sxx", "syy", "sxy", "endless")]
    )
    n = F.col("n")
    vx = F.col("sxx") - F.try_divide(F.col("sx") * F.col("sx"), n)
    vy = F.col("syy") - F.try_divide(F.col("sy") * F.col("sy"), n)
    vxy = F.col("sxy") - F.try_divide(F.col("sx") * F.col("sy"), n)
    # Rounding leaves a constant column a variance near zero rather than at it.
    flat = (vx <= 1e-12 * F.col("sxx")) | (vy <= 1e-12 * F.col("syy"))
    # A pair of cells of which one is not finite leaves r undefined; it does no harm where the other is missing.
    r = F.when(~flat & (F.col("endless") == 0), finite(F.try_divide(vxy, F.sqrt(F.abs(vx)) * F.sqrt(F.abs(vy)))))
    index = spark.createDataFrame(list(enumerate(names)), "k int, name string")
    xs = index.select(F.col("k").alias("i"), F.col("name").alias("column_x"))
    ys = index.select(F.col("k").alias("j"), F.col("name").alias("column_y"))
    return sums.join(xs, "i").join(ys, "j").select("column_x", "column_y", r.alias("r"))


def covariance(df: DataFrame, names: list[str]) -> DataFrame:
    """Sample covariance of the named columns over complete rows, long form."""
    places = range(len(names))
    aggs = [
        F.covar_samp(col(names[i]).cast("double"), col(names[j]).cast("double")).alias(f"v{i}_{j}")
        for i in places
        for j in places[i:]
    ]
    cells = [
        cell
        for i in places
        for j in places
        for cell in (F.lit(names[i]), F.lit(names[j]), F.col(f"v{min(i, j)}_{max(i, j)}"))
    ]
    return df.where(all_present(names)).agg(*aggs).select(
        F.stack(F.lit(len(names) ** 2), *cells).alias("column_x", "column_y", "covariance")
    )
