"""One-hot encoding by a table of levels, for columns with any number of them.

The levels of all columns are sorted in ranges, and a level's place in that order is its slot: columns one behind the
other, levels sorted inside. Rows find their slots by joins and come out as sparse entries; the names of the
slots are a table too. No list of levels reaches the driver.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.functions.expressions import col
from tablewright.functions.storage import cut_lineage
from tablewright.operators.points import dense_numbers
from tablewright.operators.prepare import scale_statistics
from tablewright.types import split_kinds

# Levels of a column up to which their counted table is broadcast.
FEW_LEVELS = 100_000


@dataclass(frozen=True)
class Slots:
    """What a feature vector's places stand for: numbers first, then the levels of (column, level, slot)."""

    numeric: list[str]
    statistics: list[tuple[float, float]]
    categorical: list[str]
    levels: DataFrame
    size: int

    def names(self) -> DataFrame:
        """(slot, name): the column's own name, or column_level."""
        spark = self.levels.sparkSession
        plain = spark.createDataFrame(list(enumerate(self.numeric)), "slot bigint, name string")
        title = F.element_at(F.array(*[F.lit(c) for c in self.categorical] or [F.lit("")]), F.col("column") + 1)
        return plain.unionByName(self.levels.select("slot", F.concat(title, F.lit("_"), "level").alias("name")))


def fit_slots(df: DataFrame, features: list[str], scaler: str = "none") -> Slots:
    """Slots of the features' numbers and of all levels that occur; missing values are no level."""
    numeric, categorical = split_kinds(df, features)
    spark, shape = df.sparkSession, "column int, level string"
    parts = [
        df.where(col(c).isNotNull()).select(F.lit(i).alias("column"), col(c).cast("string").alias("level"))
        for i, c in enumerate(categorical)
    ]
    seen = reduce(DataFrame.unionByName, parts).distinct() if parts else spark.createDataFrame([], shape)
    placed = dense_numbers(seen.withColumn("order", F.struct("column", "level")), "order", "place")
    levels = cut_lineage(placed.select("column", "level", (F.col("place") + len(numeric)).alias("slot")))
    return Slots(numeric, scale_statistics(df, numeric, scaler), categorical, levels, len(numeric) + levels.count())


def encode(df: DataFrame, slots: Slots, keys: list[str]) -> DataFrame:
    """``keys`` and the row's entries: size, indices (ascending) and values. Unseen levels and missing values have none.

    Numbers that are 0 after scaling are entries too.
    """
    names = [f"k{i}" for i in range(len(keys))]
    rows = df.select(
        *[col(k).alias(n) for k, n in zip(keys, names)],
        *[((col(c).cast("double") - o) / d).alias(f"n{i}") for i, (c, (o, d)) in enumerate(zip(slots.numeric, slots.statistics))],
        *[col(c).cast("string").alias(f"c{i}") for i, c in enumerate(slots.categorical)],
    )
    for i in range(len(slots.categorical)):
        mine = slots.levels.where(F.col("column") == i).select(F.col("level").alias(f"l{i}"), F.col("slot").alias(f"s{i}"))
        # Frequent levels meet no shuffle while the levels are few; beyond, skewed ones are split as they are joined.
        if mine.count() <= FEW_LEVELS:
            mine = F.broadcast(mine)
        rows = rows.join(mine, F.col(f"c{i}") == F.col(f"l{i}"), "left")
    entry = lambda slot, value: F.struct(slot.cast("bigint").alias("i"), value.cast("double").alias("v"))
    entries = [entry(F.lit(i), F.col(f"n{i}")) for i in range(len(slots.numeric))]
    entries += [entry(F.col(f"s{i}"), F.lit(1.0)) for i in range(len(slots.categorical))]
    kept = F.filter(F.array(*entries), lambda e: e["i"].isNotNull() & e["v"].isNotNull())
    rows = rows.select(*names, kept.alias("e"))
    return rows.select(
        *names,
        F.lit(slots.size).cast("bigint").alias("size"),
        F.transform("e", lambda e: e["i"]).alias("indices"),
        F.transform("e", lambda e: e["v"]).alias("values"),
    ).toDF(*keys, "size", "indices", "values")
