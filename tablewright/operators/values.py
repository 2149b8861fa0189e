"""Long form of a table and counts per distinct value: one shuffle for all columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.functions.expressions import col
from tablewright.types import kind

# Longer texts are told apart by their digest when only identity matters.
_TEXT_BYTES = 64
_INTEGERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_IDENTITY = ["as_int", "as_real", "as_text"]


def columns_frame(df: DataFrame, names: list[str] | None = None) -> DataFrame:
    """One row per column: ordinal, name, kind and physical type."""
    rows = [
        (i, f.name, kind(f.dataType), f.dataType.simpleString())
        for i, f in enumerate(df.schema.fields)
        if names is None or f.name in names
    ]
    schema = "ordinal int, column string, kind string, physical_type string"
    return df.sparkSession.createDataFrame(rows, schema)


def _typed(df: DataFrame, name: str, identity_only: bool) -> list[Column]:
    dtype, value = df.schema[name].dataType, col(name)
    as_int, as_real, as_text = (
        F.lit(None).cast("bigint"),
        F.lit(None).cast("double"),
        F.lit(None).cast("string"),
    )
    if isinstance(dtype, _INTEGERS):
        as_int = value.cast("bigint")
    elif isinstance(dtype, (T.FloatType, T.DoubleType)):
        as_real = value.cast("double")
    elif isinstance(dtype, T.DecimalType):
        as_real, as_text = value.cast("double"), value.cast("string")
    else:
        as_text = value.cast("string")
        if isinstance(dtype, T.TimestampType):
            as_int = F.unix_micros(value)
        elif identity_only and isinstance(dtype, T.StringType):
            as_text = F.when(
                F.length(value) > _TEXT_BYTES, F.concat(F.lit("#"), F.sha2(value, 256))
            ).otherwise(value)
    return [as_int, as_real, as_text]


def value_counts(
    df: DataFrame, names: list[str] | None = None, identity_only: bool = False
) -> DataFrame:
    """(ordinal, as_int, as_real, as_text, n): rows per distinct value of every column.

    Missing values of a column form one row with all three value columns NULL. Frequent values
    collapse before the exchange, so a value that fills a third of the table costs one row a task.
    """
    chosen = [n for n in df.columns if names is None or n in names]
    if not chosen:
        empty = "ordinal int, as_int bigint, as_real double, as_text string, n bigint"
        return df.sparkSession.createDataFrame([], empty)
    cells: list[Column] = []
    for name in chosen:
        cells += [F.lit(df.columns.index(name)), *_typed(df, name, identity_only)]
    long = df.select(F.stack(F.lit(len(chosen)), *cells).alias("ordinal", *_IDENTITY))
    return long.groupBy("ordinal", *_IDENTITY).agg(F.count(F.lit(1)).alias("n"))


def is_missing() -> Column:
    return F.col("as_int").isNull() & F.col("as_real").isNull() & F.col("as_text").isNull()


def numeric_value() -> Column:
    return F.coalesce(F.col("as_real"), F.col("as_int").cast("double"))
