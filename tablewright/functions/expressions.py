"""Column expressions shared by the operators. Everything here runs in the JVM."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.types import SEED

_FLOATS = (T.FloatType, T.DoubleType)
# A group key wider than this is exchanged as a digest instead of as itself.
_DIGEST_ABOVE_BYTES = 40


def col(name: str) -> Column:
    """A column by its literal name, dots and spaces included."""
    return F.col("`" + name.replace("`", "``") + "`")


def normalize(df: DataFrame) -> DataFrame:
    """NaN becomes NULL, so that Spark has one notion of a missing value."""
    floats = {f.name for f in df.schema.fields if isinstance(f.dataType, _FLOATS)}
    if not floats:
        return df
    return df.select(
        *[
            F.when(~F.isnan(col(n)), col(n)).alias(n) if n in floats else col(n)
            for n in df.columns
        ]
    )


def as_text(df: DataFrame, name: str) -> Column:
    """Injective text form of a scalar column (both zeros of a float are equal)."""
    value, dtype = col(name), df.schema[name].dataType
    if isinstance(dtype, _FLOATS):
        value = value + F.lit(0.0)
    elif isinstance(dtype, T.TimestampType):
        value = F.unix_micros(value)
    return value.cast("string")


def row_digest(df: DataFrame, names: Iterable[str]) -> Column:
    """SHA-256 over the whole content of the named columns, NULL-aware.

    Each part carries its own length, so no two different rows spell the same text.
    """
    parts = []
    for name in names:
        text = as_text(df, name)
        parts.append(
            F.coalesce(F.concat(F.length(text).cast("string"), F.lit(":"), text), F.lit("-"))
        )
    return F.unhex(F.sha2(F.concat(*parts), 256))


def grouping_key(df: DataFrame, names: list[str]) -> list[Column]:
    """Columns to group rows by identity: the values if narrow, else one digest."""
    types = [df.schema[n].dataType for n in names]
    fixed = all(not isinstance(t, (T.StringType, T.BinaryType)) for t in types)
    if fixed and sum(8 for _ in types) <= _DIGEST_ABOVE_BYTES:
        return [col(n).alias(f"_g{i}") for i, n in enumerate(names)]
    return [row_digest(df, names).alias("_g")]


def order_key(names: Iterable[str], seed: int | str = SEED) -> Column:
    """Seeded pseudo-random order of rows that depends only on their values."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[col(n).cast("string") for n in names]))


def all_present(names: Iterable[str]) -> Column:
    result = F.lit(True)
    for name in names:
        result = result & col(name).isNotNull()
    return result


def ratio(numerator: Column, denominator: Column, default: float | None = None) -> Column:
    """Division whose zero denominator gives ``default`` instead of an error."""
    value = F.try_divide(numerator.cast("double"), denominator.cast("double"))
    return value if default is None else F.coalesce(value, F.lit(float(default)))


def finite(value: Column) -> Column:
    """NULL for NaN and the infinities."""
    return F.when(F.abs(value) < F.lit(float("inf")), value)


def percentage(part: Column, whole: Column) -> Column:
    """Share in percent with two decimals, halves to even; 0 for an empty table."""
    return F.bround(ratio(part, whole, 0.0) * 100.0, 2)


def number_label(value: Column) -> Column:
    """``3`` for whole numbers, ``3.5`` otherwise."""
    return F.when(value == F.floor(value), F.floor(value).cast("string")).otherwise(
        F.format_string("%.1f", value)
    )


def bin_label(start: Column, end: Column) -> Column:
    """Text of a histogram bin: one number, or both edges around an en dash."""
    return F.when(start == end, number_label(start)).otherwise(
        F.concat(number_label(start), F.lit("–"), number_label(end))
    )


def safe_stem(name: Column) -> Column:
    """A file name's stem with everything but ``A-Za-z0-9_.-`` made ``_``."""
    stem = F.regexp_replace(F.regexp_replace(name, r"^.*[/\\]", ""), r"(?<=.)\.[^.]*$", "")
    cleaned = F.regexp_replace(stem, r"[^A-Za-z0-9_.-]", "_")
    return F.when(cleaned == "", F.lit("dataset")).otherwise(cleaned)
