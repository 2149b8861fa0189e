"""Exact quantiles of many columns without sorting or gathering a column.

A sketch brackets each wanted rank, exact counts check the bracket, and only the few values inside
it are grouped and ranked. A bracket that still holds too many rows is narrowed again.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablewright.functions.expressions import col

_ACCURACY = 10_000
_SLACK = 2.0 / _ACCURACY
# Rows one bracket may hand to the final ranking.
MAX_CANDIDATES = 4_000_000


@dataclass
class Bracket:
    """Where the 0-based ranks ``low_rank`` and ``high_rank`` of a column are known to lie."""

    column: str
    q: float
    low_rank: int
    high_rank: int
    fraction: float
    lo: float
    hi: float
    below: int = 0
    inside: int = 0

    @property
    def settled(self) -> bool:
        return self.lo == self.hi

    @property
    def holds(self) -> bool:
        return self.below <= self.low_rank and self.high_rank < self.below + self.inside


def sketch_points(qs: list[float]) -> list[float]:
    return [min(1.0, max(0.0, q + d)) for q in qs for d in (-_SLACK, _SLACK)]


def start_brackets(
    column: str, n: int, lowest: float, highest: float, qs: list[float], sketch: list[float]
) -> list[Bracket]:
    """Brackets from one column's sketch, taken at ``sketch_points(qs)``."""
    brackets = []
    for i, q in enumerate(qs):
        position = q * (n - 1)
        low = math.floor(position)
        high = min(low + 1, n - 1)
        lo = lowest if q - _SLACK <= 0 else sketch[2 * i]
        hi = highest if q + _SLACK >= 1 else sketch[2 * i + 1]
        brackets.append(Bracket(column, q, low, high, position - low, lo, hi))
    return brackets


def _count(df: DataFrame, brackets: list[Bracket]) -> None:
    aggs = []
    for i, b in enumerate(brackets):
        value = col(b.column).cast("double")
        aggs.append(F.count_if(value < b.lo).alias(f"below{i}"))
        aggs.append(F.count_if(value.between(b.lo, b.hi)).alias(f"inside{i}"))
    row = df.agg(*aggs).first()
    for i, b in enumerate(brackets):
        b.below, b.inside = row[f"below{i}"], row[f"inside{i}"]


def _narrow(df: DataFrame, brackets: list[Bracket]) -> None:
    aggs = []
    for i, b in enumerate(brackets):
        value = col(b.column).cast("double")
        points = [
            min(1.0, max(0.0, (rank - b.below) / b.inside + d))
            for rank, d in ((b.low_rank, -_SLACK), (b.high_rank, _SLACK))
        ]
        within = F.when(value.between(b.lo, b.hi), value)
        aggs.append(F.percentile_approx(within, points, _ACCURACY).alias(f"s{i}"))
    row = df.agg(*aggs).first()
    for i, b in enumerate(brackets):
        b.lo, b.hi = row[f"s{i}"]


def exact_quantiles(
    df: DataFrame,
    brackets: list[Bracket],
    extremes: dict[str, tuple[float, float]],
    max_candidates: int = MAX_CANDIDATES,
) -> dict[tuple[str, float], float]:
    """{(column, q): linearly interpolated quantile}; one small table reaches the driver."""
    pending = list(brackets)
    while pending:
        _count(df, pending)
        loose = [b for b in pending if not b.holds]
        for b in loose:
            lowest, highest = extremes[b.column]
            b.lo = b.lo if b.below <= b.low_rank else lowest
            b.hi = b.hi if b.high_rank < b.below + b.inside else highest
        wide = [
            b for b in pending if b.holds and b.inside > max_candidates and not b.settled
        ]
        before = {id(b): (b.lo, b.hi) for b in wide}
        if wide:
            _narrow(df, wide)
        stuck = [b for b in wide if before[id(b)] == (b.lo, b.hi)]
        pending = loose + [b for b in wide if b not in stuck]
    picks = _pick(df, [b for b in brackets if not b.settled])
    result = {}
    for b in brackets:
        low, high = (b.lo, b.hi) if b.settled else picks[(b.column, b.q)]
        result[(b.column, b.q)] = low + (high - low) * b.fraction
    return result


def _pick(df: DataFrame, brackets: list[Bracket]) -> dict[tuple[str, float], tuple[float, float]]:
    if not brackets:
        return {}
    found = F.array_compact(
        F.array(
            *[
                F.when(
                    col(b.column).cast("double").between(b.lo, b.hi),
                    F.struct(F.lit(i).alias("id"), col(b.column).cast("double").alias("v")),
                )
                for i, b in enumerate(brackets)
            ]
        )
    )
    # Few rows lie in any bracket; the rest is dropped before anything is built for it.
    near = reduce(
        lambda a, b: a | b, [col(b.column).cast("double").between(b.lo, b.hi) for b in brackets]
    )
    counts = df.where(near).select(F.explode(found).alias("c")).groupBy("c.id", "c.v").count()
    ordered = Window.partitionBy("id").orderBy("v")
    up_to = F.sum("count").over(ordered.rowsBetween(Window.unboundedPreceding, 0))
    ranked = counts.withColumn("up_to", up_to)

    def literal_map(values: list[int]):
        return F.element_at(F.array(*[F.lit(v) for v in values]), F.col("id") + 1)

    low_rank = literal_map([b.low_rank - b.below for b in brackets])
    high_rank = literal_map([b.high_rank - b.below for b in brackets])
    rows = (
        ranked.groupBy("id")
        .agg(
            F.min(F.when(F.col("up_to") > low_rank, F.col("v"))).alias("low"),
            F.min(F.when(F.col("up_to") > high_rank, F.col("v"))).alias("high"),
        )
        .collect()
    )
    return {(brackets[r["id"]].column, brackets[r["id"]].q): (r["low"], r["high"]) for r in rows}
