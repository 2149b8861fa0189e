"""Least squares from sums of products, so that every training side of a cross-validation costs one subtraction."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Feature values that one matrix product takes at once.
CELLS = 4_000_000
#: Slots up to which the matrix of a fold is exchanged and solved.
WIDEST = 1024


def fold_products(df: DataFrame, features: str, label: str, fold: str, width: int) -> tuple[dict[int, np.ndarray], float]:
    """Per fold the products of all pairs of (1, features, label - its mean), from one scan after the mean's; and the mean."""
    mean = df.agg(F.avg(label)).first()[0]
    size = width + 2

    def run(batches):
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, width)
            y = batch.column("y").to_numpy(zero_copy_only=False) - mean
            folds = batch.column("f").to_numpy(zero_copy_only=False)
            step = max(1, CELLS // size)
            for start in range(0, len(x), step):
                piece = slice(start, start + step)
                z = np.hstack([np.ones((len(y[piece]), 1)), x[piece], y[piece, None]])
                for k in np.unique(folds[piece]).tolist():
                    mine = z[folds[piece] == k]
                    totals[k] = totals.get(k, 0) + mine.T @ mine
        i, j = np.triu_indices(size)
        for k, total in totals.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(i), k), pa.int32()), pa.array(i), pa.array(j), pa.array(total[i, j])],
                names=["f", "i", "j", "v"],
            )

    given = df.select(F.col(fold).cast("int").alias("f"), vector_to_array(features).alias("x"), F.col(label).alias("y"))
    sums = given.mapInArrow(run, "f int, i bigint, j bigint, v double").groupBy("f", "i", "j").agg(F.sum("v").alias("v"))
    found: dict[int, np.ndarray] = {}
    # Folds x slots x slots numbers, whatever the number of rows.
    table = sums.toPandas()
    for k, mine in table.groupby("f"):
        square = np.zeros((size, size))
        i, j = mine["i"].to_numpy(), mine["j"].to_numpy()
        square[i, j] = square[j, i] = mine["v"].to_numpy()
        found[int(k)] = square
    return found, float(mean)


@dataclass(frozen=True)
class Line:
    """label - mean = intercept + slopes * features"""

    intercept: float
    slopes: np.ndarray

    def squared_error(self, products: np.ndarray) -> float:
        """Sum of squared residuals of the rows that the products were summed over."""
        v = np.concatenate([[-self.intercept], -self.slopes, [1.0]])
        return max(0.0, float(v @ products @ v))


def least_squares(products: np.ndarray, intercept: bool, offsets: np.ndarray, mean: float) -> Line:
    """The line with the least squared error; among equal ones that with the smallest slopes of scaled features.

    Without an intercept the line goes through 0 (of the label itself, whose ``mean`` was taken off) where the
    features equal ``offsets``: where a scaling has its zero.
    """
    n = products[0, 0]
    first, across = products[0, 1:-1], products[1:-1, 1:-1]
    to_label, label_sum = products[1:-1, -1], products[0, -1]
    zero = first / n if intercept else offsets
    target = label_sum / n if intercept else -mean
    # Products around (zero, target).
    a = across - np.outer(zero, first) - np.outer(first, zero) + n * np.outer(zero, zero)
    b = to_label - zero * label_sum - target * first + n * target * zero
    around = first / n
    spread = np.sqrt(np.maximum(np.diag(across) / n - around**2, 0.0))
    scale = np.where(spread > 1e-9 * (1 + np.abs(around)), spread, 0.0)
    inverse = np.divide(1.0, scale, out=np.zeros_like(scale), where=scale > 0)
    if not intercept:
        # A constant feature still counts where the line must go through a given point.
        flat = (scale == 0) & (np.diag(a) > 1e-12 * n)
        inverse = np.where(flat, 1.0, inverse)
    scaled = a * np.outer(inverse, inverse) / n
    slopes = np.linalg.lstsq(scaled, b * inverse / n, rcond=1e-10)[0] * inverse
    return Line(float(target - slopes @ zero), slopes)
