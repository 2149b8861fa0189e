"""Vector codes: every vector becomes one byte per part, the number of the nearest entry of that part's codebook.

Vectors are cut into equal parts of integers. The distinct parts of the whole table, counted, are sorted once, so that
neighbours share their first dimensions. A task walks them as a lexicographic trie: the distances to all entries,
accumulated over a prefix, are computed once for all parts with that prefix, and a leaf adds only the dimensions
in which it differs from the leaf before. Leaves take the nearest entry and add their counts times their components to
its sum. A round thus exchanges one row per entry and task, and the driver sees nothing but the codebooks.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.llm.common import column, written
from tablewright.types import TablewrightError

#: Parts of a vector, entries of a codebook (numbered by one byte) and rounds of refinement.
PARTS, ENTRIES, ROUNDS = 4, 256, 4
#: Integer steps of 1.0.
SCALE = 1024
#: The largest integer component for which all sums stay exact; larger ones are refused.
LARGEST = 1 << 26
#: Leaves that one step of the walk takes; bounds its memory to twice that many rows of distances.
LEAVES = 256


def nearest(leaves: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The number of each row's nearest entry (the lower one on a tie) and its squared distance.

    Rows may come in any order and repeat; the more dimensions a row shares with the one before, the less is
    computed. The walk is depth-first over blocks of leaves: the accumulated distances along the path to the last
    leaf are carried from block to block, and inside a block one step per dimension serves all its trie nodes.
    """
    n, width = leaves.shape
    if not n or not width:
        return np.zeros(n, np.int64), np.zeros(n, np.int64)
    reach = max(int(np.abs(leaves).max()), int(np.abs(entries).max()))
    # Floating point is faster, and exact as long as all sums stay below 2^53.
    kind = np.float64 if (2 * reach) ** 2 * width < 1 << 53 else np.int64
    leaves, entries = leaves.astype(kind), entries.astype(kind)
    differs = leaves[1:] != leaves[:-1]
    branch = np.concatenate([[0], np.where(differs.any(1), differs.argmax(1), width)])
    path = np.zeros((width + 1, len(entries)), kind)
    number, distance = np.empty(n, np.int64), np.empty(n, np.int64)
    for start in range(0, n, LEAVES):
        block, turns = leaves[start : start + LEAVES], branch[start : start + LEAVES]
        # Node 0 of a depth is the one on the path to the last leaf of the block before.
        nodes, sums = np.zeros(len(block), np.int64), path[:1]
        for depth in range(width):
            new = turns <= depth
            step = block[new, depth, None] - entries[None, :, depth]
            grown = np.concatenate([path[depth + 1 : depth + 2], sums[nodes[new]] + step * step])
            nodes, sums = np.cumsum(new), grown
            path[depth + 1] = sums[nodes[-1]]
        best = sums.argmin(1)
        number[start : start + LEAVES] = best[nodes]
        distance[start : start + LEAVES] = sums[np.arange(len(sums)), best][nodes]
    return number, distance


@dataclass(frozen=True)
class Codebooks:
    """``entries``: parts x entries x width integers."""

    entries: np.ndarray

    @property
    def width(self) -> int:
        return self.entries.shape[2]

    def sha256(self) -> str:
        """Digest of all components in order of part, entry and position, comma-joined decimals."""
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()

    def decoded(self, code: str) -> list[int]:
        """The integer vector that a code stands for."""
        numbers = bytes.fromhex(code)
        return [v for part, number in enumerate(numbers) for v in self.entries[part, number].tolist()]


def _finite(vector: Column) -> Column:
    value = lambda x: x.cast("double")
    return vector.isNotNull() & F.forall(
        vector, lambda x: x.isNotNull() & ~F.isnan(value(x)) & (F.abs(value(x)) != float("inf"))
    )


def _matrix(values: pa.Array, rows: int, size: int) -> np.ndarray:
    return values.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(rows, size)


def integer_vectors(
    df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str | None = "label"
) -> tuple[DataFrame, int]:
    """(id, label, q) of the kept rows as a written table, and the width of a part.

    A row is dropped if its vector is null or holds a null, NaN or infinite component. ``q`` holds floor(1024 * x) of
    every component. Vectors that are shorter than the longest, or not a multiple of four long, count as ending
    in zeros. Components of 65,536 and more are refused with an error: their sums would not be exact.
    """
    kept = df.where(_finite(column(vector))).select(
        column(vec_id).alias("id"),
        (column(label) if label else F.lit(None).cast("int")).alias("label"),
        F.transform(column(vector), lambda x: F.floor(x.cast("double") * SCALE)).alias("q"),
    )
    kept = written(kept, "vectors")
    size = F.size("q")
    row = kept.agg(
        F.min(size).alias("short"),
        F.max(size).alias("long"),
        F.max(F.array_max("q")).alias("most"),
        F.min(F.array_min("q")).alias("least"),
    ).first()
    if max(row["most"] or 0, -(row["least"] or 0)) > LARGEST:
        raise TablewrightError(f"A vector has a component beyond {LARGEST // SCALE}.")
    width = -(-(row["long"] or 0) // PARTS)
    if row["short"] is not None and row["short"] < width * PARTS:
        zeros = F.array_repeat(F.lit(0).cast("bigint"), F.lit(width * PARTS) - size)
        kept = kept.withColumn("q", F.concat("q", zeros))
    return kept, width


def fit_codebooks(kept: DataFrame, width: int, rounds: int = ROUNDS) -> Codebooks:
    """Codebooks of the vectors that ``integer_vectors`` kept.

    They start as the parts of the 256 (or fewer) vectors with the least ids, null ids last, ties by components.
    Every round assigns every part and moves each entry to the rounded-down mean of its parts; an entry without
    parts stays.
    """
    first = kept.orderBy(F.col("id").asc_nulls_last(), "q").limit(ENTRIES).select("q").collect()
    start = np.array([r["q"] for r in first], np.int64).reshape(len(first), PARTS, width)
    entries = np.ascontiguousarray(start.transpose(1, 0, 2))
    if not len(first):
        return Codebooks(entries)
    cuts = F.array(*[F.slice("q", p * width + 1, width) for p in range(PARTS)])
    parts = kept.select(F.posexplode(cuts).alias("p", "v")).groupBy("p", "v").agg(F.count(F.lit(1)).alias("n"))
    # Sorted over the whole table: leaves of one trie branch lie behind each other.
    parts = written(parts.repartitionByRange("p", "v").sortWithinPartitions("p", "v"), "vector-parts")

    for _ in range(rounds):
        found = parts.mapInArrow(_summing(entries, width), "p int, e int, n bigint, s array<bigint>")
        sums = [F.sum(F.col("s")[i]) for i in range(width)]
        moved = found.groupBy("p", "e").agg(F.sum("n").alias("n"), F.array(*sums).alias("s"))
        entries = entries.copy()
        # One row per entry: at most 4 x 256, whatever the size of the table.
        for r in moved.collect():
            entries[r["p"], r["e"]] = np.array(r["s"], np.int64) // r["n"]
    return Codebooks(entries)


def _summing(entries: np.ndarray, width: int):
    """Batches of (p, v, n) to the counts and sums that each entry's parts add up to in this task."""

    def run(batches):
        counts = np.zeros(entries.shape[:2], np.int64)
        sums = np.zeros(entries.shape, np.int64)
        for batch in batches:
            p = batch.column("p").to_numpy(zero_copy_only=False)
            n = batch.column("n").to_numpy(zero_copy_only=False)
            leaves = _matrix(batch.column("v"), batch.num_rows, width)
            for part in np.unique(p).tolist():
                mine = p == part
                number, _ = nearest(leaves[mine], entries[part])
                np.add.at(counts[part], number, n[mine])
                np.add.at(sums[part], number, leaves[mine] * n[mine, None])
        used = np.argwhere(counts > 0)
        if len(used):
            at = tuple(used.T)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(used[:, 0], pa.int32()),
                    pa.array(used[:, 1], pa.int32()),
                    pa.array(counts[at]),
                    pa.array(sums[at].tolist(), pa.list_(pa.int64())),
                ],
                names=["p", "e", "n", "s"],
            )

    return run


def encode(kept: DataFrame, books: Codebooks) -> DataFrame:
    """id, label, code (two hex digits per part) and error (squared distances summed over parts) of every vector."""
    entries, width = books.entries, books.width
    kind = {f.name: f.dataType.simpleString() for f in kept.schema.fields}

    def run(batches):
        for batch in batches:
            vectors = _matrix(batch.column("q"), batch.num_rows, PARTS * width)
            codes = np.empty((batch.num_rows, PARTS), np.uint8)
            error = np.zeros(batch.num_rows, np.int64)
            for part in range(PARTS):
                leaves = vectors[:, part * width : (part + 1) * width]
                order = np.lexsort(leaves.T[::-1]) if width else np.arange(len(leaves))
                number, distance = nearest(leaves[order], entries[part])
                codes[order, part] = number
                error[order] += distance
            digits = codes.tobytes().hex()
            step = 2 * PARTS
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id"),
                    batch.column("label"),
                    pa.array([digits[i : i + step] for i in range(0, len(digits), step)], pa.string()),
                    pa.array(error),
                ],
                names=["id", "label", "code", "error"],
            )

    return kept.mapInArrow(run, f"id {kind['id']}, label {kind['label']}, code string, error bigint")


def compress_vectors(
    df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str | None = "label", rounds: int = ROUNDS
) -> tuple[DataFrame, Codebooks]:
    """(vec_id, label, code, error, label_error) of every row with a whole vector, and the codebooks.

    ``label_error`` adds up ``error`` over equal labels, nulls together. Which rows are left out and how uneven
    vectors count is said at ``integer_vectors``. Repeated rows and rows that share an id are coded each; null ids
    are coded too. A table without a whole vector gives no rows and empty codebooks. Other columns are not
    looked at.
    """
    kept, width = integer_vectors(df, vec_id, vector, label)
    books = fit_codebooks(kept, width, rounds)
    coded = written(encode(kept, books), "vector-codes")
    sums = coded.groupBy("label").agg(F.sum("error").alias("label_error"))
    # Written, so that Spark knows its size and sends it to every task only where it is small.
    sums = written(sums, "label-errors").withColumnRenamed("label", "of")
    joined = coded.join(sums, F.col("label").eqNullSafe(F.col("of")))
    return joined.select(F.col("id").alias("vec_id"), "label", "code", "error", "label_error"), books
