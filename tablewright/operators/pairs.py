"""Sums over the distances of all pairs of points, gathered inside tasks that each hold one block of the points.

A task keeps its block and what it adds up, and the points it has to meet stream past. The number of blocks depends on how
much one of them may hold, not on the square of the table, so what is exchanged is a fixed number of copies of the
points, and what comes out is no more than the result.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Blocks of a table that has enough rows for them, and the rows that make a block worth its while.
BLOCKS, BLOCK_ROWS = 36, 2048
#: Numbers that a block, with what it adds up, may hold.
BLOCK_NUMBERS = 16_000_000
#: Rows and columns of the distances that a step holds at once: few enough for a processor's cache.
TILE_ROWS, TILE_COLUMNS = 128, 1024
#: Such rows for points of few dimensions, and the rows that share a centre.
NARROW_ROWS, CENTRED_ROWS = 64, 1024
#: Dimensions from which distances come from a matrix product, and the share of the squared lengths below which a
#: squared distance is computed from the differences after all.
PRODUCT_WIDTH, CLOSE = 8, 1e-4
#: Multiplications up to which BLAS (OpenBLAS: 4 * 65536) starts no threads, and rows of such a product.
ONE_THREAD, PRODUCT_ROWS = 262_144, 32
#: Numbers of the rows that travel as one.
PACK_NUMBERS = 512
#: Runs of a tile up to which each is summed on its own.
FEW_RUNS = 16


def block_count(n: int, numbers: int) -> int:
    """Blocks of ``n`` points for which a task keeps so many ``numbers`` each."""
    return max(1, min(BLOCKS, math.ceil(n / BLOCK_ROWS)), math.ceil(n * numbers / BLOCK_NUMBERS))


def runs_of(rows: np.ndarray) -> np.ndarray:
    """Where the runs of equal rows begin."""
    changed = np.ones(len(rows), bool)
    changed[1:] = (rows[1:] != rows[:-1]) if rows.ndim == 1 else (rows[1:] != rows[:-1]).any(1)
    return np.flatnonzero(changed)


def vectors(column: pa.Array) -> np.ndarray:
    """The vectors of a column of lists, which are equally long and not null."""
    if column.null_count:
        raise ValueError("A point has no position.")
    width = len(column[0]) if len(column) else 0
    return column.flatten().to_numpy(zero_copy_only=False).astype(float, copy=False).reshape(len(column), width)


def product(a: np.ndarray, b: np.ndarray, out: np.ndarray) -> np.ndarray:
    """``a @ b``, cut so that BLAS computes each part in the calling thread.

    Tasks run side by side on all cores already: threads that each of them starts as well only wait for each other.
    """
    rows = min(PRODUCT_ROWS, max(1, ONE_THREAD // max(1, a.shape[1])))
    columns = max(1, ONE_THREAD // max(1, rows * a.shape[1]))
    for i in range(0, len(a), rows):
        for j in range(0, b.shape[1], columns):
            np.matmul(a[i : i + rows], b[:, j : j + columns], out=out[i : i + rows, j : j + columns])
    return out


def tile_room() -> np.ndarray:
    """Memory for the distances of a tile, used again for the next one: fresh pages cost more than the distances."""
    return np.empty((2, TILE_ROWS * TILE_COLUMNS))


class Columns:
    """One side of many tiles: its points about a centre, with their squared lengths if these are of use."""

    def __init__(self, points: np.ndarray, centre: np.ndarray):
        self.points, self.centre = points, centre
        self.wide = points.shape[1] >= PRODUCT_WIDTH
        about = points - centre if self.wide else points
        self.across = np.ascontiguousarray(about.T)
        self.lengths = np.einsum("ij,ij->i", about, about) if self.wide else np.zeros(len(points))


def tile_distances(a: np.ndarray, columns: Columns, room: np.ndarray | None = None) -> np.ndarray:
    """Euclidean distances of two small sets of points; equal points are at distance 0.

    They stand in ``room``, if it is given and large enough, until it is used again.
    """
    b = columns.points
    shape, size = (len(a), len(b)), len(a) * len(b)
    if room is None or room.shape[1] < size:
        room = np.empty((2, size))
    total, other = (part[:size].reshape(shape) for part in room)
    if columns.wide:
        p = a - columns.centre
        pp, qq = np.einsum("ij,ij->i", p, p)[:, None], columns.lengths[None, :]
        # No product is larger than the sum of the squared lengths.
        if size and np.isfinite(pp.max() + qq.max()):
            p *= -2.0
            product(p, columns.across, total)
            lengths = np.add(pp, qq, out=other)
            total += lengths
            # A small difference of large numbers has lost its digits.
            lengths *= CLOSE
            close = total <= lengths
            if not close.any():
                return np.sqrt(total, out=total)
            i, j = np.nonzero(close)
            if 8 * len(i) <= size:
                total[i, j] = ((a[i] - b[j]) ** 2).sum(1)
                return np.sqrt(total, out=total)
    across = np.ascontiguousarray(b.T)
    if not len(across):
        total[:] = 0.0
    for k in range(len(across)):
        gap = np.subtract(a[:, k, None], across[None, k], out=other if k else total)
        np.multiply(gap, gap, out=gap)
        if k:
            total += gap
    return np.sqrt(total, out=total)


def _pack(batches: Iterator[pa.RecordBatch], names: list[str], order: str) -> Iterator[pa.RecordBatch]:
    """Rows of one block, as they come, in lists of about PACK_NUMBERS numbers."""
    for batch in batches:
        if not batch.num_rows:
            continue
        width = len(names) + len(batch.column("x").flatten()) // batch.num_rows
        blocks = batch.column("_block").to_numpy(zero_copy_only=False)
        cuts = np.union1d(runs_of(blocks), np.arange(0, len(blocks), max(1, PACK_NUMBERS // width)))
        offsets = pa.array(np.r_[cuts, len(blocks)].astype(np.int32))
        heads = pa.array(cuts)
        lists = [pa.ListArray.from_arrays(offsets, batch.column(c)) for c in names]
        yield pa.RecordBatch.from_arrays(
            [batch.column("_block").take(heads), batch.column(order).take(heads), *lists], names=["_block", "_order", *names]
        )


def meet_blocks(
    rows: DataFrame,
    block: Column,
    blocks: int,
    once: bool,
    order: str,
    work: Callable[[pa.Table, Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]],
    schema: str,
) -> DataFrame:
    """``work`` over every block, once: its own rows, then the rows of the other blocks, piece by piece.

    With ``once``, two blocks meet in one of their tasks only; ``blocks`` is odd then, and every block meets equally many.
    Within a task, rows come in ``order``. A block's number is below ``blocks``; the rows have a column ``id``, which
    those of other blocks lack.
    """
    steps = (blocks - 1) // 2 if once else blocks - 1
    others = F.array() if steps == 0 else F.transform(
        F.sequence(F.lit(1), F.lit(steps)), lambda s: F.pmod(F.col("_block") - s, F.lit(blocks))
    )
    # A few rows travel as one: they are written, sorted and compressed together.
    own_order = rows.withColumn("_block", block.cast("int"))
    gathered = own_order.repartition(blocks, "_block").sortWithinPartitions("_block", order)
    packed = _packed(gathered, rows, order).withColumn("_others", others.cast("array<int>"))
    # With more ranges than blocks, every block gets one of its own.
    return _met(rows, packed, lambda spread: spread.repartitionByRange(2 * blocks, "_to"), work, schema)


def meet(
    rows: DataFrame,
    block: str,
    targets: DataFrame,
    tasks: int,
    order: str,
    work: Callable[[pa.Table, Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]],
    schema: str,
) -> DataFrame:
    """``work`` over every block: its own rows, then those of the blocks that name it among their ``targets``.

    ``rows`` lie in their tasks by ``block`` and ``order``; ``targets`` are few rows (_block, _others). Several blocks share a task.
    """
    named = rows.drop(block)
    packed = _packed(rows.withColumnRenamed(block, "_block"), named, order).join(F.broadcast(targets), "_block")
    return _met(named, packed, lambda spread: spread.repartition(tasks, "_to"), work, schema)


def _packed(gathered: DataFrame, rows: DataFrame, order: str) -> DataFrame:
    names, kinds = rows.columns, {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    shape = ", ".join(["_block int", f"_order {kinds[order]}", *[f"`{c}` array<{kinds[c]}>" for c in names]])
    return gathered.select("_block", *names).mapInArrow(lambda batches: _pack(batches, names, order), shape)


def _met(
    rows: DataFrame,
    packed: DataFrame,
    deal: Callable[[DataFrame], DataFrame],
    work: Callable[[pa.Table, Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]],
    schema: str,
) -> DataFrame:
    """``work`` over packed rows of blocks that go to themselves and to their ``_others``."""
    names = rows.columns
    spread = packed.withColumn("_to", F.explode(F.concat(F.array("_block"), "_others"))).drop("_others")
    own = F.col("_to") == F.col("_block")
    sided = spread.withColumn("_side", F.when(own, 0).otherwise(1)).withColumn("id", F.when(own, F.col("id")))
    placed = deal(sided.drop("_block")).sortWithinPartitions("_to", "_side", "_order")

    def pieces(batches):
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in ("_to", "_side")], 1)
            starts = runs_of(keys)
            for start, end in zip(starts, np.r_[starts[1:], len(keys)].astype(int)):
                side = int(keys[start, 1])
                piece, kept = batch.slice(start, end - start), [c for c in names if c != "id" or not side]
                flat = pa.RecordBatch.from_arrays([piece.column(c).flatten() for c in kept], names=kept)
                yield int(keys[start, 0]), side, flat

    def run(batches):
        for _, group in itertools.groupby(pieces(batches), key=lambda piece: piece[0]):
            mine, met = [], []
            for _, side, piece in group:
                (met if side else mine).append(piece)
                if side:
                    break
            if mine:
                yield from work(pa.Table.from_batches(mine), itertools.chain(met, (piece for _, _, piece in group)))

    return placed.mapInArrow(run, schema)


def tiles(pieces: Iterator[pa.RecordBatch | pa.Table]) -> Iterator[pa.RecordBatch | pa.Table]:
    for piece in pieces:
        for at in range(0, piece.num_rows, TILE_COLUMNS):
            yield piece.slice(at, TILE_COLUMNS)


def combined(column) -> pa.Array:
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def run_sums(x: np.ndarray, y: np.ndarray, w: np.ndarray, starts: np.ndarray) -> Iterator[tuple[slice, np.ndarray]]:
    """For a few rows of ``x`` at a time: their distances to ``y``, weighted and summed over each run of it."""
    plain, room = (w == 1).all(), tile_room()
    runs = list(zip(starts.tolist(), [*starts[1:].tolist(), len(y)]))
    step = TILE_ROWS if x.shape[1] >= PRODUCT_WIDTH else NARROW_ROWS
    for top in range(0, len(x), CENTRED_ROWS):
        columns = Columns(y, x[top : top + CENTRED_ROWS].mean(0))
        for at in range(top, min(top + CENTRED_ROWS, len(x)), step):
            rows = slice(at, min(at + step, top + CENTRED_ROWS))
            gaps = tile_distances(x[rows], columns, room)
            if not plain:
                gaps *= w
            if len(runs) <= FEW_RUNS:
                yield rows, np.stack([gaps[:, start:end].sum(1) for start, end in runs], 1)
            else:
                yield rows, np.add.reduceat(gaps, starts, axis=1)


class ClusterSums:
    """Summed distances of a block's points to every cluster of every labeling, and the clusters' sizes."""

    def __init__(self, x: np.ndarray, noise: int):
        self.x, self.noise = x, noise
        self.places: dict[tuple[int, int], int] = {}
        self.sums = np.zeros((len(x), 0))
        self.sizes = np.zeros(0, np.int64)

    def place(self, clusters: list[tuple[int, int]]) -> list[int]:
        found = [self.places.setdefault(c, len(self.places)) for c in clusters]
        missing = len(self.places) - self.sums.shape[1]
        if missing > 0:
            # Room for more than these, so that it is not moved each time.
            room = max(missing, self.sums.shape[1] // 2, 8)
            self.sums = np.hstack([self.sums, np.zeros((len(self.x), room))])
            self.sizes = np.r_[self.sizes, np.zeros(room, np.int64)]
        return found

    def add(self, y: np.ndarray, w: np.ndarray, labels: np.ndarray) -> None:
        """Points with their labels, one column per labeling; runs of equal rows are summed as one."""
        starts = runs_of(labels)
        heads = labels[starts]
        run, labeling = np.nonzero(heads != self.noise)
        pairs = list(zip(labeling.tolist(), heads[run, labeling].tolist()))
        clusters = list(dict.fromkeys(pairs))
        if not clusters:
            return
        at = {c: i for i, c in enumerate(clusters)}
        member = np.zeros((len(starts), len(clusters)))
        member[run, [at[p] for p in pairs]] = 1.0
        places = self.place(clusters)
        self.sizes[places] += np.rint(np.add.reduceat(w, starts) @ member).astype(np.int64)
        for rows, sums in run_sums(self.x, y, w, starts):
            self.sums[rows, places] += product(sums, member, np.empty((len(sums), len(clusters))))
