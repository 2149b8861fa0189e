"""Questions about the points of crowded cells, answered from a tree of boxes that a task builds over one cell.

A box that lies wholly within reach counts as a number and one out of reach not at all, so a point is compared with the
few points near the rim of its reach, not with all of the cell.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.operators.pairs import runs_of, vectors

#: Points from which a cell gets a tree; up to there it is joined.
CROWDED = 64
#: Points of a box that is not divided.
LEAF = 32
#: Keeps rounding from settling a pair that the comparison itself would not.
MARGIN = 1e-9


class Box:
    """Points, the smallest box around them, their summed weight, and the two halves if they are many."""

    def __init__(self, x: np.ndarray, values: np.ndarray):
        self.x, self.values = x, values
        self.low, self.high, self.total = x.min(0), x.max(0), values.sum()
        self.halves: list[Box] = []
        if len(x) > LEAF:
            order = np.argpartition(x[:, (self.high - self.low).argmax()], len(x) // 2)
            self.halves = [Box(x[part], values[part]) for part in (order[: len(x) // 2], order[len(x) // 2 :])]

    def nearest(self, x: np.ndarray) -> np.ndarray:
        return (np.maximum(np.maximum(self.low - x, x - self.high), 0.0) ** 2).sum(1)

    def farthest(self, x: np.ndarray) -> np.ndarray:
        return (np.maximum(np.abs(x - self.low), np.abs(x - self.high)) ** 2).sum(1)

    def gaps(self, x: np.ndarray) -> np.ndarray:
        """Squared distances to the points, summed one dimension at a time like those of the join."""
        total = np.zeros((len(x), len(self.x)))
        for j in range(x.shape[1]):
            total += (x[:, j, None] - self.x[None, :, j]) ** 2
        return total


def count_within(root: Box, x: np.ndarray, reach2: float) -> np.ndarray:
    """For each position, the weight of the points at most that far away."""
    found = np.zeros(len(x), np.int64)
    todo = [(root, np.arange(len(x)))]
    while todo:
        box, at = todo.pop()
        inside = box.farthest(x[at]) <= reach2 * (1.0 - MARGIN)
        found[at[inside]] += box.total
        at = at[~inside & (box.nearest(x[at]) <= reach2 * (1.0 + MARGIN))]
        if not len(at):
            continue
        if box.halves:
            todo += [(half, at) for half in box.halves]
        else:
            found[at] += (box.gaps(x[at]) <= reach2) @ box.values
    return found


def nearest_point(root: Box, x: np.ndarray, reach2: float) -> tuple[np.ndarray, np.ndarray]:
    """For each position, the squared distance of the nearest point and its value, the least on a tie.

    Those further away than the reach may be any.
    """
    gap, value = np.full(len(x), np.inf), np.full(len(x), np.iinfo(np.int64).max)

    def compare(box: Box, at: np.ndarray) -> None:
        away = box.gaps(x[at])
        least = away.min(1)
        its = np.where(away == least[:, None], box.values[None, :], np.iinfo(np.int64).max).min(1)
        better = (least < gap[at]) | ((least == gap[at]) & (its < value[at]))
        gap[at[better]], value[at[better]] = least[better], its[better]

    # Down to one leaf first: what it holds bounds the search.
    todo = [(root, np.arange(len(x)))]
    while todo:
        box, at = todo.pop()
        if not box.halves:
            compare(box, at)
            continue
        left = box.halves[0].nearest(x[at]) <= box.halves[1].nearest(x[at])
        todo += [(half, part) for half, part in zip(box.halves, (at[left], at[~left])) if len(part)]
    todo = [(root, np.arange(len(x)))]
    while todo:
        box, at = todo.pop()
        at = at[box.nearest(x[at]) <= np.minimum(gap[at], reach2) * (1.0 + MARGIN)]
        if not len(at):
            continue
        if box.halves:
            todo += [(half, at) for half in box.halves]
        else:
            compare(box, at)
    return gap, value


def ask(asked: DataFrame, members: DataFrame, answer: Callable, schema: str) -> DataFrame:
    """``answer(members' positions, their values, asked positions, asked ids)`` for the two sides of each (cell, salt).

    ``asked`` is (cell, salt, id, x), ``members`` (cell, salt, x, v). A task holds the members of one cell and salt; those
    who ask stream past them. The answer is a function of the former that gives a function of the latter.
    """
    kind = asked.schema["id"].dataType
    sides = members.select("cell", "salt", F.lit(0).alias("_side"), F.lit(None).cast(kind).alias("id"), "x", "v").unionByName(
        asked.select("cell", "salt", F.lit(1).alias("_side"), "id", "x", F.lit(None).cast("bigint").alias("v"))
    )
    # A number that stays: by their bytes, which are few when positions repeat, the cells would be put into one or two tasks.
    tasks = int(asked.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = sides.repartition(tasks, "cell", "salt").sortWithinPartitions("cell", "salt", "_side")

    def pieces(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            numbers = [batch.column(c).to_numpy(zero_copy_only=False)[:, None] for c in ("salt", "_side")]
            cells = batch.column("cell").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            keys = np.hstack([cells, *numbers])
            starts = runs_of(keys)
            for start, end in zip(starts.tolist(), [*starts[1:].tolist(), len(keys)]):
                yield tuple(keys[start, :-1].tolist()), int(keys[start, -1]), batch.slice(start, end - start)

    def run(batches):
        for _, group in itertools.groupby(pieces(batches), key=lambda piece: piece[0]):
            mine, reply = [], None
            for _, side, piece in group:
                if not side:
                    mine.append(piece)
                    continue
                if not mine:
                    continue
                if reply is None:
                    x = np.vstack([vectors(p.column("x")) for p in mine])
                    values = np.concatenate([pc.fill_null(p.column("v"), -1).to_numpy(zero_copy_only=False) for p in mine])
                    reply = answer(x, values)
                yield from reply(vectors(piece.column("x")), piece.column("id"))

    return placed.mapInArrow(run, schema)


def counts_within(asked: DataFrame, members: DataFrame, reach2: float) -> DataFrame:
    """(id, n): the summed values of members at most that far away, for each cell that is asked; none without any."""

    def answer(x: np.ndarray, weights: np.ndarray):
        # Copies of a position are one point.
        places, at = np.unique(x, axis=0, return_inverse=True)
        total = np.zeros(len(places), np.int64)
        np.add.at(total, at.ravel(), weights)
        root = Box(places, total)

        def reply(y: np.ndarray, ids: pa.Array):
            found = count_within(root, y, reach2)
            some = np.flatnonzero(found)
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(some)), pa.array(found[some])], names=["id", "n"])

        return reply

    return ask(asked, members, answer, f"id {asked.schema['id'].dataType.simpleString()}, n bigint")


def nearest_values(asked: DataFrame, members: DataFrame, reach2: float) -> DataFrame:
    """(id, label, gap): the value and squared distance of the nearest member within reach, for each cell that is asked."""

    def answer(x: np.ndarray, labels: np.ndarray):
        real = np.isfinite(x).all(1)
        # Copies of a position are one point, with the least of their labels; so are copies of an asked one.
        places, at = np.unique(x[real], axis=0, return_inverse=True)
        least = np.full(len(places), np.iinfo(np.int64).max)
        np.minimum.at(least, at.ravel(), labels[real])
        root = Box(places, least) if real.any() else None

        def reply(y: np.ndarray, ids: pa.Array):
            if root is None:
                return
            spots, at = np.unique(y, axis=0, return_inverse=True)
            gap, label = (found[at.ravel()] for found in nearest_point(root, spots, reach2))
            some = np.flatnonzero(gap <= reach2)
            yield pa.RecordBatch.from_arrays(
                [ids.take(pa.array(some)), pa.array(label[some]), pa.array(gap[some])], names=["id", "label", "gap"]
            )

        return reply

    return ask(asked, members, answer, f"id {asked.schema['id'].dataType.simpleString()}, label bigint, gap double")
