"""Sums over the distances of all pairs of points on a line or in a plane, in which only neighbours meet one by one.

The points are cut into a tree of boxes. Away from 0 a distance is a smooth function, so between two boxes whose gap is at least
GAP times the half side of either it is interpolated from NODES Chebyshev nodes in each dimension: that errs by less than
1e-12 of the distance, less than what the order of a sum changes in it. Points of nearer boxes are compared one by one.
A box and its neighbours are the work of one task; time grows as n log n, and a task holds the nodes of the tree (at
most about 2 * LEAVES boxes) and the points around one leaf.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.functions.storage import cut_lineage
from tablewright.operators.pairs import combined, meet, product, run_sums, runs_of, tile_distances, Columns, tiles, vectors

#: Dimensions up to which nodes are few enough, and points from which a tree is worth its while.
DIMENSIONS, MANY = 2, 30_000
#: Chebyshev nodes per dimension, and the gap of far boxes in half sides.
NODES, GAP = 14, 3.0
#: Points of a leaf, unless that makes too many leaves; points whose places decide where boxes are cut.
LEAF_POINTS, LEAVES, GUIDES = 1024, 2048, 65_536
#: Groups of points that a task sums apart.
GROUPS = 4096


def applies(points: DataFrame, n: int) -> bool:
    """Whether all ``n`` points have finite positions of few dimensions, and are many."""
    if n < MANY:
        return False
    odd = F.exists("x", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) > 1e150))
    row = points.agg(
        F.min(F.size("x")).alias("least"), F.max(F.size("x")).alias("most"), F.count_if(F.col("x").isNull() | odd).alias("odd")
    ).first()
    return row["odd"] == 0 and 1 <= row["least"] == row["most"] <= DIMENSIONS


@dataclass
class Boxes:
    """A tree of boxes. Children come behind their parent; ``leaf`` is a leaf's number, or -1."""

    axis: list[int] = field(default_factory=list)
    cut: list[float] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    leaf: list[int] = field(default_factory=list)
    leaves: int = 0

    def grow(self, guides: np.ndarray, size: int) -> int:
        """Add the box of these points, halved along its longer side until ``size`` points or one place are left."""
        at = len(self.axis)
        for column in (self.axis, self.cut, self.left, self.right, self.leaf):
            column.append(-1)
        extent = np.ptp(guides, axis=0) if len(guides) else np.zeros(1)
        if len(guides) <= size or extent.max() <= 0:
            self.leaf[at], self.leaves = self.leaves, self.leaves + 1
            return at
        axis = int(extent.argmax())
        values = guides[:, axis]
        cut = np.partition(values, len(values) // 2)[len(values) // 2]
        if cut >= values.max():
            cut = values[values < cut].max()
        self.axis[at], self.cut[at] = axis, float(cut)
        low = values <= cut
        self.left[at] = self.grow(guides[low], size)
        self.right[at] = self.grow(guides[~low], size)
        return at

    def leaf_of(self, x: np.ndarray) -> np.ndarray:
        axis, cut, left, right, leaf = (np.array(c) for c in (self.axis, self.cut, self.left, self.right, self.leaf))
        at = np.zeros(len(x), np.int64)
        while True:
            open_ = np.flatnonzero(leaf[at] < 0)
            if not len(open_):
                return leaf[at]
            here = at[open_]
            low = x[open_, axis[here]] <= cut[here]
            at[open_] = np.where(low, left[here], right[here])


def _unit_nodes(count: int) -> np.ndarray:
    return np.cos((2 * np.arange(count) + 1) * np.pi / (2 * count))


def node_counts(lo: np.ndarray, hi: np.ndarray) -> list[int]:
    """A side without extent needs one node only."""
    return [NODES if b > a else 1 for a, b in zip(lo, hi)]


def nodes_of(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """The interpolation nodes of a box, the last dimension varying fastest."""
    sides = [(a + b) / 2 + (b - a) / 2 * _unit_nodes(k) for a, b, k in zip(lo, hi, node_counts(lo, hi))]
    return np.stack([g.ravel() for g in np.meshgrid(*sides, indexing="ij")], 1)


def node_shares(x: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Per point the value of each node's polynomial: what interpolates a function at the point from the nodes."""
    made = np.ones((len(x), 1))
    for j, count in enumerate(node_counts(lo, hi)):
        if count == 1:
            continue
        t = np.clip((2 * x[:, j] - lo[j] - hi[j]) / (hi[j] - lo[j]), -1.0, 1.0)
        k = np.arange(1, count)
        at_points = np.cos(np.arccos(t)[:, None] * k)
        at_nodes = np.cos(np.arccos(_unit_nodes(count))[:, None] * k)
        side = (1.0 + 2.0 * product(at_points, at_nodes.T, np.empty((len(x), count)))) / count
        made = (made[:, :, None] * side[:, None, :]).reshape(len(x), -1)
    return made


@dataclass
class FarField:
    """Boxes with their extents, and for each the groups of its points with their weights moved to the nodes.

    ``far`` and ``near`` list per leaf the boxes that it meets through nodes and the leaves that it meets point by point.
    """

    boxes: Boxes
    lo: np.ndarray
    hi: np.ndarray
    groups: list[np.ndarray]
    moments: list[np.ndarray]
    node: list[int]
    far: list[np.ndarray]
    near: list[np.ndarray]
    n_groups: int

    def leaf_of(self, own: pa.Table) -> int:
        return int(self.boxes.leaf_of(vectors(combined(own.column("x").slice(0, 1))))[0])

    def potential(self, leaf: int) -> np.ndarray:
        """Summed distances of each node of a leaf's box to the far points of every group."""
        at = self.node[leaf]
        mine = nodes_of(self.lo[at], self.hi[at])
        total = np.zeros((len(mine), self.n_groups))
        room = np.empty((2, len(mine) * NODES**DIMENSIONS))
        for other in self.far[leaf]:
            theirs = nodes_of(self.lo[other], self.hi[other])
            gaps = tile_distances(mine, Columns(theirs, theirs[0]), room)
            moved = self.moments[other]
            total[:, self.groups[other]] += product(gaps, moved, np.empty((len(mine), moved.shape[1])))
        return total


def _gaps(lo: np.ndarray, hi: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    apart = np.maximum(np.maximum(lo[a] - hi[b], lo[b] - hi[a]), 0.0)
    return np.sqrt((apart**2).sum(1))


def far_field(boxes: Boxes, summary: pa.Table, n_groups: int, width: int) -> FarField:
    """From the leaves' extents, groups and moments: those of all boxes, and who meets whom."""
    count = len(boxes.axis)
    lo, hi = np.full((count, width), np.inf), np.full((count, width), -np.inf)
    groups: list[np.ndarray] = [np.zeros(0, np.int64)] * count
    moments: list[np.ndarray] = [np.zeros((1, 0))] * count
    node = np.flatnonzero(np.array(boxes.leaf) >= 0)
    for row in range(summary.num_rows):
        at = node[summary.column("leaf")[row].as_py()]
        lo[at], hi[at] = (summary.column(c)[row].values.to_numpy() for c in ("lo", "hi"))
        groups[at] = summary.column("groups")[row].values.to_numpy().astype(np.int64)
        moments[at] = summary.column("moments")[row].values.to_numpy().reshape(-1, len(groups[at]))
    for at in range(count - 1, -1, -1):
        if boxes.leaf[at] >= 0:
            continue
        children = [c for c in (boxes.left[at], boxes.right[at]) if len(groups[c])]
        if not children:
            continue
        lo[at], hi[at] = lo[children].min(0), hi[children].max(0)
        groups[at] = np.unique(np.concatenate([groups[c] for c in children]))
        moments[at] = np.zeros((math.prod(node_counts(lo[at], hi[at])), len(groups[at])))
        for c in children:
            shares = node_shares(nodes_of(lo[c], hi[c]), lo[at], hi[at])
            moments[at][:, np.searchsorted(groups[at], groups[c])] += shares.T @ moments[c]
    half = np.where(np.isfinite(lo), (hi - lo) / 2, 0.0).max(1)
    filled = np.array([len(g) > 0 for g in groups])
    left, right, leaf = (np.array(c) for c in (boxes.left, boxes.right, boxes.leaf))
    # All pairs of a leaf and a box, from the root down, until they are far apart or leaves.
    mine = node[filled[node]]
    theirs = np.zeros(len(mine), np.int64)
    far, near = [], []
    while len(mine):
        apart = _gaps(lo, hi, mine, theirs)
        meet_far = (apart > 0) & (apart >= GAP * np.maximum(half[mine], half[theirs]))
        far.append(np.stack([leaf[mine[meet_far]], theirs[meet_far]], 1))
        last = ~meet_far & (leaf[theirs] >= 0)
        near.append(np.stack([leaf[mine[last]], leaf[theirs[last]]], 1))
        on = ~meet_far & ~last
        mine, theirs = np.repeat(mine[on], 2), np.stack([left[theirs[on]], right[theirs[on]]], 1).ravel()
        kept = filled[theirs]
        mine, theirs = mine[kept], theirs[kept]
    return FarField(
        boxes, lo, hi, groups, moments, node.tolist(), _lists(far, boxes.leaves), _lists(near, boxes.leaves), n_groups
    )


def _lists(pairs: list[np.ndarray], count: int) -> list[np.ndarray]:
    every = np.concatenate(pairs)
    every = every[np.lexsort((every[:, 1], every[:, 0]))]
    return np.split(every[:, 1], np.searchsorted(every[:, 0], np.arange(1, count)))


def group_sums(
    rows: DataFrame,
    n: int,
    n_groups: int,
    work: Callable[[pa.Table, np.ndarray, FarField, Iterator], Iterator[pa.RecordBatch]],
    schema: str,
    leaf_points: int = LEAF_POINTS,
) -> DataFrame:
    """``work`` over the points (id, x, w, group) of every leaf, with the far field and the points around it.

    ``work`` gets the leaf's rows, its potential per group, the far field and the pieces of the points that are near, its own among
    them. Groups are numbers below ``n_groups``; ids are only used to spread the points.
    """
    spark = rows.sparkSession
    guides = rows.select(F.xxhash64("id").alias("k"), "x").orderBy("k").limit(GUIDES).select("x").toArrow()
    guides = vectors(combined(guides.column("x")))
    boxes = Boxes()
    per_leaf = max(leaf_points, math.ceil(n / LEAVES))
    boxes.grow(guides, max(1, round(len(guides) * per_leaf / max(n, 1))))
    names, kinds = rows.columns, {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    # Broadcasts are read where this package may not be installed, so they hold plain values.
    cutting = spark.sparkContext.broadcast(vars(boxes))

    def place(batches):
        cut = Boxes(**cutting.value)
        for batch in batches:
            if batch.num_rows:
                leaves = cut.leaf_of(vectors(batch.column("x")))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaves, pa.int32())], names=[*names, "leaf"])

    shape = ", ".join([*[f"`{c}` {kinds[c]}" for c in names], "leaf int"])
    tasks = min(boxes.leaves, max(48, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    placed = rows.select(*names).mapInArrow(place, shape).repartition(tasks, "leaf").sortWithinPartitions("leaf", "group")
    placed = cut_lineage(placed)

    def summarize(batches):
        for leaf, table in _by_leaf(batches):
            x, w = vectors(combined(table.column("x"))), table.column("w").to_numpy().astype(float)
            lo, hi = x.min(0), x.max(0)
            group = table.column("group").to_numpy()
            order = np.argsort(group, kind="stable")
            starts = runs_of(group[order])
            weighted = node_shares(x, lo, hi)[order] * w[order][:, None]
            moved = np.add.reduceat(weighted, starts, axis=0).T
            yield pa.RecordBatch.from_pydict({
                "leaf": pa.array([leaf], pa.int32()), "lo": [lo.tolist()], "hi": [hi.tolist()],
                "groups": pa.array([group[order][starts].tolist()], pa.list_(pa.int32())),
                "moments": pa.array([moved.ravel()], pa.list_(pa.float64())),
            })

    shape = "leaf int, lo array<double>, hi array<double>, groups array<int>, moments array<double>"
    # At most LEAVES or so rows.
    summary = placed.select("x", "w", "group", "leaf").mapInArrow(summarize, shape).toArrow()
    field_ = far_field(boxes, summary, n_groups, guides.shape[1])
    given = spark.sparkContext.broadcast(vars(field_) | {"boxes": vars(boxes)})
    # To whom a leaf's points travel: to all that have it nearby, itself among them as their own rows.
    to: dict[int, list[int]] = {}
    for leaf, others in enumerate(field_.near):
        for other in others.tolist():
            if other != leaf:
                to.setdefault(other, []).append(leaf)
    targets = spark.createDataFrame([(leaf, to.get(leaf, [])) for leaf in range(boxes.leaves)], "_block int, _others array<int>")

    def run(own, others):
        known = FarField(**given.value | {"boxes": Boxes(**given.value["boxes"])})
        yield from work(own, known.potential(known.leaf_of(own)), known, _both(own, others))

    return meet(placed.select(*names, "leaf"), "leaf", targets, tasks, "group", run, schema)


def _by_leaf(batches) -> Iterator[tuple[int, pa.Table]]:
    held, leaf = [], None
    for batch in batches:
        leaves = batch.column("leaf").to_numpy(zero_copy_only=False)
        starts = runs_of(leaves) if len(leaves) else []
        for start, end in zip(starts, [*starts[1:], len(leaves)]):
            if held and leaves[start] != leaf:
                yield int(leaf), pa.Table.from_batches(held)
                held = []
            leaf = leaves[start]
            held.append(batch.slice(start, end - start))
    if held:
        yield int(leaf), pa.Table.from_batches(held)


def _both(own, others):
    yield from tiles([own])
    yield from tiles(others)


def point_sums(own: pa.Table, potential: np.ndarray, given: FarField, pieces: Iterator) -> np.ndarray:
    """Per point of a leaf the summed distances to all points of each group."""
    x = vectors(combined(own.column("x")))
    at = given.node[given.leaf_of(own)]
    sums = product(node_shares(x, given.lo[at], given.hi[at]), potential, np.empty((len(x), given.n_groups)))
    for piece in pieces:
        group = combined(piece.column("group")).to_numpy(zero_copy_only=False)
        starts = runs_of(group)
        w = combined(piece.column("w")).to_numpy(zero_copy_only=False).astype(float)
        member = np.zeros((len(starts), given.n_groups)) if len(np.unique(group[starts])) < len(starts) else None
        if member is not None:
            member[np.arange(len(starts)), group[starts]] = 1.0
        for part, found in run_sums(x, vectors(combined(piece.column("x"))), w, starts):
            if member is None:
                sums[part, group[starts]] += found
            else:
                sums[part] += product(found, member, np.empty((len(found), given.n_groups)))
    return sums
