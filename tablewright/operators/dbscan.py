"""Density clustering over a grid whose cells are narrower than the neighbourhood.

Any two points of one cell are neighbours, so a cell with enough points settles all of them at
once, however many there are. Only points of sparse cells are compared one by one, each with the
points of nearby cells; a crowded cell therefore meets few points, never itself.
"""

from __future__ import annotations

import itertools
import math
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.functions.storage import cut_lineage, join_small
from tablewright.operators.clusters import NOISE
from tablewright.operators.components import connected_components
from tablewright.operators.crowds import CROWDED, counts_within
from tablewright.operators.points import WRITTEN_OUT, dense_numbers, squared_distance

# Dimensions used to look up nearby cells: 3 to this power look-ups per cell.
_LOOKUP_DIMENSIONS = 3
# A cell with more points is spread over several tasks when others are compared with it.
_SALT_ROWS = 500_000
# Crowded cells up to which their counted table is broadcast.
_FEW_CELLS = 100_000


@dataclass
class Grid:
    """Points with their cells, the cells, and which cells are within reach of each other."""

    eps: float
    points: DataFrame  # id, x, w, cell, salt
    cells: DataFrame  # cell, n, salts, lo, hi
    near: DataFrame  # cell, other: distinct cells that may hold neighbours, both directions
    d: int | None = None  # dimensions
    # By the number of core points: the clustering of those. Asking for more neighbours only takes core points away, so as many
    # core points are the same ones.
    found: dict[int, DataFrame] = field(default_factory=dict)


def build_grid(points: DataFrame, eps: float) -> Grid:
    """Lay the grid; two jobs for shape and spread, then written to the shared folder."""
    sizes = points.agg(F.max(F.size("x")).alias("d")).first()
    d = sizes["d"] or 1
    spread = points.agg(*[F.stddev_pop(F.col("x")[j]).alias(f"s{j}") for j in range(d)]).first()
    lookup = sorted(range(d), key=lambda j: (-(spread[f"s{j}"] or 0.0), j))[:_LOOKUP_DIMENSIONS]
    side = eps / math.sqrt(d) * (1.0 - 1e-12)
    celled = points.select(
        "id", "x", "w", F.transform("x", lambda v: F.floor(v / side)).alias("cell")
    )
    corners = [
        F.array(*[f(F.col("x")[j]) for j in range(d)]).alias(n)
        for f, n in ((F.min, "lo"), (F.max, "hi"))
    ]
    cells = cut_lineage(
        celled.groupBy("cell")
        .agg(F.sum("w").alias("n"), F.count(F.lit(1)).alias("size"), *corners)
        .withColumn("salts", F.ceil(F.col("size") / _SALT_ROWS).cast("int"))
    )
    crowded = cells.where(F.col("salts") > 1).select("cell", "salts")
    # At most (all points / _SALT_ROWS) rows; sent to every task while they are few.
    if crowded.count() <= _FEW_CELLS:
        crowded = F.broadcast(crowded)
    placed = celled.join(crowded, "cell", "left").withColumn(
        "salt", F.pmod(F.xxhash64("id"), F.coalesce("salts", F.lit(1))).cast("int")
    )
    near = cut_lineage(_near_cells(cells.select("cell"), d, lookup))
    return Grid(eps, placed.select("id", "x", "w", "cell", "salt"), cells, near, d)


def _near_cells(cells: DataFrame, d: int, lookup: list[int]) -> DataFrame:
    """Pairs of different cells at most eps apart, found through coarse cells on few dimensions."""
    reach = math.floor(math.sqrt(d)) + 2
    coarse = F.array(*[F.floor(F.col("cell")[j] / reach) for j in lookup])
    offsets = [
        F.array(*[(F.floor(F.col("cell")[j] / reach) + o) for j, o in zip(lookup, step, strict=True)])
        for step in itertools.product((-1, 0, 1), repeat=len(lookup))
    ]
    left = cells.select("cell", F.explode(F.array(*offsets)).alias("coarse"))
    right = cells.select(F.col("cell").alias("other"), coarse.alias("coarse"))
    gaps = F.zip_with(
        "cell", "other", lambda a, b: F.greatest(F.abs(a - b) - 1, F.lit(0)).cast("double")
    )
    gap = F.aggregate(gaps, F.lit(0.0), lambda s, g: s + g * g)
    pairs = left.join(right, "coarse")
    return pairs.where((F.col("cell") != F.col("other")) & (gap <= d * (1.0 + 1e-9))).select(
        "cell", "other"
    )


def _squares(parts: list[Column]) -> Column:
    return reduce(lambda s, v: s + v * v, parts, F.lit(0.0))


def _box_distance(x: Column, lo: Column, hi: Column, farthest: bool, d: int | None = None) -> Column:
    """Squared distance from a point to the nearest (or farthest) spot of a box; few dimensions are written out."""
    if d is not None and 0 < d <= WRITTEN_OUT:
        sides = [tuple(F.get(c, F.lit(j)) for c in (x, lo, hi)) for j in range(d)]
        if farthest:
            return _squares([F.greatest(F.abs(v - a), F.abs(v - b)) for v, a, b in sides])
        return _squares([F.greatest(a - v, v - b, F.lit(0.0)) for v, a, b in sides])
    if farthest:
        parts = F.zip_with(
            F.zip_with(x, lo, lambda a, b: F.abs(a - b)),
            F.zip_with(x, hi, lambda a, b: F.abs(a - b)),
            lambda p, q: F.greatest(p, q),
        )
    else:
        parts = F.zip_with(
            F.zip_with(lo, x, lambda a, b: a - b),
            F.zip_with(x, hi, lambda a, b: a - b),
            lambda p, q: F.greatest(p, q, F.lit(0.0)),
        )
    return F.aggregate(parts, F.lit(0.0), lambda s, v: s + v * v)


def neighbor_counts(grid: Grid, subjects: DataFrame | None = None) -> DataFrame:
    """(id, neighbors): points within eps of each subject, itself and its copies included.

    Own cells and cells wholly within reach count as a number. The remaining ones are compared point by point if they
    are small, and box by box if they are crowded.
    """
    reach2 = grid.eps * grid.eps
    subjects = grid.points if subjects is None else subjects
    sizes = grid.cells.select("cell", "n")
    own = subjects.join(sizes, "cell").select("id", "n")
    boxes = grid.cells.select(F.col("cell").alias("other"), "n", "size", "salts", "lo", "hi")
    around = subjects.select("id", "x", "cell").join(grid.near, "cell").join(boxes, "other")
    far = _box_distance(F.col("x"), F.col("lo"), F.col("hi"), True, grid.d)
    nearest = _box_distance(F.col("x"), F.col("lo"), F.col("hi"), False, grid.d)
    # The margin keeps rounding from settling a pair that the comparison itself would not.
    inside = far <= reach2 * (1.0 - 1e-9)
    whole = around.where(inside).select("id", "n")
    part = around.where(~inside & (nearest <= reach2 * (1.0 + 1e-9)))
    met = _meet(part.where(F.col("size") <= CROWDED), grid.points, reach2, grid.d).select("id", F.col("w").alias("n"))
    salts = F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt")
    asked = part.where(F.col("size") > CROWDED).select("id", "x", F.col("other").alias("cell"), salts)
    crowded = grid.cells.where((F.col("size") > CROWDED) & ~F.exists("lo", F.isnull)).select("cell")
    members = grid.points.join(crowded, "cell").select("cell", "salt", "x", F.col("w").alias("v"))
    return (
        own.unionByName(whole)
        .unionByName(met)
        .unionByName(counts_within(asked, members, reach2))
        .groupBy("id")
        .agg(F.sum("n").alias("neighbors"))
    )


def _meet(part: DataFrame, members: DataFrame, reach2: float, d: int | None = None) -> DataFrame:
    """Join subjects (id, x, other, salts) with the members of the other cell within reach."""
    salted = part.select(
        "id",
        F.col("x").alias("x0"),
        "other",
        F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"),
    )
    others = members.select(F.col("cell").alias("other"), "salt", "x", "w")
    joined = salted.join(others, ["other", "salt"])
    return joined.where(squared_distance(F.col("x0"), F.col("x"), d) <= reach2)


def core_points(grid: Grid, min_samples: int) -> DataFrame:
    """The grid's points with ``is_core``: at least ``min_samples`` points within eps."""
    dense = grid.cells.where(F.col("n") >= min_samples).select("cell", F.lit(True).alias("dense"))
    marked = grid.points.join(dense, "cell", "left")
    sparse = marked.where(F.col("dense").isNull()).drop("dense")
    counts = neighbor_counts(grid, sparse)
    settled = marked.where(F.col("dense")).drop("dense").withColumn("is_core", F.lit(True))
    decided = sparse.join(counts, "id").withColumn(
        "is_core", F.col("neighbors") >= min_samples
    )
    return settled.unionByName(decided.drop("neighbors"))


def dbscan(points: DataFrame, eps: float, min_samples: int, grid: Grid | None = None) -> DataFrame:
    """(id, is_core, label): clusters numbered by their least core id, noise is -1.

    A border point joins the first-numbered cluster that has a core point within eps of it.
    """
    grid = grid or build_grid(points, eps)
    reach2 = eps * eps
    marked = cut_lineage(core_points(grid, min_samples))
    core = marked.where("is_core")
    cores = core.count()
    if cores not in grid.found:
        grid.found[cores] = cut_lineage(_clustered(points, grid, marked, core, reach2))
    return grid.found[cores]


def _clustered(points: DataFrame, grid: Grid, marked: DataFrame, core: DataFrame, reach2: float) -> DataFrame:
    """(id, is_core, label) of the ``marked`` points."""
    d = points.select(F.size("x").alias("d")).first()
    if d is None:
        return marked.select("id", "is_core", F.lit(NOISE).cast("bigint").alias("label"))
    corners = [
        F.array(*[f(F.col("x")[j]) for j in range(d["d"])]).alias(n)
        for f, n in ((F.min, "lo"), (F.max, "hi"))
    ]
    # All core points of a cell belong together, so the cell stands for them.
    groups = cut_lineage(
        core.groupBy("cell").agg(
            F.min("id").alias("v"), F.max("salt").alias("last_salt"), *corners
        )
    )
    components = _link_cells(grid, core, groups, reach2)
    numbered = dense_numbers(components.select("root").distinct(), "root", "label")
    labels = cut_lineage(
        join_small(groups.join(components, "v"), numbered, "root").select(
            "cell", "label", "last_salt"
        )
    )
    cores = core.join(labels.drop("last_salt"), "cell").select("id", "is_core", "label")
    rest = marked.where(~F.col("is_core"))
    own = rest.join(labels, "cell").select("id", "label")
    around = (
        rest.join(grid.near, "cell")
        .join(labels.select(F.col("cell").alias("other"), "last_salt"), "other")
        .withColumn("salts", F.col("last_salt") + 1)
    )
    seen = _meet(around, core, reach2, grid.d).select("id", "other")
    near = seen.join(labels.select(F.col("cell").alias("other"), "label"), "other")
    border = own.unionByName(near.select("id", "label")).groupBy("id").agg(F.min("label").alias("label"))
    others = rest.join(border, "id", "left").select(
        "id", "is_core", F.coalesce("label", F.lit(NOISE)).cast("bigint").alias("label")
    )
    return cores.unionByName(others)


def _link_cells(grid: Grid, core: DataFrame, groups: DataFrame, reach2: float) -> DataFrame:
    """(v, root) over cells with core points; cells are linked if two core points are close.

    Boxes decide most pairs. For the rest, and only between cells not linked already, the core
    point nearest to the other box is tried first, then all candidates.
    """
    a = groups.select("cell", F.col("v").alias("u"), F.col("lo").alias("alo"), F.col("hi").alias("ahi"))
    b = groups.select(
        F.col("cell").alias("other"), "v", F.col("lo").alias("blo"), F.col("hi").alias("bhi"), "last_salt"
    )
    pairs = grid.near.join(a, "cell").join(b, "other")
    wide = F.zip_with(
        F.zip_with("ahi", "blo", lambda p, q: p - q),
        F.zip_with("bhi", "alo", lambda p, q: p - q),
        lambda p, q: F.greatest(p, q),
    )
    gap = F.zip_with(
        F.zip_with("alo", "bhi", lambda p, q: p - q),
        F.zip_with("blo", "ahi", lambda p, q: p - q),
        lambda p, q: F.greatest(p, q, F.lit(0.0)),
    )

    def squares(parts: Column) -> Column:
        return F.aggregate(parts, F.lit(0.0), lambda s, v: s + v * v)

    judged = pairs.select(
        "cell", "other", "u", "v", "blo", "bhi", "last_salt",
        (squares(wide) <= reach2 * (1.0 - 1e-9)).alias("sure"),
        (squares(gap) <= reach2 * (1.0 + 1e-9)).alias("possible"),
    ).where("possible")
    judged = cut_lineage(judged)
    vertices = groups.select("v")
    edges = judged.where("sure").select("u", "v")
    found = cut_lineage(connected_components(vertices, edges))

    open_pairs = cut_lineage(_between(judged.where(~F.col("sure")), found))
    if open_pairs.isEmpty():
        return found
    nearest = _box_distance(F.col("x"), F.col("blo"), F.col("bhi"), False, grid.d)
    # Only a number per pair is gathered from all the points; the few that are as near as that are looked up again.
    facing = core.select("cell", "x").join(open_pairs, "cell").withColumn("gap", nearest)
    least = facing.groupBy("cell", "other").agg(F.min("gap").alias("least"))
    probes = (
        facing.join(cut_lineage(least), ["cell", "other"])
        .where("gap = least")
        .groupBy("u", "v", "other", "last_salt")
        .agg(F.any_value("x").alias("x"))
    )
    tried = probes.select(
        F.struct("u", "v").alias("id"), "x", "other", (F.col("last_salt") + 1).alias("salts")
    )
    hits = _meet(tried, core, reach2, grid.d).select("id.u", "id.v").distinct()
    linked = found.select(F.col("v").alias("u"), F.col("root").alias("v"))
    found = cut_lineage(connected_components(vertices, linked.unionByName(hits)))

    open_pairs = _between(open_pairs, found).where(F.col("u") < F.col("v"))
    candidates = (
        core.select("cell", "x")
        .join(open_pairs, "cell")
        .where(nearest <= reach2 * (1.0 + 1e-9))
        .select(F.struct("u", "v").alias("id"), "x", "other", (F.col("last_salt") + 1).alias("salts"))
    )
    hits = cut_lineage(_meet(candidates, core, reach2, grid.d).select("id.u", "id.v").distinct())
    if hits.isEmpty():
        return found
    linked = found.select(F.col("v").alias("u"), F.col("root").alias("v"))
    return cut_lineage(connected_components(vertices, linked.unionByName(hits)))


def _between(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """Pairs whose two sides are still in different components."""
    left = found.select(F.col("v").alias("u"), F.col("root").alias("_ru"))
    right = found.select("v", F.col("root").alias("_rv"))
    joined = pairs.join(left, "u").join(right, "v")
    return joined.where(F.col("_ru") != F.col("_rv")).drop("_ru", "_rv")
