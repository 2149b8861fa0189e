"""K-Means for several numbers of clusters and restarts at once.

All runs advance together: one scan of the points serves an iteration of every run that still moves. A task sends one row per
centre, so what an iteration exchanges does not grow with the table. Starts are chosen as by k-means||: a few passes
draw candidates far from those there are, and the driver picks among these, weighted by the rows near them.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.types import SEED

# Passes that draw candidates, and candidates that a pass draws per centre, on average.
START_ROUNDS, OVERSAMPLING = 2, 2.0
# Points that a task compares with the centres at once.
ROWS = 4096


@dataclass
class Run:
    """One clustering on its way: its centres, and the summed squared distances of the rows to them."""

    k: int
    restart: int
    centres: np.ndarray
    cost: float = np.inf


def squared_distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Summed one dimension at a time, so that equal points are at distance 0."""
    total = np.zeros((len(x), len(centres)))
    for j in range(x.shape[1]):
        total += (x[:, j, None] - centres[None, :, j]) ** 2
    return total


def nearest_centres(across: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For points given one row per dimension, the first of the nearest centres and its squared distance."""
    at = np.zeros(across.shape[1], np.int64)
    least = gap = None
    for k, centre in enumerate(centres):
        gap = np.zeros(across.shape[1])
        for v, c in zip(across, centre):
            away = v - c
            away *= away
            gap += away
        if least is None:
            least = gap
        else:
            at[gap < least] = k
            np.minimum(least, gap, out=least)
    return at, least


def _uniform(keys: np.ndarray, salt: int) -> np.ndarray:
    """A number in (0, 1) per key, by a public 64-bit mixer; the same key and salt give the same number."""
    z = keys.view(np.uint64) + np.uint64((0x9E3779B97F4A7C15 * (salt + 1)) & 0xFFFFFFFFFFFFFFFF)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((z ^ (z >> np.uint64(31))) >> np.uint64(11)).astype(float) / 2.0**53 + 2.0**-54


def _scan(points: DataFrame, schema: str, work: Callable, finish: Callable, keyed: bool = True) -> DataFrame:
    """Runs ``work(state, x, w, key)`` over blocks of each task's points, then ``finish(state)`` for its rows.

    The keys, a digest of the ids, are only made if ``keyed``.
    """

    def run(batches):
        state: dict = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            w = batch.column("w").to_numpy(zero_copy_only=False).astype(float)
            key = batch.column("key").to_numpy(zero_copy_only=False) if keyed else w
            for at in range(0, len(x), ROWS):
                work(state, x[at : at + ROWS], w[at : at + ROWS], key[at : at + ROWS])
        yield from finish(state)

    key = [F.xxhash64("id").alias("key")] if keyed else []
    return points.select("x", "w", *key).mapInArrow(run, schema)


def _starts(points: DataFrame, wanted: Sequence[tuple[int, int]], seed: int) -> list[np.ndarray]:
    """Centres to begin with for every (k, restart)."""
    salts = [seed * 1_000_003 + k * 1009 + restart * 31 for k, restart in wanted]

    def first(state, x, w, key):
        for i, salt in enumerate(salts):
            # The least of exponential waiting times falls on a row with a chance in proportion to its weight.
            wait = -np.log(_uniform(key, salt)) / w
            at = int(wait.argmin())
            if i not in state or wait[at] < state[i][0]:
                state[i] = (float(wait[at]), x[at].tolist())

    def firsts(state):
        if state:
            yield pa.RecordBatch.from_pydict(
                {"run": pa.array(list(state), pa.int32()), "wait": [s[0] for s in state.values()],
                 "x": pa.array([s[1] for s in state.values()], pa.list_(pa.float64()))}
            )

    drawn = _scan(points, "run int, wait double, x array<double>", first, firsts)
    # One row per run.
    rows = drawn.groupBy("run").agg(F.min_by("x", "wait").alias("x")).collect()
    found = [np.zeros((0, 0))] * len(wanted)
    for r in rows:
        found[r["run"]] = np.array([r["x"]])
    for turn in range(START_ROUNDS):
        costs = _costs(points, found)

        def draw(state, x, w, key, turn=turn, given=tuple(found), costs=tuple(costs)):
            for i, (k, _) in enumerate(wanted):
                if costs[i] <= 0:
                    continue
                near = squared_distances(x, given[i]).min(1) * w
                taken = _uniform(key, salts[i] + 7 * turn + 1) < OVERSAMPLING * k * near / costs[i]
                state.setdefault(i, []).extend(x[taken].tolist())

        def drawn(state):
            runs = [i for i, chosen in state.items() for _ in chosen]
            if runs:
                chosen = [c for many in state.values() for c in many]
                yield pa.RecordBatch.from_pydict(
                    {"run": pa.array(runs, pa.int32()), "x": pa.array(chosen, pa.list_(pa.float64()))}
                )

        # About OVERSAMPLING * k rows per run, whatever the size of the table.
        more: dict[int, list] = {}
        for r in _scan(points, "run int, x array<double>", draw, drawn).collect():
            more.setdefault(r["run"], []).append(r["x"])
        found = [np.vstack([c, np.array(more[i])]) if i in more else c for i, c in enumerate(found)]
    weights = _nearest_weights(points, found)
    return [
        _spread_out(c, weights[i], k, salts[i]) if c.size else c for i, (c, (k, _)) in enumerate(zip(found, wanted))
    ]


def _spread_out(candidates: np.ndarray, weights: np.ndarray, k: int, salt: int) -> np.ndarray:
    """k of the candidates, each next one drawn by its weight times its squared distance to those before."""
    draws = np.random.default_rng(salt)
    # In an order that does not depend on the tasks that drew them.
    order = np.unique(candidates, axis=0, return_index=True)[1]
    kept, mass = candidates[order], weights[order]
    chosen = [int(draws.choice(len(kept), p=mass / mass.sum()))]
    while len(chosen) < min(k, len(kept)):
        share = squared_distances(kept, kept[chosen]).min(1) * mass
        if share.sum() <= 0:
            rest = [i for i in range(len(kept)) if i not in chosen]
            chosen.append(rest[0])
        else:
            chosen.append(int(draws.choice(len(kept), p=share / share.sum())))
    return kept[chosen]


def _sums(points: DataFrame, centres: list[np.ndarray], moves: bool) -> tuple[list[np.ndarray], list[np.ndarray], list[float]]:
    """Per run: the weight and (if ``moves``) the sum of the points nearest to each centre, and the total cost."""

    def add(state, x, w, key):
        # One row per dimension and per centre: short steps along the points, which are many, not along a few centres.
        across = np.ascontiguousarray(x.T)
        weighted = across * w if moves else across[:0]
        for i, c in enumerate(centres):
            if not c.size:
                continue
            at, least = nearest_centres(across, c)
            here = np.stack([np.bincount(at, v, len(c)) for v in weighted], 1) if moves else 0
            weight, total, cost = state.get(i, (0, 0, 0.0))
            state[i] = (weight + np.bincount(at, w, len(c)), total + here, cost + float(least @ w))

    def rows(state):
        for i, (weight, total, cost) in state.items():
            places = len(weight)
            sums = total.tolist() if moves else [[]] * places
            yield pa.RecordBatch.from_arrays(
                [pa.array([i] * places, pa.int32()), pa.array(range(places), pa.int32()), pa.array(weight),
                 pa.array(sums, pa.list_(pa.float64())), pa.array([cost] + [0.0] * (places - 1))],
                names=["run", "centre", "weight", "sums", "cost"],
            )

    shape = "run int, centre int, weight double, sums array<double>, cost double"
    width = next((c.shape[1] for c in centres if c.size), 0) if moves else 0
    total = F.array(*[F.sum(F.col("sums")[j]) for j in range(width)]).cast("array<double>")
    made = _scan(points, shape, add, rows, keyed=False).groupBy("run", "centre").agg(
        F.sum("weight").alias("weight"), total.alias("sums"), F.sum("cost").alias("cost")
    )
    weights = [np.zeros(len(c)) for c in centres]
    moved = [np.zeros(c.shape) for c in centres]
    costs = [0.0] * len(centres)
    # One row per centre of every run.
    for r in made.collect():
        weights[r["run"]][r["centre"]] = r["weight"]
        costs[r["run"]] += r["cost"]
        if moves:
            moved[r["run"]][r["centre"]] = r["sums"]
    return weights, moved, costs


def _costs(points: DataFrame, centres: list[np.ndarray]) -> list[float]:
    return _sums(points, centres, False)[2]


def _nearest_weights(points: DataFrame, centres: list[np.ndarray]) -> list[np.ndarray]:
    return [w + 1e-9 for w in _sums(points, centres, False)[0]]


def kmeans_runs(
    points: DataFrame, ks: Sequence[int], restarts: int = 10, most: int = 300, tol: float = 1e-4, seed: int = SEED
) -> list[Run]:
    """Every (k, restart), finished: no centre of it moved further than ``tol``, or after ``most`` iterations.

    ``points`` are (id, x, w). A centre that has lost all its points stays where it is. Fewer distinct points than k
    give fewer centres.
    """
    wanted = [(k, restart) for k in ks for restart in range(restarts)]
    runs = [Run(k, r, c) for (k, r), c in zip(wanted, _starts(points, wanted, seed))]
    moving = [r for r in runs if r.centres.size]
    for _ in range(most):
        if not moving:
            break
        weights, sums, costs = _sums(points, [r.centres for r in moving], True)
        still = []
        for run, weight, total, cost in zip(moving, weights, sums, costs):
            held = weight[:, None] > 0
            after = np.where(held, total / np.where(held, weight[:, None], 1.0), run.centres)
            step = ((after - run.centres) ** 2).sum(1).max()
            run.centres, run.cost = after, cost
            if step > tol * tol:
                still.append(run)
        moving = still
    final = _costs(points, [r.centres for r in runs])
    for run, cost in zip(runs, final):
        run.cost = cost
    return runs


def best_runs(runs: Sequence[Run]) -> dict[int, Run]:
    """The run with the least cost for every k; the first one on a tie."""
    found: dict[int, Run] = {}
    for run in runs:
        if run.k not in found or run.cost < found[run.k].cost:
            found[run.k] = run
    return found
