import numpy as np
import pyarrow as pa
import pytest

from tablewright.operators import far
from tablewright.operators.clusters import cluster_distance_sums, many_silhouette_points


@pytest.mark.parametrize("shape", ["lines", "groups", "copies"])
def test_far_sums_equal_those_of_all_pairs(spark, monkeypatch, shape):
    draws, n = np.random.default_rng(7), 1200
    if shape == "lines":
        x = np.stack([draws.uniform(-2, 2, n), draws.integers(0, 9, n) * 0.3], 1)
    elif shape == "groups":
        x = np.stack([draws.integers(0, 4, n) * 1000 + draws.uniform(-1, 10, n), draws.integers(0, 25, n).astype(float)], 1)
    else:
        x = np.repeat(draws.normal(size=(n // 60, 1)), 60, axis=0)
    first = np.clip((x[:, 0] * 2).astype(int) % 5 - 1, -1, 3)
    rows = [(i, x[i].tolist(), int(1 + i % 3), [int(first[i]), i % 3]) for i in range(n)]
    points = spark.createDataFrame(rows, "id bigint, x array<double>, w bigint, labels array<bigint>").repartition(3).cache()
    labelled = points.selectExpr("id", "x", "w", "labels[0] + 7 * labels[1] as label")

    def made():
        scores = {(r["id"], r["labeling"], r["label"]): r["silhouette"] for r in many_silhouette_points(points, n).collect()}
        sums = {(r["label"], r["other"]): r["total"] for r in cluster_distance_sums(labelled, n).collect()}
        return scores, sums

    scores, sums = made()
    met = []
    monkeypatch.setattr(far, "MANY", 100)
    given = far.group_sums
    monkeypatch.setattr(far, "group_sums", lambda *a: met.append(1) or given(*a, leaf_points=32))
    near_scores, near_sums = made()
    assert len(met) == 2
    assert near_scores == pytest.approx(scores, abs=1e-11)
    assert near_sums == pytest.approx(sums, rel=1e-11)
    # The same number from both sides.
    assert all(near_sums[b, a] == total for (a, b), total in near_sums.items())


def test_far_sums_leave_most_points_to_the_nodes():
    draws = np.random.default_rng(3)
    x = draws.uniform(size=(20_000, 2))
    boxes = far.Boxes()
    boxes.grow(x, 100)
    leaves = boxes.leaf_of(x)
    summary = []
    for leaf in range(boxes.leaves):
        mine = x[leaves == leaf]
        lo, hi = mine.min(0), mine.max(0)
        summary.append({
            "leaf": leaf, "lo": lo.tolist(), "hi": hi.tolist(), "groups": [0], "moments": far.node_shares(mine, lo, hi).sum(0).tolist(),
        })
    field = far.far_field(boxes, pa.Table.from_pylist(summary), 1, 2)
    sizes = np.bincount(leaves)
    met = sum(int(sizes[leaf]) * int(sizes[near].sum()) for leaf, near in enumerate(field.near))
    assert met < 0.3 * len(x) ** 2
    assert max(len(f) for f in field.far) < 200


def test_odd_positions_meet_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(far, "MANY", 1)
    rows = lambda *xs: spark.createDataFrame([(x,) for x in xs], "x array<double>")
    assert far.applies(rows([1.0, 2.0], [0.0, 0.0]), 2)
    assert not far.applies(rows([1.0, None], [0.0, 0.0]), 2)
    assert not far.applies(rows([1.0, float("nan")], [0.0, 0.0]), 2)
    assert not far.applies(rows([1.0, 2.0], None), 2)
    assert not far.applies(rows([1.0, 2.0], [1.0]), 2)
    assert not far.applies(rows([1.0, 2.0, 3.0]), 1)
