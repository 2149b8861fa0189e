import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablewright.operators import dbscan as density
from tablewright.operators import kmeans
from tablewright.operators.points import squared_distance
from tablewright.plans import clustering


def points(spark, x):
    rows = [(i, [float(v) for v in p], 1) for i, p in enumerate(x)]
    return spark.createDataFrame(rows, "id bigint, x array<double>, w bigint").repartition(3)


def test_nearest_centres_are_the_first_of_the_nearest():
    draws = np.random.default_rng(5)
    x, centres = draws.integers(0, 4, (500, 3)).astype(float), draws.integers(0, 4, (6, 3)).astype(float)
    gaps = kmeans.squared_distances(x, centres)
    at, least = kmeans.nearest_centres(np.ascontiguousarray(x.T), centres)
    assert (at == gaps.argmin(1)).all()
    assert (least == gaps.min(1)).all()


def test_searches_with_the_same_core_points_are_linked_once(spark, monkeypatch):
    x = [(i % 10 * 0.1, i // 10 * 0.1) for i in range(50)] + [(9.0, 9.0 + 0.3 * i) for i in range(4)]
    given, linked = points(spark, x), []
    link = density._link_cells
    monkeypatch.setattr(density, "_link_cells", lambda *a: linked.append(1) or link(*a))
    grid = density.build_grid(given, 0.5)
    found = {m: {r["id"]: r["label"] for r in density.dbscan(given, 0.5, m, grid).collect()} for m in (2, 3, 4, 5)}
    alone = {m: {r["id"]: r["label"] for r in density.dbscan(given, 0.5, m).collect()} for m in (2, 3, 4, 5)}
    assert found == alone
    # All points are core with 2 neighbours, two of the four at the side with 3, and none of these with 4 and 5.
    assert len(linked) == 3 + 4


@pytest.mark.parametrize("d", [1, 2, 3])
def test_written_out_distances_are_the_looped_ones(spark, d):
    draws = np.random.default_rng(d)
    rows = [(draws.normal(size=d).tolist(), draws.normal(size=d).tolist(), draws.normal(size=d).tolist()) for _ in range(50)]
    rows += [([None] * d, [0.0] * d, [1.0] * d)]
    df = spark.createDataFrame(rows, "x array<double>, lo array<double>, hi array<double>")
    x, lo, hi = F.col("x"), F.col("lo"), F.col("hi")
    made = df.select(
        squared_distance(x, lo), squared_distance(x, lo, d),
        density._box_distance(x, lo, hi, True), density._box_distance(x, lo, hi, True, d),
        density._box_distance(x, lo, hi, False), density._box_distance(x, lo, hi, False, d),
    ).collect()
    for r in made:
        assert (r[0], r[2], r[4]) == (r[1], r[3], r[5])


def test_algorithms_are_searched_side_by_side(spark):
    met = threading.Barrier(2, timeout=30)

    def fit(given, n, combos):
        met.wait()
        yield clustering.Fitted(combos[0], given.withColumn("label", F.col("id") % 2))

    specs = [clustering.ClusterSpec(k, k, {"n": [1]}, fit) for k in ("a", "b")]
    given = points(spark, [(i % 2, i) for i in range(20)])
    outcomes = clustering.cluster_all(specs, given, 20, None)
    assert [o.status for o in outcomes] == ["success", "success"]
