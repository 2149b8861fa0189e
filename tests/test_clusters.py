from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablewright.operators import dbscan as density
from tablewright.operators import kmeans
from tablewright.operators.clusters import (
    cluster_counts,
    cluster_sizes,
    davies_bouldin,
    projection,
    score_clustering,
    score_labelings,
    silhouette,
    silhouette_points,
)
from tablewright.operators.components import connected_components
from tablewright.operators.hierarchy import labels_for, merge, micro_clusters
from tablewright.operators.nearest import nearest_reference, nearest_within
from tablewright.operators.points import dense_numbers, over_block_pairs, points_of
from tablewright.plans import clustering
from tablewright.types import ConfigError, TaskConfig


def frame(spark, x, labels=None, w=None):
    n = len(x)
    labels = [0] * n if labels is None else labels
    w = [1] * n if w is None else w
    rows = [
        (i, [float(v) for v in x[i]], int(w[i]), int(labels[i])) for i in range(n)
    ]
    return spark.createDataFrame(rows, "id bigint, x array<double>, w bigint, label bigint").repartition(5)


def gaps(x):
    return np.sqrt(((x[:, None, :] - x[None, :, :]) ** 2).sum(-1))


def brute_silhouette(x, labels):
    d, out = gaps(x), []
    for i in range(len(x)):
        own = labels == labels[i]
        if own.sum() == 1:
            out.append(0.0)
            continue
        a = d[i, own].sum() / (own.sum() - 1)
        b = min(d[i, labels == c].mean() for c in set(labels.tolist()) if c != labels[i])
        out.append((b - a) / max(a, b))
    return np.array(out)


def brute_dbscan(x, eps, m, w=None):
    w = np.ones(len(x)) if w is None else np.array(w)
    near = ((x[:, None, :] - x[None, :, :]) ** 2).sum(-1) <= eps * eps
    core, label, k = near @ w >= m, np.full(len(x), -1), 0
    for i in range(len(x)):
        if label[i] != -1 or not core[i]:
            continue
        label[i], stack = k, [i]
        while stack:
            p = stack.pop()
            if core[p]:
                for q in np.flatnonzero(near[p] & (label == -1)):
                    label[q] = k
                    stack.append(q)
        k += 1
    return core, label


@pytest.fixture(scope="module")
def blobs():
    rng = np.random.default_rng(0)
    x = np.vstack([rng.normal(-5, 0.3, (15, 2)), rng.normal(5, 0.3, (15, 2)), rng.normal(0, 0.3, (5, 2))])
    return x, np.array([0] * 15 + [1] * 15 + [-1] * 5)


@pytest.mark.parametrize(
    ("labels", "valid"),
    [
        ([0, 0, 0, 1, 1, 1], True), ([0] * 5, False), ([0, 1, 2, 3, 4], False),
        ([-1] * 5, False), ([0, 0, 0, 1, 1, 1, -1, -1], True),
    ],
)
def test_validity(spark, labels, valid):
    df = frame(spark, np.zeros((len(labels), 1)), labels)
    assert cluster_counts(df).first()["is_valid"] is valid
    if not valid:
        assert score_clustering(df, len(labels)) is None


def test_noise_is_left_out_of_scores(spark, blobs):
    x, labels = blobs
    scores = score_clustering(frame(spark, x, labels), len(x))
    real = labels != -1
    assert scores["silhouette"] == pytest.approx(brute_silhouette(x[real], labels[real]).mean())
    assert scores["silhouette"] > 0.5 and scores["noise_points"] == 5 and scores["n_clusters"] == 2
    sizes = {r["label"]: r["size"] for r in cluster_sizes(frame(spark, x, labels)).collect()}
    assert sizes == {0: 15, 1: 15}


def test_silhouette_over_many_blocks(spark, monkeypatch):
    from tablewright.operators import points

    rng = np.random.default_rng(1)
    x, labels = rng.normal(size=(90, 3)), rng.integers(0, 4, 90)
    labels[7] = 9
    monkeypatch.setattr(over_block_pairs, "__defaults__", (11,))
    found = {r["id"]: r["silhouette"] for r in silhouette_points(frame(spark, x, labels), 90).collect()}
    assert [found[i] for i in range(90)] == pytest.approx(brute_silhouette(x, labels).tolist())
    assert points.BLOCK_ROWS == 2048


def test_copies_count_as_rows(spark):
    rng = np.random.default_rng(2)
    x, labels, w = rng.normal(size=(20, 2)), np.arange(20) % 3, rng.integers(1, 5, 20)
    many, many_labels = np.repeat(x, w, axis=0), np.repeat(labels, w)
    collapsed = score_clustering(frame(spark, x, labels, w), 20)
    assert collapsed["silhouette"] == pytest.approx(brute_silhouette(many, many_labels).mean())
    spelled_out = score_clustering(frame(spark, many, many_labels), len(many))
    assert collapsed["davies_bouldin"] == pytest.approx(spelled_out["davies_bouldin"])


def test_davies_bouldin_by_hand(spark):
    x = np.array([[0.0], [2.0], [10.0], [14.0]])
    score = davies_bouldin(frame(spark, x, [0, 0, 1, 1]), 2).first()["davies_bouldin"]
    assert score == pytest.approx((1 + 2) / 11)
    same = np.array([[0.0], [2.0], [0.0], [2.0]])
    assert davies_bouldin(frame(spark, same, [0, 0, 1, 1]), 2).first()["davies_bouldin"] == 0.0


def test_score_does_not_switch_with_the_size(spark):
    x, labels = np.random.default_rng(11).normal(size=(30, 2)), np.arange(30) % 3
    df = frame(spark, x, labels)
    expected = pytest.approx(brute_silhouette(x, labels).mean())
    for n in (30, 20_001):
        assert silhouette(df, n) == ("silhouette", expected)
        name, value = silhouette(df, n, score="silhouette_sq")
        assert name == "silhouette_sq" and value != expected
    assert "silhouette_sq" in score_clustering(df, 30, score="silhouette_sq")
    with pytest.raises(ValueError, match="silhouette"):
        silhouette(df, 30, score="cosine")


@pytest.mark.parametrize(("d", "eps", "m"), [(2, 0.3, 4), (5, 1.2, 4)])
def test_dbscan_matches_brute_force(spark, d, eps, m):
    rng = np.random.default_rng(d)
    x = np.vstack([rng.normal(0, 0.4, (80, d)), rng.normal(3, 0.6, (60, d)), rng.uniform(-3, 6, (40, d))])
    w = rng.integers(1, 3, len(x))
    core, label = brute_dbscan(x, eps, m, w)
    found = {r["id"]: r for r in density.dbscan(frame(spark, x, w=w).drop("label"), eps, m).collect()}
    assert [found[i]["is_core"] for i in range(len(x))] == core.tolist()
    assert [found[i]["label"] for i in range(len(x))] == label.tolist()


def test_dbscan_with_a_crowded_salted_cell(spark, monkeypatch):
    monkeypatch.setattr(density, "_SALT_ROWS", 10)
    rng = np.random.default_rng(5)
    x = np.vstack([rng.uniform(0, 0.1, (120, 2)), rng.uniform(0, 2, (60, 2)), [[0.45, 0.05]]])
    core, label = brute_dbscan(x, 0.3, 6)
    grid = density.build_grid(frame(spark, x).drop("label"), 0.3)
    assert grid.cells.agg({"salts": "max"}).first()[0] > 1
    found = {r["id"]: r for r in density.dbscan(frame(spark, x).drop("label"), 0.3, 6, grid).collect()}
    assert [found[i]["label"] for i in range(len(x))] == label.tolist()
    counts = {r["id"]: r["neighbors"] for r in density.neighbor_counts(grid).collect()}
    expected = (((x[:, None] - x[None]) ** 2).sum(-1) <= 0.3 * 0.3).sum(1)
    assert [counts[i] for i in range(len(x))] == expected.tolist()


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 130)] + [(7, 7)]
    vertices = spark.createDataFrame([(v,) for v in [*range(41), *range(100, 130), 500]], "v bigint")
    found = connected_components(vertices, spark.createDataFrame(edges, "u bigint, v bigint"))
    roots = {r["v"]: r["root"] for r in found.collect()}
    assert roots == {v: 0 if v < 41 else 100 if v < 130 else 500 for v in roots} and len(roots) == 72


def test_dense_numbers(spark):
    df = spark.range(0, 3000, 3).repartition(6)
    rows = dense_numbers(df, "id", "n").collect()
    assert all(r["n"] * 3 == r["id"] for r in rows) and len(rows) == 1000


def brute_merge(x, k, linkage):
    groups = [[i] for i in range(len(x))]
    d = gaps(x)

    def cost(a, b):
        if linkage == "average":
            return d[np.ix_(a, b)].mean()
        ca, cb = x[a].mean(0), x[b].mean(0)
        return len(a) * len(b) / (len(a) + len(b)) * ((ca - cb) ** 2).sum()

    while len(groups) > k:
        i, j = min(
            ((i, j) for i in range(len(groups)) for j in range(i + 1, len(groups))),
            key=lambda p: cost(groups[p[0]], groups[p[1]]),
        )
        groups[i] += groups.pop(j)
    return {frozenset(g) for g in groups}


@pytest.mark.parametrize("linkage", ["ward", "average"])
@pytest.mark.parametrize("last", [1, 64])
def test_merging_is_exact_on_small_tables(spark, linkage, last):
    """In rounds down to the last pair, and on the driver alone."""
    x = np.random.default_rng(4).normal(size=(40, 2))
    micro = micro_clusters(frame(spark, x).drop("label"), 40)
    for k, clusters in merge(micro, [2, 5, 20], linkage, last).items():
        rows = labels_for(micro, clusters).collect()
        found = {}
        for r in rows:
            found.setdefault(r["label"], set()).add(r["id"])
        assert {frozenset(g) for g in found.values()} == brute_merge(x, k, linkage)


def test_merging_weighs_copies_and_survives_ties(spark):
    """Points on a grid, all as far from the next: any order of merges is right, but sizes must add up."""
    x = np.array([[float(i), float(j)] for i in range(6) for j in range(6)])
    w = np.arange(36) % 3 + 1
    micro = micro_clusters(frame(spark, x, w=w).drop("label"), 36)
    for linkage in ("ward", "average"):
        for k, clusters in merge(micro, [1, 3, 36, 40], linkage, 2).items():
            rows = labels_for(micro, clusters).collect()
            assert len({r["label"] for r in rows}) == k and sum(r["w"] for r in rows) == w.sum()


def test_merging_micro_clusters_of_a_larger_table(spark, blobs):
    x, _ = blobs
    micro = micro_clusters(frame(spark, x[:30]).drop("label"), 30, m=8)
    rows = labels_for(micro, merge(micro, [2], "average")[2]).collect()
    assert len(rows) == 30
    assert len({r["label"] for r in rows if r["id"] < 15}) == 1
    assert len({r["label"] for r in rows}) == 2


def test_projection_matches_numpy(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(60, 3)) * [3, 2, 0.1] + 5
    found = {r["id"]: (r["x"], r["y"]) for r in projection(frame(spark, x), limit=50).collect()}
    assert sorted(found) == list(range(50))
    centred = x - x.mean(0)
    _, _, axes = np.linalg.svd(centred, full_matrices=False)
    axes = axes[:2] * np.sign(axes[[0, 1], np.abs(axes[:2]).argmax(1)])[:, None]
    expected = centred @ axes.T
    assert np.allclose([found[i] for i in range(50)], expected[:50])
    flat = projection(frame(spark, x[:, :1])).collect()
    assert {r["y"] for r in flat} == {0.0}


def test_projection_weighs_copies(spark):
    rng = np.random.default_rng(8)
    x, w = rng.normal(size=(20, 2)), rng.integers(1, 9, 20)
    many = np.repeat(x, w, axis=0)
    a = {r["id"]: abs(r["x"]) for r in projection(frame(spark, x, w=w)).collect()}
    centred = many - many.mean(0)
    axis = np.linalg.svd(centred, full_matrices=False)[2][0]
    assert [a[i] for i in range(20)] == pytest.approx(np.abs((x - many.mean(0)) @ axis).tolist())


@pytest.fixture(scope="module")
def run(spark):
    rng = np.random.default_rng(9)
    x = np.vstack([rng.normal(c, 0.2, (25, 2)) for c in (-4, 0, 4)])
    df = spark.createDataFrame([(float(a), float(b)) for a, b in x], "a double, b double")
    specs = [
        replace(clustering.CLUSTERERS[0], grid={"n_clusters": [2, 3]}),
        replace(clustering.CLUSTERERS[1], grid={"n_clusters": [2, 3], "linkage": ["ward"]}),
    ]
    specs.append(clustering.ClusterSpec("dbscan", "DBSCAN", {"eps": [0.3, 1000.0], "min_samples": [3]}, clustering._fit_dbscan))
    return clustering.train(df, TaskConfig("clustering", None, ["a", "b"]), models=specs)


def test_clustering_run(run):
    assert run.train_rows == 75 and run.test_rows == 0
    for outcome in run.outcomes:
        assert outcome.status == "success" and outcome.metrics["silhouette"] > 0.7
        assert outcome.metrics["n_clusters"] == 3
        assert outcome.charts["pca_projection"].count() == 75
        assert outcome.assignments.count() == 75
    assert run.outcome("kmeans").best_params == {"n_clusters": "3"}
    assert [score is None for _, score in run.outcome("dbscan").search] == [False, True]
    assert run.winner == "kmeans"


def lloyd(x, w, centres, tol=1e-4, most=300):
    for _ in range(most):
        at = ((x[:, None] - centres[None]) ** 2).sum(-1).argmin(1)
        after = np.array([np.average(x[at == k], axis=0, weights=w[at == k]) if (at == k).any() else centres[k] for k in range(len(centres))])
        step = ((after - centres) ** 2).sum(1).max()
        centres = after
        if step <= tol * tol:
            break
    return centres, (((x[:, None] - centres[None]) ** 2).sum(-1).min(1) * w).sum()


def test_kmeans_runs_advance_like_each_alone(spark, monkeypatch):
    rng = np.random.default_rng(7)
    x, w = rng.normal(size=(90, 3)), rng.integers(1, 4, 90)
    points = frame(spark, x, w=w).drop("label").cache()
    begun, starts = [], kmeans._starts
    monkeypatch.setattr(kmeans, "_starts", lambda *given: begun.extend(starts(*given)) or [c.copy() for c in begun])
    scans, sums = [], kmeans._sums
    monkeypatch.setattr(kmeans, "_sums", lambda *given: scans.append(given[2]) or sums(*given))
    runs = kmeans.kmeans_runs(points, [2, 5], restarts=3)
    alone = [lloyd(x, w, c) for c in begun]
    assert [r.k for r in runs] == [2, 2, 2, 5, 5, 5] and [len(c) for c in begun] == [2, 2, 2, 5, 5, 5]
    for run, (centres, cost) in zip(runs, alone):
        assert np.allclose(run.centres, centres) and run.cost == pytest.approx(cost)
    # One scan an iteration for all runs together, four before and one after.
    assert sum(scans) < 60 and len(scans) - sum(scans) == 4
    best = kmeans.best_runs(runs)
    assert best[5].cost == min(r.cost for r in runs if r.k == 5)


def test_kmeans_takes_the_best_of_ten_starts(spark):
    rng = np.random.default_rng(1)
    x = np.vstack([rng.normal(c, 0.05, (12, 2)) for c in ((0, 0), (0, 5), (5, 0), (5, 5), (20, 20))])
    points = frame(spark, x).drop("label")
    fitted = list(clustering._fit_kmeans(points, len(x), [{"n_clusters": 5}]))
    labels = {r["id"]: r["label"] for r in fitted[0].labelled.collect()}
    assert sorted(len({labels[i] for i in range(s, s + 12)}) for s in range(0, 60, 12)) == [1] * 5
    assert len(set(labels.values())) == 5 and clustering.RESTARTS == 10
    assert len(fitted[0].model.clusterCenters()) == 5


def test_kmeans_with_few_or_equal_points(spark):
    points = frame(spark, np.array([[1.0], [2.0]]), w=np.array([5, 1])).drop("label")
    runs = kmeans.kmeans_runs(points, [2, 4], restarts=2)
    assert [len(r.centres) for r in runs] == [2, 2, 2, 2] and all(r.cost == 0 for r in runs)
    assert all(r.centres.size == 0 for r in kmeans.kmeans_runs(points.limit(0), [2], restarts=1))


def test_many_labelings_score_like_each_alone(spark):
    rng = np.random.default_rng(12)
    x, w = rng.normal(size=(60, 2)), rng.integers(1, 3, 60)
    labelings = [np.arange(60) % 3, np.where(np.arange(60) < 8, -1, np.arange(60) % 2), np.zeros(60, int), rng.integers(0, 9, 60), np.full(60, -1)]
    df = frame(spark, x, w=w).drop("label")
    table = spark.createDataFrame([(i, [int(c[i]) for c in labelings]) for i in range(60)], "id bigint, labels array<bigint>")
    for score in ("silhouette", "silhouette_sq"):
        together = score_labelings(df.join(table, "id"), 60, score)
        for found, labels in zip(together, labelings):
            one = score_clustering(frame(spark, x, labels, w=w), 60, score)
            assert (found is None) == (one is None) == (len(set(labels) - {-1}) < 2)
            assert found is None or found == pytest.approx(one)
    value = brute_silhouette(np.repeat(x, w, axis=0), np.repeat(labelings[0], w)).mean()
    assert score_labelings(df.join(table, "id"), 60)[0]["silhouette"] == pytest.approx(value)


def test_no_valid_combination_is_a_failure(spark, run):
    hopeless = clustering.ClusterSpec("dbscan", "DBSCAN", {"eps": [1000.0], "min_samples": [3]}, clustering._fit_dbscan)
    points = points_of(spark.range(40).selectExpr("double(id) as a"), ["a"])
    outcome = clustering.cluster_one(hopeless, points, 40, None)
    assert outcome.status == "failed" and "valid clustering" in outcome.warning and outcome.metrics is None


def test_clustering_rejects_few_rows(spark):
    with pytest.raises(ConfigError, match="at least 30"):
        clustering.train(spark.range(10).selectExpr("id as a"), TaskConfig("clustering", None, ["a"]))


def test_grid_order():
    combos = clustering.CLUSTERERS[1].combinations()
    assert combos[:3] == [
        {"n_clusters": 2, "linkage": "ward"}, {"n_clusters": 2, "linkage": "average"},
        {"n_clusters": 3, "linkage": "ward"},
    ]
    assert len(clustering.CLUSTERERS[2].combinations()) == 15


def test_new_rows_get_the_nearest_label(spark):
    rng = np.random.default_rng(2)
    known, labels = rng.uniform(-2, 2, (50, 4)).round(1), rng.integers(0, 5, 50)
    asked = np.vstack([rng.uniform(-2.5, 2.5, (60, 4)).round(1), known[:5]])
    references = frame(spark, known, labels).select("x", "label")
    gap = ((asked[:, None] - known[None]) ** 2).sum(-1)
    best = [min(zip(row.round(9), labels.tolist())) for row in gap]
    got = {r["id"]: r["label"] for r in nearest_reference(frame(spark, asked), references).collect()}
    assert [got[i] for i in range(len(asked))] == [b[1] for b in best]
    within = {r["id"]: r["label"] for r in nearest_within(frame(spark, asked), references, 0.9).collect()}
    assert [within[i] for i in range(len(asked))] == [b[1] if b[0] <= 0.81 else -1 for b in best]
    assert {-1} < set(within.values())
    for found in (nearest_reference(frame(spark, asked), references.limit(0)), nearest_within(frame(spark, asked), references.limit(0), 1.0)):
        assert {r["label"] for r in found.collect()} == {-1}


def test_points_of_columns_called_like_theirs(spark):
    df = spark.createDataFrame([(1.0, 2.0, 3.0), (1.0, 2.0, 3.0), (4.0, 5.0, 6.0)], "x double, id double, w double")
    assert sorted((r["x"], r["w"]) for r in points_of(df, ["x", "id", "w"]).collect()) == [([1.0, 2.0, 3.0], 2), ([4.0, 5.0, 6.0], 1)]


@pytest.mark.parametrize("width", [2, 12])
def test_sums_over_all_distances_in_many_blocks(spark, monkeypatch, width):
    """Blocks meet each other in bounded tasks, and what a task sends is no more than the result."""
    from tablewright.operators import clusters, pairs

    monkeypatch.setattr(pairs, "BLOCK_ROWS", 17)
    rng = np.random.default_rng(12)
    # Far from the origin, with copies at different ids.
    x = rng.normal(size=(120, width)) + 1000.0
    x[60:70] = x[50:60]
    labels, w = rng.integers(-1, 4, 120), rng.integers(1, 4, 120)
    labels[7] = 9
    many, many_labels = np.repeat(x, w, axis=0), np.repeat(labels, w)
    real = many_labels != -1
    expected = brute_silhouette(many[real], many_labels[real])
    found = silhouette_points(frame(spark, x, labels, w), 120).collect()
    assert len(found) == (labels != -1).sum()
    of = {r["id"]: r["silhouette"] for r in found}
    # A single row is a singleton only if it has no copies.
    ids = np.repeat(np.arange(120), w)[real]
    assert [of[i] for i in ids] == pytest.approx(expected.tolist(), abs=1e-9)
    away = gaps(x) * w[:, None] * w[None, :]
    summed = clusters.cluster_distance_sums(frame(spark, x, labels, w), 120)
    assert summed.rdd.getNumPartitions() >= 1 and summed.count() == len(set(labels.tolist())) ** 2
    for r in summed.collect():
        total = away[np.ix_(labels == r["label"], labels == r["other"])].sum()
        assert r["total"] == pytest.approx(total, abs=1e-7)


def test_ids_and_labels_that_repeat_or_are_null(spark):
    """Rows with one id and label count as one; a null label is nobody's cluster and scores 0."""
    rows = [(1, [0.0], 1, 0), (1, [0.0], 1, 0), (2, [1.0], 1, 0), (3, [9.0], 1, 1), (None, [8.0], 1, 1), (4, [5.0], 1, None)]
    df = spark.createDataFrame(rows, "id bigint, x array<double>, w bigint, label bigint")
    found = {(r["id"], r["label"]): r["silhouette"] for r in silhouette_points(df, 6).collect()}
    # Row 1 stands twice: its two distances of 1 over two others, against two means of 9 and 8.
    assert found[1, 0] == pytest.approx((17 - 1) / 17) and found[2, 0] == pytest.approx((7.5 - 1) / 7.5)
    assert found[4, None] == 0.0 and len(found) == 5


def test_crowded_cells_are_not_compared_point_by_point(spark):
    """Counts and nearest references of dense points, without a join of all of a cell's points."""
    rng = np.random.default_rng(21)
    x = np.round(rng.uniform(0, 1.2, (900, 2)), 2)
    df = frame(spark, x)
    near = ((x[:, None, :] - x[None, :, :]) ** 2).sum(-1)
    grid = density.build_grid(df.drop("label"), 0.5)
    counted = density.neighbor_counts(grid)
    assert {r["id"]: r["neighbors"] for r in counted.collect()} == dict(enumerate((near <= 0.25).sum(1).tolist()))
    labels = rng.integers(0, 5, 400)
    known = frame(spark, x[:400], labels).select("x", "label")
    asked = frame(spark, np.vstack([x[400:], [[9.0, 9.0]]])).select("id", "x")
    found = {r["id"]: r["label"] for r in nearest_within(asked, known, 0.5).collect()}
    gap = near[400:, :400]
    best = [min(labels[g == g.min()]) for g in gap]
    assert [found[i] for i in range(500)] == best and found[500] == -1
    plan = counted._jdf.queryExecution().toString()
    assert "MapInArrow" in plan


def test_points_that_compress_well_are_not_broadcast(spark):
    """Copies take few bytes when they are exchanged: neither side of many rows may be sent to every task for that."""
    few = [([float(i % 40), 0.0], i % 40) for i in range(40)]
    known = spark.createDataFrame(few, "x array<double>, label bigint").crossJoin(spark.range(100)).drop("id")
    asked = spark.range(20_000).select("id", F.array((F.col("id") % 40).cast("double") + 0.1, F.lit(0.0)).alias("x"))
    found = nearest_within(asked, known, 0.5)
    assert found.groupBy("label").count().where("count = 500").count() == 40
    assert found.where(F.col("label") != F.col("id") % 40).isEmpty()
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString()
    joins = [line for line in plan.split("Initial Plan")[0].splitlines() if "BroadcastHashJoin" in line or "BroadcastQueryStage" in line]
    # The table of crowded cells has one row per cell, and nothing else goes out.
    assert all("cell" in line for line in joins if "HashJoin" in line) and "SortMergeJoin [id" in plan


def test_a_few_bytes_of_crowded_cells_are_dealt_to_all_tasks(spark):
    x = np.round(np.random.default_rng(5).uniform(0, 0.2, (600, 2)), 2)
    found = nearest_within(frame(spark, x).select("id", "x"), frame(spark, x, range(600)).select("x", "label"), 0.1)
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert "MapInArrow" in plan and "REPARTITION_BY_COL" not in plan


def test_points_travel_a_few_to_a_row_and_never_across_blocks():
    import pyarrow as pa

    from tablewright.operators import pairs

    block = np.repeat([3, 5], [700, 301]).astype(np.int32)
    x = pa.array([[float(i), 1.0] for i in range(1001)])
    given = pa.RecordBatch.from_arrays([pa.array(block), pa.array(range(1001)), x], names=["_block", "id", "x"])
    (packed,) = pairs._pack(iter([given]), ["id", "x"], "id")
    assert packed.num_rows < 20 and packed.column("id").flatten().to_pylist() == list(range(1001))
    for row in packed.to_pylist():
        assert {block[i] for i in row["id"]} == {row["_block"]} and row["_order"] == row["id"][0]
        assert [p[0] for p in row["x"]] == row["id"]


def test_products_of_tiles_start_no_threads(monkeypatch):
    from tablewright.operators import pairs

    rng = np.random.default_rng(6)
    a, b, sizes, plain = rng.normal(size=(130, 64)), rng.normal(size=(64, 1000)), [], np.matmul

    def spy(p, q, out):
        sizes.append(p.shape[0] * p.shape[1] * q.shape[1])
        return plain(p, q, out=out)

    monkeypatch.setattr(pairs.np, "matmul", spy)
    found = pairs.product(a, b, np.empty((130, 1000)))
    assert max(sizes) <= pairs.ONE_THREAD and np.allclose(found, a @ b)


def test_many_points_of_one_file_are_spread_over_the_tasks(spark):
    from tablewright.operators.points import FEW_POINTS, spread_out

    n = FEW_POINTS + 1
    points = spark.range(n).coalesce(1).select("id", F.array(F.col("id").cast("double")).alias("x"))
    spread = spread_out(points, n)
    sizes = spread.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
    assert sum(sizes) == n and len([s for s in sizes if s]) == 3 and max(sizes) < n / 2
    assert spread_out(points, FEW_POINTS) is points
