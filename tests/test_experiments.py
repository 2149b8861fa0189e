from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from tablewright.operators.models import REGISTRY
from tablewright.plans import clustering, supervised
from tablewright.plans.profile import profile
from tablewright.plans.results import ModelOutcome, Run
from tablewright.sources.experiments import (
    as_json,
    assignments,
    find_experiment,
    label_rows,
    load_model,
    read_chart,
    read_importances,
    read_metrics,
    read_profile,
    save_experiment,
    score_rows,
)
from tablewright.streaming.score import read_folder, score_stream
from tablewright.types import ExperimentError, TaskConfig


@pytest.fixture(scope="module")
def parts(table):
    return table("part").withColumn("y", F.expr("p_size * 2.0 + p_retailprice"))


@pytest.fixture(scope="module")
def saved(spark, parts, tmp_path_factory):
    base = str(tmp_path_factory.mktemp("experiments"))
    config = TaskConfig("regression", "y", ["p_size", "p_retailprice", "p_type"])
    run = supervised.train(parts, config, models=REGISTRY["regression"][:1])
    return base, save_experiment(run, base, "part", profile(parts.select("p_size", "p_type"))), run


def test_records_carry_the_whole_configuration(spark, saved):
    base, experiment_id, run = saved
    record = find_experiment(spark, base, experiment_id).first()
    assert record["features"] == ["p_size", "p_retailprice", "p_type"] and record["scaler"] == "standard"
    assert record["winner_key"] == record["model_key"] == "linear_regression" and record["is_best"]
    assert record["train_rows"] + record["test_rows"] == run.train_rows + run.test_rows
    assert as_json(find_experiment(spark, base, experiment_id))[0]["metrics"]["r2"] > 0.999
    assert spark.read.parquet(f"{base}/charts/residuals").count() == run.test_rows
    assert spark.read.parquet(f"{base}/metrics").count() == 3
    assert spark.read.parquet(f"{base}/profiles/{experiment_id}/columns").count() == 2


def test_saved_model_scores_raw_rows_with_an_unseen_level(spark, saved):
    base, experiment_id, _ = saved
    rows = spark.createDataFrame(
        [(10, 100.0, "NEVER SEEN"), (20, 100.0, "NEVER SEEN")],
        "p_size int, p_retailprice double, p_type string",
    )
    low, high = score_rows(spark, base, experiment_id, "linear_regression", rows).orderBy("p_size").collect()
    assert high["prediction"] - low["prediction"] == pytest.approx(20.0, abs=1e-6)


def test_stream_and_batch_agree(spark, saved, sf, parts, tmp_path):
    base, experiment_id, _ = saved
    model = load_model(spark, base, experiment_id, "linear_regression")
    stream = read_folder(spark, sf, "part.parquet", like=f"{sf}/part.parquet")
    score_stream(model, stream, f"{tmp_path}/out", f"{tmp_path}/progress").awaitTermination()
    found = spark.read.parquet(f"{tmp_path}/out").select("p_partkey", F.round("prediction", 6))
    expected = supervised.score(model, parts).select("p_partkey", F.round("prediction", 6))
    assert found.count() == parts.count() and found.exceptAll(expected).count() == 0


@pytest.mark.parametrize("bad", ["0" * 32, "../etc", "XYZ"])
def test_unknown_experiments(spark, saved, bad):
    with pytest.raises(ExperimentError, match="no experiment"):
        find_experiment(spark, saved[0], bad)


@pytest.mark.parametrize("key", ["nope", "Bad-Key", "../x"])
def test_unknown_models(spark, saved, key):
    with pytest.raises(ExperimentError, match="no successful model"):
        load_model(spark, saved[0], saved[1], key)


def test_nothing_to_save_without_a_winner(spark, saved):
    failed = Run(saved[2].config, 1, 1, [ModelOutcome("m", "M", "failed", 0.1, warning="x")], spark)
    with pytest.raises(ExperimentError, match="No model"):
        save_experiment(failed, saved[0], "part")


def test_clusterings_label_new_rows_only_if_they_can(spark, parts, tmp_path):
    config = TaskConfig("clustering", None, ["p_size", "p_retailprice"])
    grids = {"n_clusters": [2]}, {"n_clusters": [2], "linkage": ["ward"]}
    specs = [replace(s, grid=g) for s, g in zip(clustering.CLUSTERERS[:2], grids, strict=True)]
    run = clustering.train(parts, config, models=specs)
    experiment_id = save_experiment(run, str(tmp_path), "part")
    rows = parts.select("p_size", "p_retailprice")
    scored = score_rows(spark, str(tmp_path), experiment_id, "kmeans", rows)
    assert scored.columns == ["p_size", "p_retailprice", "prediction"]
    kept = assignments(spark, str(tmp_path), experiment_id, "agglomerative_clustering")
    assert kept.agg(F.sum("w")).first()[0] == run.train_rows
    with pytest.raises(ExperimentError, match="fitted on"):
        score_rows(spark, str(tmp_path), experiment_id, "agglomerative_clustering", rows)
    keyed = parts.select("p_partkey", "p_size", "p_retailprice")
    fresh = spark.createDataFrame([(-1, 25, 1000.5), (-2, None, 1.0), (-1, 25, 1000.5)], keyed.schema)
    own = kept.count()
    for key in ("kmeans", "agglomerative_clustering"):
        found = label_rows(spark, str(tmp_path), experiment_id, key, keyed.unionByName(fresh), ["p_partkey"])
        labels = {}
        for r in found.collect():
            labels.setdefault(r["p_partkey"], []).append(r["label"])
        assert len(labels) == keyed.count() + 2 and labels[-2] == [None]
        assert len(labels[-1]) == 2 and labels[-1][0] == labels[-1][1] in (0, 1)
        if key != "kmeans":
            held = {r["label"]: r["n"] for r in kept.groupBy("label").agg(F.sum("w").alias("n")).collect()}
            counts = [sum(v == [c] for k, v in labels.items() if k >= 0) for c in (0, 1)]
            assert own and counts == [held[0], held[1]]
    with pytest.raises(ExperimentError, match="no successful clustering"):
        label_rows(spark, str(tmp_path), experiment_id, "dbscan", keyed, ["p_partkey"])


def test_tables_read_back(spark, saved, parts, tmp_path):
    base, experiment_id, run = saved
    chart = read_chart(spark, base, experiment_id, "linear_regression", "residuals")
    assert sorted(map(tuple, chart.collect())) == sorted(map(tuple, run.outcomes[0].charts["residuals"].collect()))
    assert {r["metric"]: r["value"] for r in read_metrics(spark, base, experiment_id).collect()} == run.outcomes[0].metrics
    assert read_importances(spark, base, experiment_id).count() == 0
    assert [r["column"] for r in read_profile(spark, base, experiment_id, "columns").orderBy("ordinal").collect()] == ["p_size", "p_type"]
    for key, chart in (("gbt_regressor", "residuals"), ("linear_regression", "nothing"), ("../x", "residuals")):
        with pytest.raises(ExperimentError, match="no chart"):
            read_chart(spark, base, experiment_id, key, chart)
    with pytest.raises(ExperimentError, match="no table"):
        read_profile(spark, base, experiment_id, "everything")
    with pytest.raises(ExperimentError, match="no experiment"):
        read_metrics(spark, base, "0" * 32)
    bare = save_experiment(run, f"{tmp_path}/other", "part")
    with pytest.raises(ExperimentError, match="without a profile"):
        read_profile(spark, f"{tmp_path}/other", bare, "columns")
