import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tablewright.functions.expressions import bin_label, normalize, safe_stem
from tablewright.operators import quantiles
from tablewright.operators.profile import (
    category_frequencies,
    column_profile,
    correlation,
    dataset_dims,
    default_features,
    duplicate_rows,
    histograms,
    identifier_columns,
    numeric_summary,
)
from tablewright.plans.profile import TABLES, profile
from tablewright.types import ConfigError, TaskConfig, kind


@pytest.fixture(scope="module")
def pdf():
    rng = np.random.default_rng(7)
    n = 500
    frame = pd.DataFrame(
        {
            "id": [f"c{i}" for i in range(n)],
            "age": rng.integers(18, 75, n),
            "income": rng.normal(50, 12, n),
            "score": rng.normal(0, 1, n),
            "flag": rng.integers(0, 2, n),
            "tier": rng.choice(["Basic", "Silver", "Gold"], n),
            "flat": 0.1,
        }
    )
    frame.loc[rng.choice(n, 20, replace=False), "income"] = np.nan
    frame.loc[rng.choice(n, 30, replace=False), "tier"] = None
    return pd.concat([frame, frame.iloc[:5]], ignore_index=True)


@pytest.fixture(scope="module")
def df(spark, pdf):
    return normalize(spark.createDataFrame(pdf)).repartition(7)


def by(table, *keys):
    rows = [r.asDict() for r in table.collect()]
    return {tuple(r[k] for k in keys) if len(keys) > 1 else r[keys[0]]: r for r in rows}


def test_column_profile_matches_pandas(df, pdf):
    found = by(column_profile(df), "column")
    for name in pdf.columns:
        missing = int(pdf[name].isna().sum())
        assert found[name]["missing_count"] == missing
        assert found[name]["missing_percentage"] == round(missing / len(pdf) * 100, 2)
        assert found[name]["unique_count"] == pdf[name].nunique()
    assert found["tier"]["kind"] == "categorical" and found["age"]["kind"] == "numeric"


def test_approximate_profile_is_close(df, pdf):
    found = by(column_profile(df, approx=True), "column")
    for name in pdf.columns:
        assert found[name]["unique_count"] == pytest.approx(pdf[name].nunique(), rel=0.15)
        assert found[name]["missing_count"] == pdf[name].isna().sum()


def test_dims_and_duplicates(df, pdf):
    dims = dataset_dims(df).first()
    assert (dims["row_count"], dims["column_count"]) == pdf.shape
    assert dims["missing_cells"] == pdf.isna().sum().sum()
    assert duplicate_rows(df).first()["duplicate_row_count"] == pdf.duplicated().sum()


def test_digest_tells_missing_from_empty_and_shifted_parts(spark):
    rows = [("a", None), (None, "a"), ("ab", "c"), ("a", "bc"), ("", None), (None, "")]
    df = spark.createDataFrame(rows, "p string, q string")
    assert duplicate_rows(df).first()["distinct_rows"] == 6


def test_numeric_summary_matches_pandas(df, pdf):
    found = by(numeric_summary(df), "column")
    for name in ["age", "income", "score", "flag", "flat"]:
        series = pdf[name].dropna()
        assert found[name]["count"] == len(series)
        for ours, theirs in [
            ("mean", series.mean()), ("std", series.std()), ("min", series.min()),
            ("q25", series.quantile(0.25)), ("median", series.quantile(0.5)),
            ("q75", series.quantile(0.75)), ("max", series.max()),
        ]:
            assert found[name][ours] == pytest.approx(theirs, abs=1e-9)


def test_quantiles_stay_exact_when_brackets_must_be_narrowed(df, pdf, monkeypatch):
    names = ["age", "income", "score", "flag"]
    brackets, extremes = [], {}
    for name in names:
        s = pdf[name].dropna().astype(float)
        # Sketches that are far off, on either side.
        brackets += quantiles.start_brackets(
            name, len(s), s.min(), s.max(), [0.25, 0.5, 0.75], [s.max()] * 2 + [s.min()] * 2 + [s.min(), s.max()]
        )
        extremes[name] = (s.min(), s.max())
    found = quantiles.exact_quantiles(df, brackets, extremes, max_candidates=20)
    for (name, q), value in found.items():
        assert value == pytest.approx(pdf[name].quantile(q), abs=1e-9)


def test_single_value_has_no_deviation(spark):
    df = spark.createDataFrame([(1.5, None)], "a double, b double")
    row = numeric_summary(df).collect()
    assert len(row) == 1 and row[0]["std"] is None and row[0]["median"] == 1.5


def test_histograms_match_numpy(df, pdf):
    found = by(histograms(df), "column", "bin")
    for name in ["age", "income", "score"]:
        counts, edges = np.histogram(pdf[name].dropna().astype(float), bins=10)
        ours = [found[(name, b)] for b in range(1, 11)]
        assert [r["count"] for r in ours] == counts.tolist()
        assert [r["bin_start"] for r in ours] == pytest.approx(edges[:-1].tolist())
        assert ours[-1]["bin_end"] == pdf[name].max()
    assert found[("flag", 1)]["bin_start"] == found[("flag", 1)]["bin_end"] == 0.0
    assert not any(column == "flat" for column, _ in found)


def test_twelve_values_are_discrete_and_thirteen_are_not(spark):
    df = spark.range(1300).select((F.col("id") % 12).alias("a"), (F.col("id") % 13).alias("b"))
    sizes = by(histograms(df).groupBy("column").count(), "column")
    assert sizes["a"]["count"] == 12 and sizes["b"]["count"] == 10


def test_empty_bins_are_kept(spark):
    values = [(float(v),) for v in [*range(7), *[0.5 + i for i in range(7)], 1000.0]]
    bins = histograms(spark.createDataFrame(values, "v double")).orderBy("bin").collect()
    assert [b["count"] for b in bins] == [14, 0, 0, 0, 0, 0, 0, 0, 0, 1]


def test_frequencies_fold_the_rest_and_skip_identifiers(spark):
    rows = [(f"v{i:02d}", f"u{i}_{j}") for i in range(30) for j in range(30 - i)]
    rows += [("Other", f"o{j}") for j in range(100)]
    table = category_frequencies(spark.createDataFrame(rows, "v string, u string"))
    found = table.orderBy("rank").collect()
    assert {r["column"] for r in found} == {"v"}
    assert len(found) == 21 and all(r["truncated"] for r in found)
    assert [(r["value"], r["is_other"]) for r in found if r["value"] == "Other"] == [
        ("Other", False), ("Other", True),
    ]
    assert sum(r["count"] for r in found) == len(rows)


def test_one_hot_value_dominates(spark):
    df = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise((F.col("id") % 40).cast("string")).alias("v")
    )
    first = category_frequencies(df.repartition(11)).orderBy("rank").first()
    assert (first["value"], first["count"]) == ("hot", 1000)


@pytest.mark.parametrize("wide", [True, False])
def test_correlation_is_pairwise_complete(df, pdf, wide):
    found = by(correlation(df, wide=wide), "column_x", "column_y")
    names = ["age", "income", "score", "flag", "flat"]
    expected = pdf[names].corr()
    for a in names:
        for b in names:
            r = found[(a, b)]["r"]
            if np.isnan(expected.loc[a, b]):
                assert r is None
            else:
                assert r == pytest.approx(expected.loc[a, b], abs=1e-9)


def test_correlation_needs_two_columns(spark):
    assert correlation(spark.createDataFrame([(1.0, "a")], "x double, s string")).count() == 0


def test_identifiers_and_default_features(df):
    profiled = column_profile(df)
    assert [r["column"] for r in identifier_columns(profiled).collect()] == ["id"]
    chosen = {r["column"] for r in default_features(profiled, "regression", "age").collect()}
    assert chosen == {"income", "score", "flag", "tier", "flat"}
    numbers = {r["column"] for r in default_features(profiled, "clustering", None).collect()}
    assert numbers == {"age", "income", "score", "flag", "flat"}


def test_results_do_not_depend_on_partitions(df):
    for op in (column_profile, numeric_summary, histograms, category_frequencies):
        one, many = op(df.repartition(1)), op(df.repartition(17))
        digits = [F.round(c, 8).alias(c) if t == "double" else F.col(c) for c, t in one.dtypes]
        assert one.select(*digits).exceptAll(many.select(*digits)).count() == 0


def test_kinds(spark):
    df = spark.sql("select 1 as a, true as b, date'2020-01-01' as c, array(1) as d, cast(1 as decimal(5,2)) as e")
    assert kind(df.schema["a"].dataType) == kind(df.schema["e"].dataType) == "numeric"
    assert kind(df.schema["b"].dataType) == kind(df.schema["c"].dataType) == "categorical"
    with pytest.raises(ConfigError):
        kind(df.schema["d"].dataType)


def test_labels_and_stems(spark):
    df = spark.createDataFrame([(1.0, 1.0), (1.0, 2.25), (0.5, 3.0)], "a double, b double")
    labels = [r[0] for r in df.select(bin_label(F.col("a"), F.col("b"))).collect()]
    assert labels[0] == "1" and labels[1] in ("1–2.3", "1–2.2") and labels[2] == "0.5–3"
    names = spark.createDataFrame([("my data (1).csv",), ("/x/y.tar.gz",), (".csv",)], "n string")
    assert [r[0] for r in names.select(safe_stem(F.col("n"))).collect()] == [
        "my_data__1_", "y.tar", ".csv",
    ]


def test_profile_tables_are_written(spark, df, tmp_path):
    profile(df).write(str(tmp_path))
    for name in TABLES:
        assert spark.read.parquet(f"{tmp_path}/{name}").count() > 0
    assert TaskConfig("regression", "age", ["income"]).selected == ["income", "age"]


@pytest.mark.parametrize("bad", [float("inf"), float("-inf"), float("nan")])
def test_correlation_of_cells_that_are_not_finite(spark, bad):
    rows = [(1.0, 2.0, 1.0), (2.0, 1.0, 5.0), (4.0, 3.0, 2.0), (bad, None, 7.0), (5.0, 9.0, 3.0)]
    df = spark.createDataFrame(rows, "a double, b double, c double")
    cells = [{(r[0], r[1]): r[2] for r in correlation(df, wide=w).collect()} for w in (False, True)]
    assert cells[0]["a", "b"] is not None and cells[0]["a", "c"] is None
    assert {k: v is None for k, v in cells[0].items()} == {k: v is None for k, v in cells[1].items()}
    assert all(v is None or v == pytest.approx(cells[1][k]) for k, v in cells[0].items())
