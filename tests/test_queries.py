import importlib.util
import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, os.path.join(ROOT, "tools"))

from check_oracles import connect, differences  # noqa: E402

from tablewright.catalog import ORACLES, QUERIES  # noqa: E402


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, sf, con, name):
    assert differences(spark, con, sf, name) is None


def test_entry_contract(spark):
    spec = importlib.util.spec_from_file_location("entry", os.path.join(ROOT, "__spark_entry__.py"))
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    assert module.entry(spark).count() == 11
    assert set(module.oracle_sql()) <= set(module.queries())
    assert set(QUERIES) <= set(module.queries())


@pytest.mark.parametrize("task", ["regression", "classification", "clustering"])
def test_training_queries_search_the_whole_spaces(spark, sf, monkeypatch, task):
    from tablewright.catalog import modelling

    seen = {}

    def note(df, config, **options):
        seen[config.task] = options.get("models")

    monkeypatch.setattr(modelling.supervised, "train", note)
    monkeypatch.setattr(modelling.clustering, "train", note)
    modelling.trained.__wrapped__(spark, sf, task)
    assert seen == {task: None}
