import builtins
import importlib
import sys

import __spark_entry__ as driver


def test_every_query_has_a_name_of_its_own_sql():
    assert set(driver.oracle_sql()) <= set(driver.queries())


def test_the_rest_works_without_the_training_data_operators(monkeypatch):
    real = builtins.__import__

    def without(name, *args, **more):
        if name == "corpus_pipeline" or name.startswith("congruity.llm"):
            raise ImportError(name)
        return real(name, *args, **more)

    for name in [n for n in sys.modules if n == "corpus_pipeline" or n.startswith("congruity.llm")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setattr(builtins, "__import__", without)
    try:
        importlib.reload(driver)
        assert "l3_status_counts" in driver.queries() and not any(n.startswith("op") or n == "pipeline" for n in driver.queries())
    finally:
        monkeypatch.undo()
        importlib.reload(driver)


def test_flagship(spark):
    assert {r.status for r in driver.entry(spark).collect()} >= {"MATCHED", "MISSING_IN_TARGET"}
