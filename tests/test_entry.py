import importlib
import sys


def test_entry_runs(spark):
    import __spark_entry__ as e

    assert e.entry(spark).limit(1).count() == 1
    assert set(e.oracle_sql()) <= set(e.queries())


def test_without_the_corpus_operators(monkeypatch):
    import __spark_entry__ as e

    real = importlib.util.find_spec

    def gone(name, *a):
        if name == "corpus_pipeline" or name.startswith("quern.llm"):
            return None
        return real(name, *a)

    monkeypatch.setattr(importlib.util, "find_spec", gone)
    found = importlib.reload(e).queries()
    assert found and not any(k.startswith("op") or k == "pipeline" for k in found)
    monkeypatch.undo()
