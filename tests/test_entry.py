import importlib
import sys


def test_entry(spark):
    e = importlib.import_module("__spark_entry__")
    assert e.entry(spark).count() == 10
    assert set(e.oracle_sql()) <= set(e.queries())


def test_core_without_llm(monkeypatch):
    for name in [n for n in sys.modules if n == "__spark_entry__" or n.startswith("quillspark.llm")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "quillspark.llm", None)
    e = importlib.import_module("__spark_entry__")
    assert e.llm is None and "p6_found" in e.queries() and not any(k.startswith("p1_") for k in e.queries())
    monkeypatch.delitem(sys.modules, "__spark_entry__")
