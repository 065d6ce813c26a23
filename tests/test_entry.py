"""The driver's contract, and that nothing else needs the text package."""

import importlib
import os
import re
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_contract(spark, data):
    entry = importlib.import_module("__spark_entry__")
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and all(callable(f) for f in queries.values())
    assert entry.entry(spark).count() > 0
    for k in ("p3_found", "p4_found", "p5_found"):
        assert k in queries and k in sql


def test_rest_runs_without_text_package(monkeypatch):
    package = "quillspark." + "llm"
    for name in [m for m in sys.modules if m == "__spark_entry__" or m.startswith(package)]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, package, None)  # as if the folder were gone
    monkeypatch.delattr("quillspark.llm", raising=False)
    entry = importlib.import_module("__spark_entry__")
    assert "p3_found" in entry.queries() and "p1_found" not in entry.queries()
    monkeypatch.delitem(sys.modules, "__spark_entry__")


def test_nothing_else_imports_the_text_package():
    for folder, _, files in os.walk(os.path.join(ROOT, "quillspark")):
        if os.path.basename(folder) == "llm":
            continue
        for f in files:
            if f.endswith(".py"):
                text = open(os.path.join(folder, f), encoding="utf-8").read()
                assert not re.search(r"import.*\bllm\b|from.*\bllm\b", text), f
