"""The driver contract: the optional subpackage may be missing or lack something it needs."""

import importlib
import sys

import __spark_entry__ as entry


def test_queries_go_on_without_the_optional_subpackage(monkeypatch):
    for name in [n for n in sys.modules if n.startswith("horograph.llm")]:
        monkeypatch.delitem(sys.modules, name)
    real = importlib.import_module

    def broken(name, *a):
        if name.startswith("horograph.llm"):
            raise ModuleNotFoundError("No module named 'ahocorasick'", name="ahocorasick")
        return real(name, *a)

    monkeypatch.setattr(entry.importlib, "import_module", broken)
    known = entry.queries()
    assert "p1_found" in known and "p2_found" not in known and len(known) > 90


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
