"""Every registered query of the core runs, gives its columns, and equals its SQL where there is one."""

import pytest

from ocrlake.plans import catalog, incremental, pipeline, search, worker
from tests.conftest import DATA
from tests.oracle import connect, same

MODULES = (incremental, search, catalog, pipeline, worker)
WITH_SQL = [(m, n) for m in MODULES for n in m.QUERIES if n in m.SQL]
WITHOUT = [(m, n) for m in MODULES for n in m.QUERIES if n not in m.SQL]


@pytest.fixture(scope="module")
def con():
    return connect(DATA)


@pytest.mark.parametrize("module,name", WITH_SQL, ids=[n for _, n in WITH_SQL])
def test_equals_sql(spark, con, module, name):
    ours, theirs = same(module.QUERIES[name](spark, DATA), con, module.SQL[name])
    assert ours == theirs


@pytest.mark.parametrize("module,name", WITHOUT, ids=[n for _, n in WITHOUT])
def test_runs(spark, module, name):
    df = module.QUERIES[name](spark, DATA)
    assert df.columns and df.count() >= 0


def test_entry_without_text_operators(monkeypatch):
    import builtins
    import importlib
    import sys

    real = builtins.__import__

    def blocked(name, globals=None, locals=None, fromlist=(), level=0):
        if name.startswith("ocrlake.llm"):
            raise ImportError(name)
        return real(name, globals, locals, fromlist, level)

    for m in [m for m in sys.modules if m.startswith("ocrlake.llm")]:
        monkeypatch.delitem(sys.modules, m)
    monkeypatch.setattr(builtins, "__import__", blocked)
    monkeypatch.delitem(sys.modules, "__spark_entry__", raising=False)
    entry = importlib.import_module("__spark_entry__")
    assert "p1_found" in entry.queries() and "p3_found" not in entry.queries()
    assert set(entry.oracle_sql()) <= set(entry.queries())
    monkeypatch.delitem(sys.modules, "__spark_entry__", raising=False)
