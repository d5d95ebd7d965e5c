"""Every query with SQL against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from plenum.catalog import ORACLES, QUERIES
from tests.conftest import SMALL


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(SMALL):
        c.execute(f"create view {f.split('.')[0]} as select * from '{SMALL}/{f}'")
    return c


def plain(v):
    if isinstance(v, float):
        return f"{v:.6g}" if v else "0"
    return "null" if v is None else f"{v:.6g}" if type(v).__name__ == "Decimal" else str(v)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, con, name):
    want = con.execute(ORACLES[name])
    names = sorted(c[0] for c in want.description)
    order = [[c[0] for c in want.description].index(n) for n in names]
    rows = sorted(tuple(plain(r[i]) for i in order) for r in want.fetchall())
    out = QUERIES[name](spark, SMALL)
    assert sorted(out.columns) == names
    got = sorted(tuple(plain(r[n]) for n in names) for r in out.collect())
    assert [tuple("0" if x == "0.0" else x for x in r) for r in got] == [tuple("0" if x == "0.0" else x for x in r) for r in rows]


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SMALL).count() > 0


def test_llm_may_be_missing():
    import subprocess
    import sys

    code = "import sys; sys.modules['plenum.llm'] = None\nimport __spark_entry__ as e; assert e.queries() and not any(n.startswith('op') for n in e.queries())"
    code = code.replace("sys.modules['plenum.llm'] = None", "import importlib.abc\nclass Gone(importlib.abc.MetaPathFinder):\n    def find_spec(self, name, path=None, target=None):\n        if name.startswith('plenum.llm'): raise ModuleNotFoundError(name=name)\nsys.meta_path.insert(0, Gone())")
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    assert subprocess.run([sys.executable, "-c", code], cwd=root, timeout=100).returncode == 0
