"""Every registered query of the base package runs; those with SQL give the rows that the SQL gives."""

from __future__ import annotations

import pytest

from riskframe.plans.catalogue import ORACLES, QUERIES

from .compare import assert_same, duck


@pytest.fixture(scope="module")
def con(sf):
    return duck(sf)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, con, name):
    ours = QUERIES[name](spark, sf).toPandas()
    if name in ORACLES:
        assert_same(ours, con.execute(ORACLES[name]).df())
    else:
        assert len(ours)


def test_every_sql_has_its_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 1
    assert set(QUERIES) <= set(e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())


def test_base_does_not_need_the_corpus_operators():
    """With riskframe.llm and corpus_pipeline gone, the entry still imports and has the base queries."""
    import subprocess
    import sys

    code = (
        "import sys, importlib.abc\n"
        "class Gone(importlib.abc.MetaPathFinder):\n"
        "    def find_spec(self, name, path, target=None):\n"
        "        if name.split('.')[:2] == ['riskframe', 'llm'] or name == 'corpus_pipeline':\n"
        "            raise ModuleNotFoundError(f'No module named {name!r}', name=name)\n"
        "sys.meta_path.insert(0, Gone())\n"
        "import __spark_entry__ as e\n"
        "q = e.queries(); assert q and not any(x.startswith('op1_') or x == 'pipeline' for x in q); e.oracle_sql()\n"
    )
    subprocess.run([sys.executable, "-c", code], check=True, cwd=__file__.rsplit("/tests/", 1)[0])
