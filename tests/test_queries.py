"""Every core query against its independent SQL, over the smallest tables."""

import math
import os

import duckdb
import pytest

from vellumgrid.plans import queries as Q

D = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(D), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.sql("SET TimeZone = 'UTC'")
    for f in os.listdir(D):
        c.sql(f"CREATE VIEW {f.split('.')[0]} AS FROM '{D}/{f}'")
    return c


def rows(data, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    show = lambda x: ("nan" if math.isnan(x) else repr(x + 0.0)) if isinstance(x, float) else repr(x)
    return sorted(tuple(show(r[i]) for i in order) for r in data)


@pytest.mark.parametrize("name", sorted(Q.SQL))
def test_query_equals_sql(spark, con, name):
    df = Q.QUERIES[name](spark, D)
    want = con.sql(Q.SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert rows([tuple(r) for r in df.collect()], df.columns) == rows(want.fetchall(), want.columns)


@pytest.mark.parametrize("name", sorted(set(Q.QUERIES) - set(Q.SQL)))
def test_query_runs(spark, name):
    assert Q.QUERIES[name](spark, D).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_without_the_libraries_of_the_subpackage():
    """The core stays whole where a library that only the subpackage needs is missing."""
    import subprocess
    import sys
    from pathlib import Path

    code = "import sys; sys.modules['ahocorasick'] = None; import __spark_entry__ as e; assert 'page_layout' in e.queries() and not [k for k in e.queries() if k.startswith('p1_')] and 'page_layout' in e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=Path(__file__).resolve().parents[1])
