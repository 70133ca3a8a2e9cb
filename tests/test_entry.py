import os
import re

import duckdb
import pytest

import __spark_entry__ as entry
from tests.conftest import DATA

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")
CORE = [n for p in entry._PLANS if not p.__name__.startswith("corpusloom.llm") for n in p.QUERIES]


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{DATA}/{f}')")
    return c


def plain(x):
    if isinstance(x, float):
        return round(x, 5)
    return tuple(map(plain, x)) if isinstance(x, (list, tuple)) else x


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_names():
    assert all(re.fullmatch(r"[a-z0-9_]+", n) for n in entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", CORE)
def test_query(spark, duck, name):
    df = entry.queries()[name](spark, DATA)
    rows = df.collect()
    if name in entry.oracle_sql():
        r = duck.sql(entry.oracle_sql()[name])
        columns = sorted(df.columns)
        assert sorted(r.columns) == columns
        at = [r.columns.index(c) for c in columns]
        want = sorted(repr(tuple(plain(x[i]) for i in at)) for x in r.fetchall())
        assert sorted(repr(tuple(plain(x[c]) for c in columns)) for x in rows) == want
