"""The driver's contract: every query of the engine agrees with its SQL on the small tables."""

import os

import pytest

import __spark_entry__ as entry
from docloom.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the test tables are not here")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def _value(x):
    if x is None or x != x:
        return None
    return str(x) if isinstance(x, (str, bool)) else round(float(x), 4)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query_agrees_with_sql(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    names = sorted(df.columns)
    got = sorted((tuple(map(_value, r)) for r in df.select(*names).collect()), key=repr)
    q = duck.execute(catalogue.SQL[name])
    cols = [c[0] for c in q.description]
    rows = q.fetchall()
    assert sorted(cols) == names
    order = [cols.index(n) for n in names]
    assert got == sorted((tuple(_value(r[i]) for i in order) for r in rows), key=repr)


def test_entry(spark):
    assert entry.entry(spark).columns == ["o_orderkey", "o_totalprice"]
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_nothing_outside_imports_the_optional_subpackage():
    root = os.path.join(os.path.dirname(entry.__file__), "docloom")
    for folder, _, files in os.walk(root):
        if os.sep + "llm" not in folder:
            for f in files:
                if f.endswith(".py"):
                    with open(os.path.join(folder, f), encoding="utf-8") as text:
                        assert "docloom.llm" not in text.read(), f
