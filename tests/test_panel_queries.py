"""Every panel query with SQL gives the SQL's rows on the smallest tables."""

import math

import duckdb
import pytest

from quarry.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def key(row):
    return tuple((x is None or x != x, str(type(x)) if x is None or x != x else "", 0 if x is None or x != x else x if isinstance(x, int | float) else str(x)) for x in row)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_sql(spark, con, name):
    got = catalog.queries()[name](spark, SF)
    columns = sorted(got.columns)
    want = con.sql(catalog.oracle_sql()[name])
    assert columns == sorted(want.columns)
    a = sorted((tuple(r[c] for c in columns) for r in got.collect()), key=key)
    b = sorted(want.project(", ".join(f'"{c}"' for c in columns)).fetchall(), key=key)
    assert len(a) == len(b)
    for x, y in zip(a, b, strict=True):
        for u, v in zip(x, y, strict=True):
            assert u == v or (isinstance(u, float) and isinstance(v, float) and math.isclose(u, v, abs_tol=1.1e-6)), (x, y)


def test_names_of_queries_and_sql_agree():
    assert set(catalog.oracle_sql()) <= set(catalog.queries())
