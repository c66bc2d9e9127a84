"""Every registered query against its SQL on another engine, on the smallest tables."""

import math
from pathlib import Path

import pytest

from cloudloom.plans import registry

SF = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not SF.exists(), reason="the driver's tables aren't here")


@pytest.fixture(scope="module")
def db():
    import duckdb

    c = duckdb.connect()
    for f in SF.glob("*.parquet"):
        c.execute(f"create view {f.stem} as select * from '{f}'")
    return c


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool) or not isinstance(v, int | float):
        return v if isinstance(v, bool | str) else str(v)
    return float(v)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_equals_sql(spark, db, name):
    got = registry.queries()[name](spark, str(SF))
    want = db.sql(registry.oracle_sql()[name])
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    key = lambda r: tuple((x is None, str(type(x)), x) for x in r)
    a = sorted((tuple(plain(r[c]) for c in cols) for r in got.collect()), key=key)
    at = [want.columns.index(c) for c in cols]
    b = sorted((tuple(plain(r[k]) for k in at) for r in want.fetchall()), key=key)
    assert a == b


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql()) - {"svm", "ada"}))
def test_runs(spark, name):
    assert registry.queries()[name](spark, str(SF)).count() >= 0
