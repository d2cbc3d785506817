"""Each query with SQL gives DuckDB's rows; the others give rows."""

import math
import os

import duckdb
import pytest

from quizforge.plans import catalog

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.6g}" if abs(v) > 1e-9 else "0"
    if isinstance(v, (list, tuple)):
        return [norm(x) for x in v]
    return str(v) if not hasattr(v, "as_tuple") else norm(float(v))


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for name in catalog.TABLES:
        c.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_same_rows(spark, con, name):
    df = catalog.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted([norm(v) for v in r] for r in df.select(*cols).collect())
    found = con.execute(catalog.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    assert got == sorted([norm(r[i]) for i in at] for r in found.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_rows(spark, name):
    assert catalog.queries()[name](spark, SF).count() > 0
