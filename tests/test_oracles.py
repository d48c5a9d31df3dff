"""Every registered query against its DuckDB form on the smallest tables."""

import datetime
import decimal
import glob
import os

import duckdb
import pytest

from tessera.plans import analytics_queries, catalog_queries, lifecycle_queries, records_queries, report_queries, retrieval_queries

SF = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
MODULES = (analytics_queries, catalog_queries, lifecycle_queries, records_queries, report_queries, retrieval_queries)
NAMES = [(m, n) for m in MODULES for n in m.QUERIES]

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


def plain(x):
    if hasattr(x, "asDict"):
        x = list(x.asDict().values())
    if isinstance(x, (list, tuple)):
        return tuple(map(plain, x))
    if isinstance(x, bool) or x is None:
        return str(x)
    if isinstance(x, (int, float, decimal.Decimal)):
        return f"{float(x):.5f}"
    if isinstance(x, datetime.datetime):
        return x.isoformat()
    return str(x)


@pytest.mark.parametrize(("module", "name"), NAMES, ids=[n for _, n in NAMES])
def test_query(spark, duck, module, name):
    got = module.QUERIES[name](spark, SF)
    rows = got.collect()
    if name not in module.ORACLES:
        assert got.columns
        return
    want = duck.sql(module.ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns)
    order = sorted(range(len(want.columns)), key=lambda i: want.columns[i])
    mine = sorted(tuple(plain(r[c]) for c in sorted(got.columns)) for r in rows)
    assert mine == sorted(tuple(plain(r[i]) for i in order) for r in want.fetchall())
